"""corpus_pipeline: each stage against a plain version of its rule."""

from __future__ import annotations

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm.common import materialize, table
from quillon.llm.language_id import fit, held_out, identify
from tests.llm.test_corpus import classes


def test_stages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    seen = [{r.doc_id: r.text for r in d.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        columns = d.columns
        d = materialize(stage(spark, d, sf_dir), name)
        if name != "bpe":
            assert d.columns == columns
            seen.append({r.doc_id: r.text for r in d.collect()})
            assert set(seen[-1]) <= set(seen[-2])
    start, lang, exact, near, clean = seen
    told = {x.doc_id: x for x in identify(table(spark, sf_dir, "documents"), fit(table(spark, sf_dir, "documents").where(~held_out()))).collect()}
    for i, t in start.items():
        letter = re.search(r"[^\W\d_]", t or "")
        assert (i in lang) == (bool(letter) and not told[i].ambiguous), i
    groups: dict[str, list] = {}
    for i, t in lang.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    assert set(exact) == {min(g)[1] for g in groups.values()}
    assert set(near) == set(classes(list(exact.items())).values())
    items = [r.text for r in table(spark, sf_dir, "benchmark").collect()]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[p : p + 13]) for w in map(find, items) for p in range(max(1 if w else 0, len(w) - 12))}
    sizes = {len(w) for w in windows}
    for i, t in near.items():
        w = find(t)
        hit = {q for n in sizes for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in windows for q in range(p, p + n)}
        assert (i in clean) == (not hit or 20 * len(hit) < len(w)), i
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = d.collect()
    assert {r.doc_id for r in rows} == set(clean)
    for r in rows:
        assert r.ids == lib.encode(clean[r.doc_id] or "", add_special_tokens=False).ids


def test_run(spark, sf_dir):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf_dir).count() > 100


def test_odd_rows(spark, tmp_path):
    rows = [(None, "no id at all here", "en", 1), (1, None, None, 2), (2, "", "en", 3), (3, "same text of words", "en", 4), (4, "same  text of words", "en", 4), (4, "same  text of words", "en", 4), (5, "123", "en", 5), (6, "other text of words " * 5000, "en", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, _doc int")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 4, 6]


def test_exact_stage_tells_rows_of_an_id_apart(spark, tmp_path):
    rows = [(1, "A", "en", 1), (2, "A", "en", 1), (2, "B", "en", 1), (2, "B", "de", 1), (2, " B", "en", 1), (None, "C", None, 1)]
    d = materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int"), "rows")
    got = corpus_pipeline.exact(spark, d, "")
    assert got.columns == d.columns and sorted(map(str, got.collect())) == sorted(map(str, [d.where("doc_id = 1").first(), d.where("text = ' B'").first(), d.where("text = 'C'").first()]))
