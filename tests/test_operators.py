"""Formulas on published figures, invariants, and operators that SQL doesn't cover."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from quillon.functions.numeric import binomial_tail, lgamma, wilson
from quillon.functions.text import REDACTION_RULES, redact
from quillon.operators import inference, ontology, series
from quillon.operators.annotations import from_lineitem, long_form, normal_code
from quillon.operators.clusters import density_clusters
from quillon.operators.confusion import confusion_counts, with_metrics
from quillon.operators.vectors import hashed_terms
from quillon.plans import reference_queries
from quillon.sources import files
from quillon.sources.tables import table
from quillon.streaming import events as stream_events


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_binomial_tail(spark):
    b, none = one(spark, binomial_tail(F.lit(7), F.lit(16)), binomial_tail(F.lit(0), F.lit(0)))
    assert b == pytest.approx(0.7727508544921875, abs=1e-10) and none is None


@pytest.mark.parametrize("x", [1.0, 2.0, 7.5, 100.0, 1e6])
def test_lgamma(spark, x):
    assert one(spark, lgamma(F.lit(x)))[0] == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-10)


def test_wilson_edges(spark):
    lo, hi = wilson(F.lit(0), F.lit(0))
    assert tuple(one(spark, lo, hi)) == (None, None)
    lo, hi = wilson(F.lit(0), F.lit(10))
    assert one(spark, lo, hi)[0] == 0.0


def test_codes(spark):
    rows = spark.createDataFrame([("NA ",), (" n/a",), ("na",), ("1",), (None,), ("x",)], "c string")
    assert [r[0] for r in rows.select(normal_code(F.col("c"))).collect()] == ["N/A", "N/A", "N/A", "1", None, "x"]


def test_metrics_without_denominators(spark):
    c = spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long")
    r = with_metrics(c).first()
    assert r.sensitivity is None and r.f1 is None and r.fabrication_rate == 0.0
    assert with_metrics(c, "fpr").first().fabrication_rate is None


def test_published_counts(spark):
    c = spark.createDataFrame([(90, 2, 8, 100)], "tp long, fp long, fn long, tn long")
    r = with_metrics(c).first()
    assert (r.sensitivity, r.ppv, r.accuracy) == (round(90 / 98, 6), round(90 / 92, 6), 0.95)


def test_counts_cover_rows(spark, sf_dir):
    long = long_form(from_lineitem(table(spark, sf_dir, "lineitem")))
    total = confusion_counts(long, ["annotator"]).select(F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).first()[0]
    assert 0 < total <= long.count()


def test_redaction_is_idempotent(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(redact(F.col("text")).alias("a"))
    assert d.where(redact(F.col("a")) != F.col("a")).count() == 0
    assert len({n for n, _ in REDACTION_RULES}) == len(REDACTION_RULES)


def test_wilcoxon_drops_zeros(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 0.0, 1.0, -2.0, 3.0)], "d double")
    r = inference.wilcoxon(d, "d", []).first()
    assert (r.n, r.w_plus) == (3, 4.0)


def test_bootstrap_is_repeatable(spark, sf_dir):
    long = long_form(from_lineitem(table(spark, sf_dir, "lineitem")))
    a, b = (inference.bootstrap_counts(long, "case_id", ["annotator"], 5, 7).orderBy("b", "annotator").collect() for _ in "ab")
    assert a == b and len(a) == 10


def test_ontology(spark):
    n = spark.createDataFrame([(None, "a", 0, True), ("a", "b", 1, False), ("b", "c", 2, True), ("a", "d", 1, True)], "parent string, child string, layer int, own boolean")
    assert {r.child: r.open for r in ontology.propagate(n, "own", 2).collect()} == {"a": True, "b": False, "c": False, "d": True}
    assert {r.child for r in ontology.leaves(n).collect()} == {"c", "d"}


def test_holt_follows_a_line(spark):
    d = spark.createDataFrame([("g", i, 2.0 * i + 1) for i in range(10)], "g string, i int, y double")
    assert [r.forecast for r in series.holt(d, "g", "i", "y").orderBy("step").collect()] == [21.0, 23.0, 25.0]


def test_clusters(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [0.0, 0.0])], "id int, v array<double>")
    assert {r.id: r.cluster for r in density_clusters(rows, "id", "v", 0.3, 2).collect()} == {1: 1, 2: 1, 3: -1, 4: 4, 5: 4}


def test_run_folders(spark, tmp_path):
    for run, tp in (("m1_rag2_2024", 3.0), ("m-2_rag_2025", 4.0)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.json").write_text(json.dumps({"E1": {"TP": tp}, "__aggregate__": {"accuracy": 0.5}}))
    got = {(r.model, r.approach, r.element) for r in files.runs(spark, str(tmp_path), ["rag", "rag2"]).collect()}
    assert got == {("m1", "rag2", "E1"), ("m1", "rag2", "__aggregate__"), ("m-2", "rag", "E1"), ("m-2", "rag", "__aggregate__")}


def test_readers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, None)], "k int, v string")
    files.write(df, str(tmp_path / "x.csv"))
    assert {r.k: r.v for r in files.csv(spark, str(tmp_path / "x.csv"), schema="k int, v string").collect()}[2] is None
    files.write(df, str(tmp_path / "x.parquet"))
    assert files.cached(spark, str(tmp_path / "x.parquet"), None).count() == 2
    (tmp_path / "c1.txt").write_text("one\ntwo")
    assert files.corpus(spark, str(tmp_path / "*.txt")).first().asDict() == {"case_id": "c1", "text": "one\ntwo"}
    assert files.first_existing(spark, [str(tmp_path / "none"), str(tmp_path)]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "none")])


def test_markup_folders_and_fallback(spark):
    raw = spark.createDataFrame([("<DOC id='1'><TITLE>t</TITLE><BODY>x\ny</BODY></DOC> <DOC></DOC>",)], "s string")
    assert [r.title for r in files.sgml_documents(raw, "s", "DOC", ["TITLE"]).collect()] == ["t", ""]
    paths = spark.createDataFrame([("/d/AB_CD_inv/1.pdf",), ("/d/AB_CD_inv/2.pdf",), ("/d/other/3.pdf",)], "path string")
    assert files.case_folders(paths).first().files == "1.pdf|2.pdf"
    text, method = files.text_with_fallback([("a", F.lit("x" * 10), 50), ("b", F.lit("y" * 60), 50)])
    assert tuple(one(spark, F.length(text), method)) == (60, "b")


def test_provider(spark):
    p = spark.createDataFrame([("c", "E1", "hello")], "case_id string, element string, prompt string")
    assert "not stated" in files.provider_map(p, files.dry_run).first().raw_response


def test_hashed_terms_of_a_long_document(spark, tmp_path):
    """5,000 distinct tokens in 2**18 slots: few collide, values are signed, and the vector has unit length."""
    d = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(5000))), (2, ""), (3, None)], "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = hashed_terms(d, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("length"), F.count_if(F.col("value") < 0).alias("negative")).collect()
    d.withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(str(tmp_path / "documents.parquet"))
    entries = {r.doc_id: r.n_entries for r in reference_queries()["hashing_tf"](spark, str(tmp_path)).collect()}
    assert entries == {1: got[0].n, 2: 0, 3: 0}
    assert [r.doc_id for r in got] == [1] and 4850 <= got[0].n <= 5000 and abs(got[0].length - 1) < 1e-9 and 2000 < got[0].negative < 3000



def test_streams_agree_with_tables(spark, sf_dir, tmp_path):
    e = table(spark, sf_dir, "events")
    e.write.parquet(str(tmp_path / "in"))
    s = stream_events.stream(spark, str(tmp_path / "in"), e.schema)
    out = stream_events.tumbling(s, "1 hour")
    out.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert spark.table("tumbled").exceptAll(stream_events.tumbling(e, "1 hour")).count() == 0
    seen = []
    stream_events.minibatches(stream_events.stream(spark, str(tmp_path / "in"), e.schema), lambda b, i: seen.append(b.count()), str(tmp_path / "cp2"))
    assert sum(seen) == e.count()
