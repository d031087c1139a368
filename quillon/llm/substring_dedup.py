"""Removal of passages that repeat across documents, by suffix automata (operator 5).

A window is 50 consecutive words of one row's text; a word goes if a window that covers it also starts in a row with a
smaller id. Windows are judged on the input.

A suffix automaton of all reference text can't be broadcast: it grows with the corpus, and passing every document by the
automata of all shards takes time that grows with its square. So reference shards are made small enough and each text goes
to those only that can match it:

1. Every window picks an anchor, the 10-word run of smallest number in it; equal windows pick equal anchors. Anchors that
   occur in one text only cannot be part of a repeated window, and most text stops here. Rows of equal words are settled
   as one.
2. Around each repeated anchor, the windows that picked it form a span. Spans equal to a span of a smaller id go as wholes,
   so a passage that very many documents share is not taken apart in each of them. Of the others, windows whose number
   occurs once cannot be repeated; what is left are runs of windows that may be.
3. The runs of one anchor are a shard. In the order of ids, each run is streamed past the shard's suffix automaton: where the
   matching statistics reach 50 words, a window is repeated. Then the automaton takes the run in. Equal runs are streamed
   once, so a shard holds distinct texts of at most 2 * 50 - 10 words. Should an anchor have more than `SHARD` of them, its
   windows are compared as wholes instead, dealt out by their own digests.

Numbers of words only ever select candidates. What is removed has been compared word by word in an automaton, or by a
128-bit or longer cryptographic digest of its words (whole texts, spans and runs, and windows of the largest shards).

Words are runs of other characters than white space. Null and empty texts have no words; texts may be of any length. Rows
that repeat an id are judged each by its own text, and never by each other's; rows with a null id are left as they are. An
empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import give_back, map_text, materialize, release, small_batches, table, text_chunks
from quillon.llm.words import NONSPACE, SuffixAutomaton, Words, mixed, runs

WINDOW = 50
ANCHOR = 10
#: Distinct runs of one anchor that one automaton takes in.
SHARD = 5_000


def window_anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window (as a word position over all texts), its anchor's number and the anchor's position."""
    n = len(words.number)
    if n < window:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
    gram = runs(words.number, anchor)
    wide = window - anchor + 1
    # Smallest in each stretch of `wide`: prefixes and suffixes of blocks of that length.
    pad = -len(gram) % wide
    value = np.append(gram, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, wide)
    before = np.minimum.accumulate(value, axis=1).reshape(-1)
    after = np.minimum.accumulate(value[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = len(gram) - wide + 1
    least = np.minimum(after[:m], before[wide - 1 : wide - 1 + m])
    start = np.flatnonzero(words.doc[:m] == words.doc[window - 1 : window - 1 + m])
    # The anchor's place: the next position from the start on with that number.
    last_at = np.empty(0, np.int64)
    if len(start):
        order = np.lexsort((np.arange(len(gram)), gram))
        sorted_gram = gram[order]
        lo = np.searchsorted(sorted_gram, least[start], side="left")
        hi = np.searchsorted(sorted_gram, least[start], side="right")
        last_at = order[lo]
        many = np.flatnonzero(last_at < start)
        for i in many.tolist():  # a number that occurs several times
            own = order[lo[i] : hi[i]]
            last_at[i] = own[np.searchsorted(own, start[i])]
    return start, least[start], last_at


def window_numbers(words: Words, window: int) -> np.ndarray:
    """A number for each run of `window` words, by doubling."""
    with np.errstate(over="ignore"):
        have, width, out, done = words.number, 1, None, 0
        left = window
        while left:
            if left & 1:
                if out is None:
                    out, done = have.copy(), width
                else:
                    n = len(have) - done
                    out = mixed(out[:n] * np.uint64(0x9FB21C651E98DF25) + have[done : done + n]) if n > 0 else out[:0]
                    done += width
            left >>= 1
            if left:
                n = len(have) - width
                have = mixed(have[:n] * np.uint64(0xD1B54A32D192ED03) + have[width:]) if n > 0 else have[:0]
                width *= 2
    return out[: max(0, len(words.number) - window + 1)]


def _joined(text: str | None) -> bytes:
    """A text's words, joined by one space; bytes.split() cuts at just the white space of the definition."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").split())


def _digest(joined: bytes) -> bytes:
    return hashlib.sha256(joined).digest()


def _number(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _first_pass(window: int, anchor: int):
    def make():
        def f(texts: list[str]) -> dict[str, list]:
            words = Words(texts, NONSPACE)
            start, number, _ = window_anchors(words, window, anchor)
            doc = words.doc[start] if len(start) else start
            keep = np.append(True, (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])) if len(start) else np.empty(0, bool)
            number, doc = number[keep].view(np.int64), doc[keep]
            bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
            return {
                "n_words": words.count.tolist(),
                "digest": [_digest(_joined(t)) for t in texts],
                "anchors": [np.unique(number[bounds[i] : bounds[i + 1]]).tolist() for i in range(len(texts))],
            }

        return f

    return make


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (id, t) with what is marked in them: a row of marks is of one id and one digest, a text of an id has one of its own."""
    by_id = marks.groupBy("id").agg(F.collect_list(F.struct("digest", "mark")).alias("marks"))
    return rows.join(by_id, "id").select("id", "t", "marks")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes], list]]:
    """Rows of _marked() whose text has a mark: ids, joined words, marks."""
    for rows, texts in text_chunks(batch, "t"):
        joined, marks, at = [], [], []
        for i, t in enumerate(texts):
            j = _joined(t)
            d = _digest(j)
            for m in rows.column(2)[i].as_py():
                if m["digest"] == d:
                    joined.append(j)
                    marks.append(m["mark"])
                    at.append(i)
        if at:
            yield rows.take(pa.array(at)), joined, marks


def _spans(marked: DataFrame, window: int, anchor: int) -> DataFrame:
    """marked: id, t, marks (repeated anchors). Rows a, g (the span's digest), id, digest, s, windows (numbers)."""
    kind = marked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, joined, marks in _chunks(batch):
                words = Words(joined, NONSPACE)
                start, number, place = window_anchors(words, window, anchor)
                if not len(start):
                    continue
                doc = words.doc[start]
                new = np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1]))
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(start)))
                owner = doc[first]
                chosen = np.zeros(len(first), bool)
                bounds = np.searchsorted(owner, np.arange(len(joined) + 1))
                for i, mark in enumerate(marks):
                    a, b = bounds[i], bounds[i + 1]
                    chosen[a:b] = np.isin(number[first[a:b]].view(np.int64), np.array(mark, np.int64))
                each = window_numbers(words, window)
                first, size, owner = first[chosen], size[chosen], owner[chosen]
                begin = start[first]
                spans = [_number(words.data[x:y].tobytes()) for x, y in zip(words.start[begin].tolist(), words.stop[begin + size - 1 + window - 1].tolist())]
                digests = [_digest(j) for j in joined]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number[first].view(np.int64)), pa.array(spans, pa.binary()), rows.column(0).take(pa.array(owner)), pa.array([digests[i] for i in owner.tolist()], pa.binary()),
                        pa.array((begin - words.first[owner]).astype(np.int32)), pa.array([each[x : x + k].view(np.int64).tolist() for x,
                            k in zip(begin.tolist(), size.tolist())], pa.list_(pa.int64())),
                    ],
                    names=["a", "g", "id", "digest", "s", "windows"],
                )
        give_back()

    return marked.mapInArrow(run, f"a bigint, g binary, id {kind}, digest binary, s int, windows array<bigint>")


def _runs(marked: DataFrame, window: int) -> DataFrame:
    """marked: id, t, marks (a, starts of windows). Rows a, g (the run's digest), text, id, digest, s: maximal runs of such windows."""
    kind = marked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, joined, marks in _chunks(batch):
                out: list[tuple] = []
                for i, (j, mark) in enumerate(zip(joined, marks)):
                    words, d = j.split(), _digest(j)
                    for m in mark:
                        at = np.unique(m["starts"])
                        for part in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                            text = b" ".join(words[part[0] : part[-1] + window])
                            out.append((m["a"], _number(text), text, i, d, int(part[0])))
                if out:
                    a, g, text, i, d, s = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(g, pa.binary()), pa.array(text, pa.binary()),
                        rows.column(0).take(pa.array(i)), pa.array(d, pa.binary()), pa.array(s, pa.int32())], names=["a", "g", "text", "id",
                        "digest", "s"])
        give_back()

    return marked.mapInArrow(run, f"a bigint, g binary, text binary, id {kind}, digest binary, s int")


def _by_automata(shards: DataFrame, window: int) -> DataFrame:
    """shards: a, g, text, least. Rows a, g, from, to: stretches of a run that windows of runs with a smaller least cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = at_id = automaton = None
        waiting: list[list[bytes]] = []
        for batch in batches:
            out: list[tuple] = []
            for a, g, text, least in zip(*(c.to_pylist() for c in batch.columns)):
                if a != shard:
                    shard, at_id, automaton, waiting = a, least, SuffixAutomaton(), []
                if least != at_id:  # runs of one id don't count against each other
                    for w in waiting:
                        automaton.add(w)
                    at_id, waiting = least, []
                words = text.split()
                if automaton.length[1:]:
                    ends = [i + 1 for i, n in enumerate(automaton.statistics(words)) if n >= window]
                    to = 0
                    for e in ends:
                        if e - window > to or not to:
                            out.append([a, g, e - window, e])
                        else:
                            out[-1][3] = e
                        to = e
                waiting.append(words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int32(), pa.int32()))], names=["a", "g", "from", "to"])
        give_back()

    dealt = shards.select("a", "g", "text", "least").repartition("a").sortWithinPartitions("a", "least", "g")
    return dealt.mapInArrow(run, "a bigint, g binary, from int, to int")


def _by_windows(shards: DataFrame, window: int) -> DataFrame:
    """The same for shards of any size: windows meet the smallest id by a digest of their words."""
    words = F.split(F.col("text").cast("string"), " ")
    each = shards.select("a", "g", "least", words.alias("w")).select("a", "g", "least", "w", F.explode(F.sequence(F.lit(0), F.size("w") - window)).alias("from"))
    each = materialize(each.select("a", "g", "least", "from", F.sha2(F.array_join(F.slice("w", F.col("from") + 1, window), " "), 256).alias("k")), "large-shards")
    first = each.groupBy("a", "k").agg(F.min("least").alias("first"))
    return each.join(first, ["a", "k"]).where("first < least").select("a", "g", "from", (F.col("from") + window).alias("to"))


def repeated_passages(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept (string: the words that stay, joined by one space)."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("anchors", T.ArrayType(T.LongType()))])
    base = materialize(map_text(named, schema, _first_pass(window, anchor), text_col="t", keep=("id",)), "anchors")
    full = base.where(f"n_words >= {window} and id is not null")
    first = materialize(full.groupBy("digest").agg(F.min("id").alias("rep")), "equal-texts")
    copies = full.select("id", "digest").join(first, "digest").where("id <> rep").select("id", "digest").distinct()
    own = full.select("id", "digest", "anchors").join(first, "digest").where("id = rep").select("id", "digest", F.explode("anchors").alias("a")).distinct()
    own = materialize(own, "own-anchors")
    shared = materialize(own.groupBy("a").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("a"), "shared")
    marked = materialize(own.join(shared, "a").groupBy("id", "digest").agg(F.collect_list("a").alias("mark")), "marked")
    spans = materialize(_spans(_marked(named, marked), window, anchor), "spans")
    release(own, shared, marked)
    least = materialize(spans.groupBy("a", "g").agg(F.min("id").alias("least")), "least-spans")
    judged = spans.join(least, ["a", "g"])
    whole = judged.where("least < id").select("id", "digest", "s", (F.col("s") + F.size("windows") - 1 + window).alias("e"))
    single = materialize(judged.where("least = id").select("a", "id", "digest", F.posexplode("windows").alias("k", "w"), "s").select("a", "w", "id",
        "digest", (F.col("s") + F.col("k")).alias("s")), "windows")
    again = materialize(single.groupBy("a", "w").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("a", "w"), "repeated-windows")
    starts = single.join(again, ["a", "w"]).groupBy("id", "digest", "a").agg(F.collect_list("s").alias("starts"))
    starts = materialize(starts.groupBy("id", "digest").agg(F.collect_list(F.struct("a", "starts")).alias("mark")), "starts")
    release(single, again)
    found = materialize(_runs(_marked(named, starts), window), "runs")
    release(starts)
    of_run = materialize(found.groupBy("a", "g").agg(F.min("id").alias("least"), F.min("text").alias("text")), "shards")
    large = of_run.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > shard).select("a")
    large = materialize(large, "large-anchors")
    cut = _by_automata(of_run.join(large, "a", "left_anti"), window)
    if large.take(1):
        cut = cut.unionByName(_by_windows(of_run.join(large, "a", "left_semi"), window))
    cut = cut.groupBy("a", "g").agg(F.collect_list(F.struct("from", "to")).alias("cut"))
    placed = found.select("a", "g", "id", "digest", "s", F.size(F.split(F.col("text").cast("string"), " ")).alias("n"))
    placed = placed.join(of_run.select("a", "g", "least"), ["a", "g"])
    whole_runs = placed.where("least < id").select("id", "digest", "s", (F.col("s") + F.col("n")).alias("e"))
    part = placed.where("least = id").join(cut, ["a", "g"]).select("id", "digest", "s", F.explode("cut").alias("c")).select("id", "digest",
        (F.col("s") + F.col("c.from")).alias("s"), (F.col("s") + F.col("c.to")).alias("e"))
    gone = whole.unionByName(whole_runs).unionByName(part).distinct().groupBy("id", "digest").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("mark"))
    gone = materialize(gone, "gone")
    all_of = copies.select("id", "digest", F.array(F.struct(F.lit(0).alias("s"), F.lit(2**31 - 1).alias("e"))).alias("mark"))
    plan = gone.join(copies, ["id", "digest"], "left_anti").unionByName(all_of)
    plan = materialize(plan.groupBy("id").agg(F.collect_list(F.struct("digest", "mark")).alias("marks")), "plan")
    out = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    result = T.StructType([docs.select(F.col(id_col).alias("id")).schema["id"], *out.fields])
    joined = named.join(plan, "id", "left").select("id", "t", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(result)
        for batch in batches:
            for rows, texts in text_chunks(batch, "t"):
                n_words, n_removed, kept = [], [], []
                for i, t in enumerate(texts):
                    j = _joined(t)
                    words = j.split()
                    n_words.append(len(words))
                    marks = rows.column(2)[i].as_py()
                    mark = next((m["mark"] for m in marks if m["digest"] == _digest(j)), ()) if marks else ()
                    stay = np.ones(len(words), bool)
                    for m in mark:
                        stay[m["s"] : m["e"]] = False
                    n_removed.append(int(len(words) - stay.sum()))
                    kept.append((b" ".join([words[k] for k in np.flatnonzero(stay).tolist()]) if mark else j).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(arrow[0].type), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema=arrow)
        give_back()

    return joined.mapInArrow(run, result).withColumnRenamed("id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS f FROM x),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM m WHERE f < doc_id)),
kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.q) AS s, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.q = g.q
  GROUP BY a.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
