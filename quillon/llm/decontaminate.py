"""Benchmark decontamination with suffix arrays of the training text (operator 8).

Documents arrive in shards (stretches of a partition). A shard's words become numbers; a suffix array over it holds, in
sorted order, the positions from which a benchmark word sequence could start (positions whose word no benchmark item has
cannot, so they are left out and break sequences). Every benchmark suffix is binary-searched in it: the range of equal
prefixes gives the locations of its window, and locations that follow each other in document and item alike make up the
longest verbatim match. Words are compared as 64-bit numbers; each location is confirmed on the words themselves.

Words: A-Z lower-cased, then runs of digits, a-z and all non-ASCII characters. A window is `window` consecutive words of
an item; an item of fewer words, but not none, is one window. Null and empty texts have no words and are not contaminated.
The benchmark is indexed in blocks of bounded size, one at a time on the driver; a worker searches a shard for all blocks
in turn and holds `HELD` of them, so the benchmark's size is not limited by anyone's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import map_text, table
from quillon.llm.words import ALNUM, LOWER, Words

WINDOW = 13
#: Text bytes of one block of the benchmark; a block is sent to every task.
BLOCK_BYTES = 8_000_000
#: Blocks that a worker keeps in memory; where there are more, they are loaded anew for each shard.
HELD = 2
#: Characters of a shard.
SHARD_CHARS = 2_000_000


class Benchmark:
    """A block of items, ready to be searched: the windows as rows of word ranks, and the words' numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        w = Words([t or "" for _, t in items], ALNUM, LOWER) if items else None
        self.window = window
        self.data, self.start, self.stop = (w.data, w.start, w.stop) if w is not None else (np.empty(0, np.uint8), *(np.empty(0, np.int64),) * 2)
        self.vocabulary = np.unique(w.number) if w is not None else np.empty(0, np.uint64)
        rows, owner, sizes, first = [], [], [], []
        if w is not None:
            ranks = np.searchsorted(self.vocabulary, w.number).astype(np.uint32) + 1
            bounds = np.searchsorted(w.doc, np.arange(len(items) + 1))
            for i in range(len(items)):
                a, b = int(bounds[i]), int(bounds[i + 1])
                for p in range(a, max(a + (b > a), b - window + 1)):
                    n = min(window, b - a)
                    row = np.zeros(window, np.uint32)
                    row[:n] = ranks[p : p + n]
                    rows.append(row)
                    owner.append(i)
                    sizes.append(n)
                    first.append(p)
        self.rows = np.array(rows, np.uint32).reshape(-1, window)
        self.owner, self.sizes, self.first = (np.array(x, np.int64) for x in (owner, sizes, first))
        self.ids = [str(i) for i, _ in items]
        self.item_first = w.first if w is not None else np.empty(0, np.int64)
        self.least = int(self.sizes.min()) if len(self.sizes) else 0


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows as byte strings that sort as the rows do."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").reshape(-1)


class SuffixArray:
    """Sorted suffixes, to the depth of a window, of the positions where a benchmark sequence may start."""

    def __init__(self, words: Words, bench: Benchmark):
        self.words, n = words, len(words.number)
        at = np.minimum(np.searchsorted(bench.vocabulary, words.number), max(len(bench.vocabulary) - 1, 0))
        known = bench.vocabulary[at] == words.number if len(bench.vocabulary) else np.zeros(n, bool)
        rank = np.where(known, at + 1, 0).astype(np.uint32)
        # run[p]: how many known words of one text follow from p on
        stop = np.flatnonzero(~known | np.append(words.doc[1:] != words.doc[:-1], True)) if n else np.empty(0, np.int64)
        ends = stop + known[stop]
        run = ends[np.searchsorted(stop, np.arange(n))] - np.arange(n) if n else stop
        starts = np.flatnonzero(run >= max(bench.least, 1)) if bench.least else np.empty(0, np.int64)
        depth = np.arange(bench.window)
        suffixes = np.where(depth < run[starts][:, None], rank[np.minimum(starts[:, None] + depth, max(n - 1, 0))], 0) if len(starts) else np.empty((0, bench.window), np.uint32)
        keys = _keys(suffixes)
        order = np.argsort(keys, kind="stable")
        self.place, self.keys, self.suffixes = starts[order], keys[order], suffixes[order]

    def matches(self, bench: Benchmark) -> Iterator[tuple[int, np.ndarray]]:
        """For each benchmark window that occurs, its index and the positions where it does."""
        if not len(self.keys) or not len(bench.rows):
            return
        low = np.searchsorted(self.keys, _keys(bench.rows), side="left")
        last = bench.rows.copy()
        last[np.arange(len(last)), bench.sizes - 1] += 1  # the next sequence that doesn't begin with the window
        high = np.searchsorted(self.keys, _keys(last), side="left")
        for i in np.flatnonzero(high > low).tolist():
            yield i, self.place[low[i] : high[i]]


def _same_words(a: Words, at: np.ndarray, b: Benchmark, of: np.ndarray) -> np.ndarray:
    """Whether the words of a at positions `at` are, byte by byte, those of b at positions `of`."""
    size = a.stop[at] - a.start[at]
    same = size == b.stop[of] - b.start[of]
    size = np.where(same, size, 0)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differ = a.data[np.repeat(a.start[at], size) + step] != b.data[np.repeat(b.start[of], size) + step]
    same[np.repeat(np.arange(len(at)), size)[differ]] = False
    return same


@dataclass
class Found:
    """Of one text: hit words as sorted [from, to) pairs that don't touch, and each item's longest match (words, from, to's item position)."""

    spans: list[tuple[int, int]]
    longest: dict[str, tuple[int, int, int]]


def search(words: Words, n_texts: int, bench: Benchmark) -> list[Found | None]:
    """What one block of the benchmark has in common with each text."""
    out: list[Found | None] = [None] * n_texts
    hits = list(SuffixArray(words, bench).matches(bench))
    if not hits:
        return out
    row = np.repeat(np.array([i for i, _ in hits]), [len(x) for _, x in hits])
    place = np.concatenate([x for _, x in hits])
    size = bench.sizes[row]
    each = np.repeat(np.arange(len(row)), size)
    step = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
    same = _same_words(words, place[each] + step, bench, bench.first[row][each] + step)
    sound = np.ones(len(row), bool)
    sound[each[~same]] = False
    row, place, size = row[sound], place[sound], size[sound]
    first, owner = bench.first[row], bench.owner[row]
    # Windows that follow each other in the document and in one item are one verbatim match.
    by = np.lexsort((place, place - first, owner))
    row, place, size, first, owner = row[by], place[by], size[by], first[by], owner[by]
    if not len(row):
        return out
    new = np.append(True, (owner[1:] != owner[:-1]) | (np.diff(place - first) != 0) | (np.diff(place) != 1) | (words.doc[place[1:]] != words.doc[place[:-1]]))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    for a, b in zip(at.tolist(), last.tolist()):
        d = int(words.doc[place[a]])
        base = int(words.first[d])
        start, stop, item = int(place[a]) - base, int(place[b] + size[b]) - base, bench.ids[owner[a]]
        got = out[d] = out[d] or Found([], {})
        got.spans.append((start, stop))
        match = (start - stop, start, int(first[a] - bench.item_first[owner[a]]))
        got.longest[item] = min(got.longest.get(item, match), match)
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(items: DataFrame, block_bytes: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most block_bytes of text (an item at least), a partition at a time on the driver."""
    block: list[tuple[str, str]] = []
    held = 0
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.col("i").isNotNull()).distinct()
    for r in rows.toLocalIterator():
        size = len(r.t.encode("utf-8", "surrogatepass"))
        if block and held + size > block_bytes:
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held += size
    yield block


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, n_words, n_hit, n_items, items (sorted ids), spans (of hit words), matches, contaminated.

    matches: for each item its longest verbatim match, as (item, words, at, item_at) in word positions; the first of equally
    long ones. contaminated: n_hit > 0 and share * n_hit >= n_words. Items without an id are left out, repeated ones count
    once. Null or empty texts have no words; without items nothing is hit; an empty table gives no rows. Rows keep their
    number, also where ids repeat; other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    # A broadcast is an index of at most block_bytes of text, or of one item.
    sent = [sc.broadcast(Benchmark(block, window)) for block in benchmark_blocks(items, block_bytes)]
    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    match = T.StructType([T.StructField("item", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("words", "at", "item_at"))])
    long = ("n_words", "n_hit", "n_items")
    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in long), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(span)), T.StructField("matches", T.ArrayType(match))])

    def make():
        def f(texts: list[str]) -> dict[str, list]:
            words = Words(texts, ALNUM, LOWER)
            every: list[Found | None] = [None] * len(texts)
            for k, block in enumerate(sent):
                for d, got in enumerate(search(words, len(texts), block.value)):
                    if got and every[d]:
                        every[d] = Found(every[d].spans + got.spans, every[d].longest | {i: min(m, every[d].longest.get(i, m)) for i, m in got.longest.items()})
                    else:
                        every[d] = got or every[d]
                if k >= HELD:
                    vars(block).pop("_value", None)
            out: dict[str, list] = {n: [] for n in schema.names}
            for n, got in zip(words.count.tolist(), every):
                spans, longest = (united(got.spans), got.longest) if got else ([], {})
                out["n_words"].append(n)
                out["n_hit"].append(sum(b - a for a, b in spans))
                out["n_items"].append(len(longest))
                out["items"].append(sorted(longest))
                out["spans"].append([{"from": a, "to": b} for a, b in spans])
                out["matches"].append([{"item": i, "words": -m[0], "at": m[1], "item_at": m[2]} for i, m in sorted(longest.items())])
            return out

        return f

    found = map_text(docs, schema, make, text_col=text_col, keep=(id_col,), chunk=SHARD_CHARS)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0).cast("long")).alias("longest_match")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", longest)


ORACLE = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT item_id, p, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM bw WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), dwin AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)
), hit AS (
  SELECT d.doc_id, d.p, d.n, v.item_id, v.p AS q FROM dwin d JOIN win v ON d.n = v.n AND d.k = v.k
), longest AS (
  SELECT doc_id, max(m) AS m FROM (
    SELECT doc_id, count(*) + n - 1 AS m FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS g FROM hit)
    GROUP BY doc_id, item_id, p - q, g, n) GROUP BY doc_id
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated,
  CAST(coalesce(l.m, 0) AS BIGINT) AS longest_match
FROM dw d LEFT JOIN words h USING (doc_id) LEFT JOIN items i USING (doc_id) LEFT JOIN longest l USING (doc_id)
"""
