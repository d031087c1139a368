"""Toxicity by compression distance (operator 3).

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A document is read in overlapping windows
of `WIDTH` words, each compressed twice: with the ordinary dictionary, and with the toxic one before it. The bytes that
the toxic dictionary saves are the window's gain. Ordinary prose gains nothing, as its matches stay the same; a window
with toxic words, or with forms of them that were never seen, gains the matches that ordinary text doesn't offer.

*Training text.* Ordinary text is any text with label 0. Toxic documents are mostly ordinary prose too, so
what is toxic in them is found first: character n-grams (`GRAMS`) that far more toxic than ordinary documents have, the
most telling first, each judged on words that no earlier one explains. The words around them, document by document, are
what the toxic dictionary is trained on. Pieces of `REPEAT` words and more that another document has teach nothing a second
time, so copies of a document count once. Ordinary windows are all used: parts of them make dictionaries, which are merged.

*Score.* Two thresholds on gains are quantiles over ordinary windows (`QUANTILES`). A logistic model over the numbers of
windows beyond either, their total and largest gain and the number of windows gives the score. Thresholds and model are fitted on
documents that the dictionaries have not seen.

zstandard saves nothing on a match of a few bytes, so a character is spelled as `SPELL` fixed pseudo-random bytes.

Fitting reads every labelled row and whole texts. By a hash of the id, `FIT_SHARE` of the rows give the dictionaries, the
rest thresholds and scores. Counts are made in tables; the driver gets telling n-grams, the words that have them, those words
of each toxic document, a dictionary, and seven numbers for each document of the rest.

Null, empty and blank texts have no windows and get the score for none. Repeated rows are scored, and learned from, one
by one. An id that is labelled both 0 and 1 is left out of the fit, as are null labels. Without labelled documents of
both kinds every score is 0; without telling n-grams it is the share of toxic documents. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import doc_bucket, drop_since, map_text, mark, materialize, table
from quillon.llm.words import mixed, runs

FIT_SHARE = 0.85
WIDTH, STEP = 8, 4
SPELL = 2
#: Bytes of the dictionaries at most.
ORDINARY_BYTES, TOXIC_BYTES = 60_000, 30_000
#: Ordinary windows that one dictionary is trained on, about; dictionaries that are merged at once.
TRAINING_WINDOWS, _MERGED = 50_000, 64
GRAMS = range(4, 9)
REPEAT = 8
#: About a million n-grams are tested: so many standard deviations happen by chance in 2 of 100 million tests.
LEAST_Z = 5.5
#: How many times more often toxic documents have a telling n-gram.
LEAST_RATIO = 6.0
QUANTILES = (0.985, 0.997)
FEATURES = ("n_windows", "n_some", "n_sure", "gain", "total")

#: Words whose n-grams are in memory at once.
_PART = 20_000
_TABLE = np.random.default_rng(5).integers(0, 256, (1 << 16, SPELL), dtype=np.uint8)


def spelled(text: str) -> bytes:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[(points ^ (points >> np.uint32(16))) & np.uint32(0xFFFF)].tobytes()


def windows(text: str) -> list[bytes]:
    """The spelled windows of a text, with a space on either side."""
    words = text.lower().split()
    if not words:
        return []
    whole = spelled(f" {' '.join(words)} ")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.arange(0, max(1, len(words) - (WIDTH - STEP)), STEP)
    start = (ends[first] - [len(words[i]) + 1 for i in first.tolist()]) * SPELL
    stop = (ends[np.minimum(first + WIDTH, len(words)) - 1] + 1) * SPELL
    return [whole[a:b] for a, b in zip(start.tolist(), stop.tolist())]


def trained(samples: list[bytes], most: int) -> bytes:
    """A dictionary that zstandard trains on samples; their own bytes where they are too few for it."""
    try:
        return zstd.train_dictionary(min(most, max(256, sum(map(len, samples)))), samples, k=24 * SPELL, d=8).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-most:]


def compressor(content: bytes) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    p = zstd.ZstdCompressionParameters(
        window_log=19, hash_log=17, chain_log=17, search_log=4, min_match=6, target_length=64, strategy=zstd.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    d.precompute_compress(compression_params=p)
    return zstd.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass(frozen=True)
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    least: tuple[int, int] = (1, 1)  # gains of windows that count as some, as sure
    base: float = 0.0  # the score where there is no dictionary
    weights: tuple[float, ...] = field(default=())  # constant, then one for each of _inputs()

    def gains(self) -> Gains:
        return Gains(self)


class Gains:
    """Window gains under one model."""

    def __init__(self, model: Model):
        self.model = model
        self.plain, self.both = compressor(model.ordinary), compressor(model.toxic + model.ordinary)

    def of(self, text: str) -> np.ndarray:
        plain, both = self.plain.compress, self.both.compress
        return np.array([len(plain(w)) - len(both(w)) for w in windows(text)], np.int64)

    def counts(self, text: str) -> tuple[int, int, int, int, int]:
        """FEATURES of a text."""
        g = self.of(text)
        some, sure = self.model.least
        return len(g), int((g >= some).sum()), int((g >= sure).sum()), int(g.max(initial=0)), int(g[g >= some].sum())


def _inputs(f: np.ndarray) -> np.ndarray:
    n, some, sure, gain, total = np.asarray(f, float).T
    chance = 0.5 * np.log1p(n)  # what long texts have by chance
    return np.column_stack([np.log1p(sure), np.log1p(some), np.log1p(total), np.minimum(gain, 40) / 10, np.log1p(n), np.log1p(sure) - chance, np.log1p(some) - chance, np.log1p(total) - chance])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, decay: float = 0.3) -> np.ndarray:
    """Weights (a constant first) by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [decay] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + keep, x.T @ (w * (y - p)) - keep @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def pieces(words: list[str]) -> tuple[list[int], list[int]]:
    """Ends of pieces of a text, and a fingerprint of each.

    A piece has REPEAT words at least and ends at a word that its own hash picks, so copies of a passage have the same pieces
    but for the first and last.
    """
    ends, last = [], 0
    for i, w in enumerate(words, 1):
        if i - last >= REPEAT and zlib.crc32(w.encode("utf-8", "surrogatepass")) % 4 == 0:
            ends.append(last := i)
    if last < len(words):
        ends.append(len(words))
    cut = [" ".join(words[a:b]).encode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]
    return ends, [int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "little", signed=True) for c in cut]


def unrepeated(rows: DataFrame) -> DataFrame:
    """Rows (y, t) as (k, y, s): the words of t in lower case, without pieces that a row of smaller k, a hash of the row, has too."""
    rows = rows.withColumn("k", F.xxhash64("i", "t"))
    made = lambda: lambda texts: {"p": [pieces(t.lower().split())[1] for t in texts]}
    each = map_text(rows, T.StructType([T.StructField("p", T.ArrayType(T.LongType()))]), made, text_col="t", keep=("k",))
    each = materialize(each.select("k", F.explode(F.array_distinct("p")).alias("p")), "toxicity-pieces")
    shared = each.groupBy("p").agg(F.min("k").alias("f"), F.max("k").alias("l")).where("f < l").select("p", "f")
    gone = each.join(shared, "p").where("k > f").groupBy("k").agg(F.collect_set("p").alias("gone"))

    def kept():
        def f(texts: list[str]) -> dict[str, list]:
            out = []
            for both in texts:
                listed, _, t = both.partition("\n")
                words, gone = t.lower().split(), set(map(int, listed.split()))
                ends, marks = pieces(words) if gone else ([len(words)], [0])
                out.append(" ".join(w for a, b, m in zip([0, *ends], ends, marks) if m not in gone for w in words[a:b]))
            return {"s": out}

        return f

    sent = rows.join(gone, "k", "left").select("k", "y", F.concat(F.coalesce(F.array_join(F.col("gone").cast("array<string>"), " "), F.lit("")), F.lit("\n"), "t").alias("t"))
    return materialize(map_text(sent, T.StructType([T.StructField("s", T.StringType())]), kept, text_col="t", keep=("k", "y")), "toxicity-words")


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word and number of each word's distinct n-grams, a space on either side of the word."""
    points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    pairs = []
    for n in GRAMS:
        g = runs(mixed(points + np.uint64(n << 32)), n)
        inside = owner[: len(g)] == owner[n - 1 : n - 1 + len(g)]
        pairs.append((owner[: len(g)][inside], g[inside]))
    own, gram = (np.concatenate(x) for x in zip(*pairs))
    by = np.lexsort((gram, own))
    own, gram = own[by], gram[by]
    new = np.append(True, (own[1:] != own[:-1]) | (gram[1:] != gram[:-1]))[: len(own)]
    return own[new], gram[new]


def toxic_words(a: np.ndarray, b: np.ndarray, words: list[str], n1: int, n0: int, known: np.ndarray) -> np.ndarray:
    """Which words have a telling n-gram. a, b: the toxic and ordinary documents with each word, of n1 and n0.

    known: the n-grams that tell among all words, sorted; words are all that have one of them.
    """

    def z(k, m):
        k, m = np.minimum(k, n1), np.minimum(m, n0)
        p = (k + m) / (n1 + n0)
        out = (k / n1 - m / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        return np.where((k >= 3) & (k / n1 > LEAST_RATIO * (m + 0.5) / n0), out, 0.0)

    found = np.zeros(len(words), bool)
    parts = [range(i, min(i + _PART, len(words))) for i in range(0, len(words), _PART)]
    at_toxic = known
    if not len(words) or not len(known):
        return found

    def placed(part: range) -> tuple[np.ndarray, np.ndarray]:
        own, gram = _grams([words[i] for i in part])
        place = np.minimum(np.searchsorted(at_toxic, gram), len(at_toxic) - 1)
        keep = at_toxic[place] == gram
        return own[keep] + part.start, place[keep]

    all_a, all_b = np.zeros(len(at_toxic)), np.zeros(len(at_toxic))
    for part in parts:
        own, place = placed(part)
        all_a += np.bincount(place, weights=a[own], minlength=len(at_toxic))
        all_b += np.bincount(place, weights=b[own], minlength=len(at_toxic))
    first = z(all_a, all_b)
    telling = first > LEAST_Z
    own, place = (np.concatenate(x) for x in zip(*((o[telling[q]], q[telling[q]]) for o, q in map(placed, parts))))
    by = np.argsort(place, kind="stable")
    own, place = own[by], place[by]
    chosen = np.flatnonzero(telling)
    bounds = np.searchsorted(place, np.append(chosen, len(telling)))
    of = {int(g): own[bounds[i] : bounds[i + 1]] for i, g in enumerate(chosen.tolist())}
    heap = [(-float(first[g]), g) for g in of]
    heapq.heapify(heap)
    explained = np.zeros(len(words), bool)
    while heap:
        was, g = heapq.heappop(heap)
        left = of[g][~explained[of[g]]]
        now = float(z(a[left].sum(), b[left].sum()))
        if now <= LEAST_Z:
            continue
        if now < -was - 1e-9:
            heapq.heappush(heap, (-now, g))
            continue
        explained[left] = True
        found[left[a[left] / n1 > b[left] / n0]] = True
    return found


def _found_words(clean: DataFrame, n1: int, n0: int) -> list[str]:
    """The words with a telling n-gram: document counts of all words, then of all their n-grams, in tables."""
    each = clean.select("y", F.explode(F.array_distinct(F.split("s", " "))).alias("w")).where("w <> ''")
    words = materialize(each.groupBy("w").agg(F.sum("y").cast("long").alias("a"), F.sum(1 - F.col("y")).cast("long").alias("b")), "toxicity-vocabulary")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PART):
                some = batch.slice(at, _PART)
                own, gram = _grams(some.column(0).to_pylist())
                g, place = np.unique(gram, return_inverse=True)
                a, b = (np.bincount(place, weights=some.column(c).to_numpy()[own], minlength=len(g)).astype(np.int64) for c in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(a), pa.array(b)], names=["g", "a", "b"])

    sums = words.mapInArrow(grams, "g long, a long, b long").groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    k, m = F.least("a", F.lit(n1)) / 1.0, F.least("b", F.lit(n0)) / 1.0
    p = (k + m) / (n1 + n0)
    z = (k / n1 - m / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    telling = sums.where((F.col("a") >= 3) & (k / n1 > LEAST_RATIO * (m + 0.5) / n0)).where(z > LEAST_Z).select("g").toArrow()  # a few thousand
    known = np.sort(telling.column("g").to_numpy().view(np.uint64))
    if not len(known):
        return []
    sent = clean.sparkSession.sparkContext.broadcast(known)

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PART):
                some = batch.slice(at, _PART)
                own, gram = _grams(some.column(0).to_pylist())
                yield some.take(pa.array(np.unique(own[np.isin(gram, sent.value)])))

    rows = sorted(map(tuple, words.mapInArrow(having, words.schema).collect()))
    names = [r[0] for r in rows]
    found = toxic_words(np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), names, n1, n0, known)
    return [w for w, yes in zip(names, found) if yes]


def _ordinary(clean: DataFrame) -> bytes:
    """A dictionary of all ordinary windows: of each part of TRAINING_WINDOWS or so, then of up to _MERGED dictionaries' contents at a time."""
    total = clean.agg(F.sum(F.size(F.split("s", " ")))).first()[0] or 0
    n = max(1, int(total) // (TRAINING_WINDOWS * WIDTH))

    def part(t: pa.Table) -> pa.Table:
        docs = [x.split() for _, x in sorted(zip(t.column("k").to_pylist(), t.column("s").to_pylist()))]
        good = [spelled(f" {' '.join(d[i : i + WIDTH])} ") for d in docs for i in range(0, len(d), WIDTH)]
        return pa.table({"n": [t.column("n")[0].as_py()], "d": pa.array([trained(good, ORDINARY_BYTES)], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        got = [d for _, d in sorted(zip(t.column("m").to_pylist(), t.column("d").to_pylist()))]
        cut = [d[i : i + 24 * SPELL] for d in got for i in range(0, len(d), 24 * SPELL)]
        return pa.table({"n": [t.column("n")[0].as_py()], "d": pa.array([trained(cut, ORDINARY_BYTES) if len(got) > 1 else got[0]], pa.binary())})

    found = clean.withColumn("n", F.pmod("k", F.lit(n))).groupBy("n").applyInArrow(part, "n long, d binary")
    while n > 1:
        found, n = materialize(found, "toxicity-dictionaries"), -(-n // _MERGED)
        found = found.select(F.col("n").alias("m"), F.floor(F.col("n") / _MERGED).alias("n"), "d").groupBy("n").applyInArrow(merge, "n long, d binary")
    return bytes(found.first().d)


def dictionaries(rows: DataFrame) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of all rows (i, y, t); the toxic one is empty where no n-gram is telling."""
    clean = unrepeated(rows)
    sizes = {r.y: r.n for r in clean.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return b"", b""
    found = _found_words(clean, sizes[1], sizes[0])
    if not found:
        return b"", b""
    sent = clean.sparkSession.sparkContext.broadcast(frozenset(found))
    make = lambda: lambda texts: {"b": [" ".join(dict.fromkeys(w for w in t.split(" ") if w in sent.value)) for t in texts]}
    bad = map_text(clean.where("y = 1"), T.StructType([T.StructField("b", T.StringType())]), make, text_col="s", keep=("k",)).where("b <> ''")
    bad = [spelled(f" {r.b} ") for r in sorted(bad.collect())]  # the telling words of each toxic document
    return _ordinary(clean.where("y = 0")), trained(bad, TOXIC_BYTES)


def _counted(rows: DataFrame, model: Model, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """FEATURES of each row's text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def make():
        gains = sent.value.gains()
        return lambda texts: dict(zip(FEATURES, map(list, zip(*map(gains.counts, texts)))))

    return map_text(rows, T.StructType([T.StructField(n, T.LongType()) for n in FEATURES]), make, text_col=text_col, keep=keep)


def _gain_quantiles(rows: DataFrame, model: Model, text_col: str) -> tuple[int, int]:
    """The gains that QUANTILES of the windows of rows don't exceed, plus one."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        gains = sent.value.gains()

        def f(texts: list[str]) -> dict[str, list]:
            each = [np.unique(np.maximum(gains.of(t), 0), return_counts=True) for t in texts]
            return {"g": [g.tolist() for g, _ in each], "n": [n.tolist() for _, n in each]}

        return f

    schema = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in "gn"])
    found = map_text(rows.withColumn("_", F.lit(0)), schema, make, text_col=text_col, keep=("_",))
    each = found.select(F.explode(F.arrays_zip("g", "n")).alias("x")).groupBy("x.g").agg(F.sum("x.n").alias("n")).orderBy("g").collect()
    if not each:
        return 1, 1
    up = np.cumsum([r.n for r in each]) / sum(r.n for r in each)
    some, sure = (int(each[int(np.searchsorted(up, q - 1e-12))].g) + 1 for q in QUANTILES)
    return some, max(sure, some)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from docs and the labels (id, 0 or 1) of some of them; every labelled row and its whole text is read."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    known = known.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("i", "y")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    u = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("part")), F.lit(1_000_000)) / 1_000_000
    told = known.select("i", "y", (u < FIT_SHARE).alias("first"))  # two numbers a label
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(told), "i")
    since = mark()
    rows = materialize(rows, "toxicity-labelled")
    base = round(sizes[1] / (sizes[0] + sizes[1]), 6)
    try:
        plain, bad = dictionaries(rows.where("first"))
        if not bad:
            return Model(base=base)
        rest = rows.where("not first")
        model = Model(plain, bad)
        model = Model(plain, bad, _gain_quantiles(rest.where("y = 0"), model, "t"))
        seen = _counted(rest, model, ("y",), "t").groupBy("y", *FEATURES).agg(F.count("*").alias("n")).orderBy("y", *FEATURES).toArrow()  # seven numbers a document at most
    finally:
        drop_since(since)
    y, n = (seen.column(c).to_numpy().astype(float) for c in ("y", "n"))
    if len(set(y.tolist())) < 2:
        return Model(base=base)
    x = _inputs(np.column_stack([seen.column(c).to_numpy() for c in FEATURES]))
    return Model(plain, bad, model.least, base, tuple(_logistic(x, y, n).tolist()))


def toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_windows, n_some, n_sure (windows past either threshold), gain (the largest), total (of n_some), score (0 to 1).

    Rows keep their number; other columns are not read.
    """
    if not model.weights:
        none = [F.lit(0).cast("long").alias(n) for n in FEATURES]
        return docs.select(id_col, *none, F.lit(float(model.base)).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        gains, b = model.gains(), np.array(model.weights)

        def f(texts: list[str]) -> dict[str, list]:
            got = np.array([gains.counts(t) for t in texts])
            logit = b[0] + _inputs(got) @ b[1:]
            return {**{n: got[:, k].tolist() for k, n in enumerate(FEATURES)}, "score": (1 / (1 + np.exp(-np.clip(logit, -30, 30)))).round(6).tolist()}

        return f

    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in FEATURES), T.StructField("score", T.DoubleType())])
    return map_text(docs, schema, make, text_col=text_col, keep=(id_col,))


def held_out(id_col: str = "doc_id") -> Column:
    return doc_bucket(id_col, 4) == 2


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
