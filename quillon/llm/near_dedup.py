"""Near-duplicate classes by BagMinHash (operator 9).

Texts are multisets of five-word shingles (words: runs of other characters than white space, unchanged; a text of fewer
words is one shingle). Similarity is weighted Jaccard: the sum of smaller counts over the sum of larger ones.

*Signatures.* Each shingle is a set of Poisson processes in time, one for each block of weight levels 1, 2-3, 4-7, ... of
a rate that equals the block's size. A point carries a register and a level and counts if the shingle's weight reaches
that level; a register keeps its first point's time. Two texts agree in a register with a probability that equals their
weighted Jaccard similarity. Processes are followed only up to the time by which all registers of a text are filled.

*Classes.* Texts with equal words are one class from the start. Registers form bands; texts that share a band are
candidates: all pairs of a bucket up to `SMALL` texts, otherwise each with the bucket's leading text, the one that is in
the largest buckets by most bands. Every candidate pair is verified on exact multisets. The texts of large buckets in
which some text is joined to the leader by no chain of links go through an exact join on their rarest shingles, which
yields all their pairs of similarity 0.8 that links don't connect yet; these are verified in turn. Verified links are
contracted to classes, named by their smallest id. Nothing that shares a band stays uncompared and unconnected; where very
many texts of different classes have even their rarest shingles in common, the join's candidates grow with their square.

With bands of 7 registers and 64 bands, a pair of similarity 0.8 shares no band with probability 3e-7.

Joins whose sides both grow with the corpus are merge joins at every size, so that small runs tell how large ones grow.

Texts without words have no shingles and are classes of their own, as are null texts. A row without an id is in the class
of a row with equal words, otherwise in none (null). Rows that
repeat an id are one document; of different texts the one with the smallest digest stands for it, of texts with words first. Ties (equal times of
points, equal weights of leading texts) are broken by number and id, so a run can be repeated. An empty table gives no rows;
texts may be of any length. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import map_text, materialize, table, text_chunks
from quillon.llm.words import NONSPACE, Words, mixed, runs

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 64
ROWS = 7
#: Buckets up to this size are compared in all pairs.
SMALL = 12
#: Cells in which shingles are counted to tell common ones from rare ones: 2 ** SKETCH_BITS.
SKETCH_BITS = 20
#: Links that one task may contract.
ONE_TASK = 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """First times of n multisets: (n, registers). owner, element, weight: the multisets' distinct elements; each has some."""
    levels = np.floor(np.log2(weight)).astype(np.int64)
    rep = np.repeat(np.arange(len(owner)), levels + 1)
    block = np.arange(len(rep)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    own, w = owner[rep], weight[rep]
    with np.errstate(over="ignore"):
        seed = mixed(element[rep] + block.astype(np.uint64) * _GOLD)
    rate = np.exp2(block.astype(float))
    time, number = np.zeros(len(rep)), np.zeros(len(rep), np.uint64)
    first = np.full(n * registers, np.inf)
    until = np.full(n, np.inf)
    while len(own):
        many = int(max(1, min(512, 300_000 // len(own))))
        with np.errstate(over="ignore"):
            j = number[:, None] + np.arange(1, many + 1, dtype=np.uint64)
            h = mixed(seed[:, None] + j * _GOLD)
            g = mixed(h + _GOLD)
        step = -np.log((h >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate[:, None]
        step[:, 0] += time
        t = np.cumsum(step, axis=1)  # adds one by one, so a point's time doesn't depend on `many`
        level = (1 + (g >> np.uint64(40)).astype(float) * 2.0**-24) * rate[:, None]
        ok = (t < until[own][:, None]) & (np.floor(level) <= w[:, None])
        cell = (own[:, None] * registers + (g & np.uint64(0xFFFFFF)).astype(np.int64) % registers)[ok]
        np.minimum.at(first, cell, t[ok])
        active = np.unique(own)
        until[active] = first.reshape(n, registers)[active].max(axis=1)
        time, number = t[:, -1], number + np.uint64(many)
        go = time < until[own]
        own, w, seed, rate, time, number = own[go], w[go], seed[go], rate[go], time[go], number[go]
    return first.reshape(n, registers)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, number and count of each text's distinct shingles."""
    number = runs(words.number, size)
    owner = words.doc[: len(number)]
    whole = words.doc[size - 1 :] == owner if len(number) else np.empty(0, bool)
    owner, number = owner[whole], number[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    with np.errstate(over="ignore"):
        for d in short.tolist():
            own = words.number[words.first[d] : words.first[d] + words.count[d]]
            owner, number = np.append(owner, d), np.append(number, runs(own, len(own)) + np.uint64(len(own)))
    by = np.lexsort((number, owner))
    owner, number = owner[by], number[by]
    new = np.append(True, (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])) if len(owner) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return owner[at], number[at], np.diff(np.append(at, len(owner)))


def band_keys(texts: list[str], size: int, bands: int, rows: int) -> tuple[list[bytes], list[list[int]], list[int]]:
    """Of each text: a digest of its words, a key for each band (none without words), and its number of shingles."""
    words = Words(texts, NONSPACE)
    owner, number, weight = shingles(words, size)
    some = np.flatnonzero(words.count > 0)
    # bytes.split() cuts at the same white space
    digests = [hashlib.blake2b(b" ".join(t.encode("utf-8", "surrogatepass").split()), digest_size=16).digest() for t in texts]
    keys: list[list[int]] = [[] for _ in texts]
    if len(some):
        place = np.zeros(len(texts), np.int64)
        place[some] = np.arange(len(some))
        sig = signatures(place[owner], number, weight, len(some), bands * rows).view(np.uint64).reshape(len(some), bands, rows)
        with np.errstate(over="ignore"):
            k = np.arange(bands, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.zeros((len(some), 1), np.uint64)
            for r in range(rows):
                k = mixed(k * np.uint64(0x9FB21C651E98DF25) + sig[:, :, r])
        for i, d in enumerate(some.tolist()):
            keys[d] = k[i].view(np.int64).tolist()
    totals = np.bincount(owner, weights=weight, minlength=len(texts)).astype(np.int64)
    return digests, keys, totals.tolist()


def _digests():
    return lambda texts: {"digest": [hashlib.blake2b(b" ".join(t.encode("utf-8", "surrogatepass").split()), digest_size=16).digest() for t in texts]}


def similarity(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    either = sum(a.values()) + sum(b.values()) - common
    return common / either if either else 0.0


def multiset(text: str, size: int) -> Counter:
    w = text.encode("utf-8", "surrogatepass").split()
    if not w:
        return Counter()
    return Counter(zip(*(w[k:] for k in range(size)))) if len(w) >= size else Counter([tuple(w)])


def verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) with their exact similarity. texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, Counter] = (None, Counter())
        for batch in batches:
            ids_a, ids_b, ta, tb = (batch.column(i) for i in range(4))
            sims = []
            for i in range(batch.num_rows):
                if held[0] != (x := ids_a[i].as_py()):
                    held = (x, multiset(ta[i].as_py(), size))
                sims.append(similarity(held[1], multiset(tb[i].as_py(), size)))
            yield pa.RecordBatch.from_arrays([ids_a, ids_b, pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")).hint("merge"), "b")
    with_both = with_b.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")).hint("merge"), "a").select("a", "b", "ta", "tb")
    kind = pairs.schema["a"].dataType.simpleString()
    return with_both.mapInArrow(run, f"a {kind}, b {kind}, sim double")


def small_pairs(m: DataFrame) -> DataFrame:
    """All pairs (a < b) of buckets of at most SMALL texts. m: key, id."""
    small = m.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    within = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return small.select(F.explode(within).alias("p")).select("p.a", "p.b").where("a <> b")


def links(reps: DataFrame, docs: DataFrame, *, least: float = SIMILARITY, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Verified links (a < b, sim) that connect all candidates of similarity `least` or more, and their components' roots.

    reps: id, bands; docs: id, t. Pairs that links already connect are not compared.
    """
    members = reps.select("id", F.explode("bands").alias("key"))
    sizes = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = materialize(members.join(sizes.hint("merge"), "key"), "members")
    # A text that is in the largest buckets by most bands is at the centre of its copies: it leads its buckets.
    weight = members.where(F.col("n") > SMALL).groupBy("id").agg(F.sum("n").alias("weight"))
    large = materialize(members.where(F.col("n") > SMALL).join(weight, "id"), "large")
    lead = large.groupBy("key").agg(F.min_by("id", F.struct(-F.col("weight"), "id")).alias("lead"))
    led = materialize(large.join(lead, "key").where("id <> lead").select("key", "lead", "id", "n", "weight"), "led")
    pairs = small_pairs(members.where(F.col("n") <= SMALL)).unionByName(led.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")))
    pairs = materialize(pairs.distinct(), "pairs")
    # Later rounds compare texts of the first one only.
    texts = materialize(docs.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().hint("merge"), "id", "left_semi"), "texts")
    known = materialize(verified(pairs, texts, size), "similarities")
    roots = materialize(components(known.where(F.col("sim") >= least).select("a", "b")), "roots")
    far = led.withColumns({"a": F.least("id", "lead"), "b": F.greatest("id", "lead")}).join(known, ["a", "b"]).select("key", "lead", "id", "n", "weight", (1 - F.col("sim")).alias("d"))
    # Large buckets with texts that no chain of links joins to the leader are taken apart by further bands.
    now = _with_roots(far, roots).withColumn("open", F.col("root") != F.col("lead_root"))
    broken = now.where("open").select("key").distinct()
    rest = materialize(now.join(broken, "key", "left_semi").select("id", "root").distinct(), "rest")
    if rest.take(1):
        more = prefix_pairs(texts.join(rest.hint("merge"), "id"), least=least, size=size).join(known.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        known = known.unionByName(materialize(verified(materialize(more, "more-pairs"), texts, size), "similarities"))
        roots = materialize(components(known.where(F.col("sim") >= least).select("a", "b")), "roots")
    return known.where(F.col("sim") >= least), roots


def _elements(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of each shingle, the k-th of equal ones as an element of its own: weighted Jaccard is that of these sets."""
    owner, number, weight = shingles(Words(texts, NONSPACE), size)
    rep = np.repeat(np.arange(len(owner)), weight)
    k = np.arange(len(rep)) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        return owner[rep], mixed(number[rep] + k.astype(np.uint64) * _GOLD)


def _cell(element: np.ndarray) -> np.ndarray:
    return (element >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix_pairs(texts: DataFrame, *, least: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Candidates (a < b) of different roots, all pairs of similarity `least` or more among them. texts: id, t, root.

    Elements are ordered by how many texts have one of their cell, rare ones first: any order gives all pairs, this one few
    candidates. Of two texts the one with fewer elements has at least 2s / (1 + s) of its own in common with a text of
    similarity s, the other one at least s; so the first of the common ones is among the first 1 - 2s / (1 + s) of the
    smaller text's and the first 1 - s of the larger one's, with enough elements behind it in both.
    """
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, some in text_chunks(batch, "t"):
                n += np.bincount(_cell(_elements(some, size)[1]), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    counted = texts.select("t").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(1 << SKETCH_BITS, np.int64)  # counts beyond 2 ** 32 wrap: only the order of rare and common suffers
    common[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(common.astype(np.uint32))

    def make():
        def f(some: list[str]) -> dict[str, list]:
            owner, element = _elements(some, size)
            by = np.lexsort((element, sent.value[_cell(element)], owner))
            owner, element = owner[by], element[by]
            total = np.bincount(owner, minlength=len(some))
            n = total[owner]
            place = np.arange(len(owner)) - (np.cumsum(total) - total)[owner]
            keep = place <= n - np.ceil(least * n - 1e-6)
            bounds = np.searchsorted(owner[keep], np.arange(1, len(some)))
            return {"n": total.tolist(), "first": np.split(element[keep].view(np.int64), bounds)}

        return f

    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("first", T.ArrayType(T.LongType()))])
    first = map_text(texts, schema, make, text_col="t", keep=("id", "root"))
    first = materialize(first.select("id", "root", "n", F.posexplode("first").alias("place", "element")), "prefixes")
    sent.destroy()  # workers would hold it on
    small = first.where(F.col("place") <= F.col("n") - F.ceil(2 * least / (1 + least) * F.col("n") - 1e-6))
    x = small.select("element", *(F.col(c).alias(f"{c}_x") for c in ("id", "root", "n", "place")))
    y = first.select("element", *(F.col(c).alias(f"{c}_y") for c in ("id", "root", "n", "place")))
    behind = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    pairs = x.join(y.hint("merge"), "element").where(
        (F.col("root_x") != F.col("root_y")) & (F.struct("n_x", "id_x") < F.struct("n_y", "id_y")) & (F.col("n_x") >= least * F.col("n_y") - 1e-6)
        & (behind >= least / (1 + least) * (F.col("n_x") + F.col("n_y")) - 1e-6)
    )
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Columns root (of id) and lead_root (of lead)."""
    own = roots.select("id", "root")
    led = roots.select(F.col("id").alias("lead"), F.col("root").alias("lead_root"))
    return rows.join(own, "id", "left").join(led, "lead", "left").withColumn("root", F.coalesce("root", "id")).withColumn("lead_root", F.coalesce("lead_root", "lead"))


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """The smallest id of each id's component, for ids other than it (id, root). edges: a, b.

    Up to `one_task` edges are contracted by a union-find in one task; more of them by large and small stars, a few rounds
    of joins over all executors. Either gives the same rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    if edges.count() <= one_task:
        return _union_find(edges)
    edges = materialize(edges.distinct(), "edges")
    state = None
    while True:
        # Large star: larger neighbours of a node go to its smallest one. Small star: smaller ones and the node itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(materialize(least, "least"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = materialize(edges, "edges")
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now


def _union_find(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(up, up)
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(u), find(v)
                if x != y:
                    root[max(x, y)] = min(x, y)
        out = [(x, r) for x in root if (r := find(x)) != x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], kind), pa.array([r for _, r in out], kind)], names=["id", "root"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"id {kind}, root {kind}")


def near_classes(docs: DataFrame, *, least: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, class_id (the smallest id of its class), n_shingles."""

    def make():
        def f(texts: list[str]) -> dict[str, list]:
            digest, keys, n = band_keys(texts, size, bands, rows)
            return {"digest": digest, "bands": keys, "n_shingles": n}

        return f

    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("n_shingles", T.LongType())])
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    base = materialize(map_text(named, schema, make, text_col="t", keep=("id",)), "signatures")
    texts = named.select("id", F.coalesce("t", F.lit("")).alias("t"))
    full = base.where("n_shingles > 0 and id is not null")
    rank = F.struct((F.col("n_shingles") == 0).alias("empty"), "digest")
    several = base.where("id is not null").groupBy("id").agg(F.min(rank).alias("a"), F.max(rank).alias("b")).where("a.digest <> b.digest")
    if several.take(1):
        several = materialize(several.select("id", "a.digest"), "repeated-ids")
        full = full.join(several.select("id"), "id", "left_anti").unionByName(full.join(several, ["id", "digest"], "left_semi"))
        told = map_text(texts.join(several.select("id"), "id", "left_semi"), T.StructType([T.StructField("digest", T.BinaryType())]), _digests, text_col="t", keep=("id", "t"))
        texts = texts.join(several.select("id"), "id", "left_anti").unionByName(told.join(several, ["id", "digest"], "left_semi").select("id", "t").distinct())
        chosen = several.withColumnRenamed("digest", "_chosen")
        base = base.join(chosen, "id", "left").withColumn("digest", F.coalesce("_chosen", "digest")).drop("_chosen")
    first = materialize(full.groupBy("digest").agg(F.min("id").alias("rep")), "representatives")
    reps = full.join(first.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").select("id", "bands")
    _, roots = links(reps, texts, least=least, size=size)
    of_rep = first.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    of_rep = materialize(of_rep, "classes")
    return base.select("id", "digest", "n_shingles").join(of_rep.hint("merge"), "digest", "left").select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("class_id"), "n_shingles")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
