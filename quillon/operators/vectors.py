"""Vectors: term weights, cosine similarity and retrieval, overlap scores, clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import word_tokens
from quillon.operators.nearest import nearest, pairs_within
from quillon.operators.ranges import settled


#: Directions along which close_pairs() cuts.
_AXES = 4


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def term_counts(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, term, tf)."""
    return docs.select(id_col, F.explode(word_tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def tfidf(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, term, weight): tf times the smooth idf ln((1 + n) / (1 + df)) + 1, scaled to unit length by document."""
    tf = term_counts(docs, id_col, text_col)
    n = docs.agg(F.count("*").alias("n"))  # one row
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", (F.ln((1.0 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(df, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("w") / length).alias("weight"))


def all_pairs_in_blocks(vectors: DataFrame, queries: DataFrame, block: int = 256) -> DataFrame:
    """Cosine of every query with every vector: (query_id, vec_id, sim). The queries are a stated set.

    Queries travel in blocks of `block`; each vector meets a block at a time, so no task holds all of them.
    """
    q = queries.select(F.col("vec_id").alias("query_id"), doubles(F.col("embedding")).alias("q")).withColumn("qn", norm(F.col("q")))
    blocks = q.groupBy(F.floor(F.col("query_id") / (block * 20)).alias("block")).agg(F.collect_list(F.struct("query_id", "q", "qn")).alias("qs"))
    v = vectors.select("vec_id", doubles(F.col("embedding")).alias("v")).withColumn("vn", norm(F.col("v")))
    met = v.join(blocks)  # a stated query set, in blocks
    sims = F.transform("qs", lambda s: F.struct(s["query_id"].alias("query_id"), F.try_divide(dot(s["q"], F.col("v")), s["qn"] * F.col("vn")).alias("sim")))
    return met.select("vec_id", F.explode(sims).alias("s")).select("s.query_id", "vec_id", "s.sim")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k vectors nearest to every query by rounded cosine, then id, without the query's own id: (query_id, vec_id, sim, place)."""
    v = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), F.lit(None).cast("int").alias("y"), F.col("embedding").alias("v"))
    near = nearest(v(vectors), v(queries).drop("y"), k, cosine=True, but_itself=True)
    near = near.select(F.col("q").alias("query_id"), F.col("id").alias("vec_id"), F.round("score", digits).alias("sim"))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams as strings; none where there are fewer tokens."""
    made = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def set_scores(found: Column, truth: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two arrays taken as sets; 0 where undefined."""
    both = F.size(F.array_intersect(found, truth))
    p = F.coalesce(F.try_divide(both.cast("double"), F.size(found)), F.lit(0.0))
    r = F.coalesce(F.try_divide(both.cast("double"), F.size(truth)), F.lit(0.0))
    f = F.coalesce(F.try_divide(2.0 * both, F.size(found) + F.size(truth)), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": f}


# Words without a meaning of their own.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with",
)
# End of fixed values.


def hashed_terms(docs: DataFrame, id_col: str, bits: int = 18, text_col: str = "text") -> DataFrame:
    """Sparse entries (id, slot, value) of signed hashed term counts, each document of unit length; zeros have no entry."""
    h = F.md5(F.col("term"))
    slot = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % (1 << bits)
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") >= 8, -1).otherwise(1)
    v = term_counts(docs, id_col, text_col).groupBy(id_col, slot.alias("slot")).agg(F.sum(F.col("tf") * sign).cast("double").alias("v")).where("v <> 0")
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id_col)))
    return v.select(id_col, "slot", (F.col("v") / length).alias("value"))


def vocabulary(docs: DataFrame, id_col: str, most: int, least_docs: int, text_col: str = "text") -> DataFrame:
    """Terms of one or two words without stop words: n, df and smooth idf of the `most` frequent that `least_docs` documents have."""
    t = docs.select(id_col, F.filter(word_tokens(F.col(text_col)), lambda x: ~x.isin(*STOP_WORDS)).alias("t"))
    two = F.when(F.size("t") > 1, F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a,
        b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    each = t.select(id_col, F.explode(F.concat(F.col("t"), two)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("k"))
    f = each.groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("df")).where(F.col("df") >= least_docs)
    n = docs.agg(F.count("*").alias("n_docs"))  # one row
    top = f.orderBy(F.desc("n"), "term").limit(most)
    return top.join(F.broadcast(n)).select("term", "n", "df", F.round(F.ln((1.0 + F.col("n_docs")) / (1 + F.col("df"))) + 1, 6).alias("idf"))


def close_pairs(unit: DataFrame, least: float) -> DataFrame:
    """All pairs a < b of unit vectors (id, v) with a cosine of `least` or more: (a, b, sim). Exact.

    Unit vectors of a cosine c are sqrt(2 - 2c) apart, and so, at most, are their projections on any direction. Vectors are
    cut into cells of that width along `_AXES` fixed random directions; a pair lies in the same or in neighbouring cells on
    every axis, so one side is sent to the neighbours too and pairs meet in an equi-join on cells.
    """
    far = math.sqrt(2 - 2 * least) * (1 + 1e-9)
    size = unit.select(F.max(F.size("v"))).first()[0] or 0
    axes = np.linalg.qr(np.random.default_rng(3).normal(size=(max(size, _AXES), _AXES)))[0].T[:, :size].tolist()
    cells = [F.floor(dot(F.col("v"), F.array(*map(F.lit, a))) / far).cast("int") for a in axes]
    celled = unit.select("id", "v", F.array(*cells).alias("c"))
    around = celled
    for k in range(_AXES):
        near = F.array(*(F.array(*(F.col("c")[i] + (d if i == k else 0) for i in range(_AXES))) for d in (-1, 0, 1)))
        around = around.withColumn("c", F.explode(near))
    a = celled.select(F.col("id").alias("a"), F.col("v").alias("_va"), "c")
    b = around.select(F.col("id").alias("b"), F.col("v").alias("_vb"), "c")
    met = a.join(b, "c").where(F.col("a") < F.col("b"))
    return met.select("a", "b", dot(F.col("_va"), F.col("_vb")).alias("sim")).where(F.col("sim") >= least)


def similar_pairs(vectors: DataFrame, least: float, label: str, digits: int = 6) -> DataFrame:
    """All pairs a < b of different labels with a cosine of `least` or more: (a, b, n_a, n_b, sim).

    Rows of equal vector and label are one class, named by its smallest id, of n rows: a vector that very many rows share is
    compared once, and no link between different ones is lost. Zero vectors have no cosine.
    """
    classes = vectors.groupBy(doubles(F.col("embedding")).alias("v"), F.col(label).alias("y")).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = settled(classes)
    of = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"))
    met = pairs_within(classes.select("id", "y", "v"), least).join(of("a"), "a").join(of("b"), "b")
    return met.select("a", "b", "n_a", "n_b", F.round("sim", digits).alias("sim"))


def bleu(found: Column, truth: Column, most: int) -> Column:
    """Geometric mean of clipped n-gram precisions (n up to `most`, each smoothed by one) times the brevity penalty."""

    def every(t: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, made).otherwise(F.array().cast("array<string>"))

    logs = F.lit(0.0)
    for n in range(1, most + 1):
        g, h = every(found, n), every(truth, n)
        count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
        hits = F.aggregate(F.array_distinct(g), F.lit(0), lambda s, x: s + F.least(count(g, x), count(h, x)))  # noqa: B023
        logs = logs + F.ln((1 + hits) / (1.0 + F.size(g)))
    short = F.when(F.size(found) < F.size(truth), F.exp(1 - F.size(truth) / F.size(found))).otherwise(1.0)
    return short * F.exp(logs / most)
