"""Queries that fit models; rows only, as SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import basic_features
from quillon.operators import models as M
from quillon.operators.evaluation import stratified_folds
from quillon.operators.clusters import density_clusters
from quillon.operators.ranges import settled
from quillon.plans.register import query
from quillon.plans.text_queries import docs
from quillon.sources.tables import table

FEATURES = ["n_chars", "n_words", "n_sentences", "avg_word_len", "lexical_diversity"]


def labelled(spark, sf_dir) -> DataFrame:
    f = basic_features(F.col("text"))
    d = docs(spark, sf_dir).select("doc_id", *(f[k].cast("double").alias(k) for k in FEATURES))
    return settled(stratified_folds(d.join(table(spark, sf_dir, "labels"), "doc_id"), "doc_id", "quality", 3).select("doc_id", "quality", "fold", *FEATURES))


def _cv(kind):
    return lambda spark, sf_dir: M.cross_validated(labelled(spark, sf_dir), kind, FEATURES, "quality", "fold", 3)


query("lr_cv")(_cv("logistic"))
query("gbt_cv")(_cv("boosted_trees"))
query("svc_cv")(_cv("linear_svc"))
query("rf_cv")(_cv("random_forest"))
query("tree_cv")(_cv("decision_tree"))
query("bayes_cv")(_cv("naive_bayes"))
query("mlp_cv")(_cv("perceptron"))
query("fm_cv")(_cv("factorisation"))


@query("model_selection")
def model_selection(spark, sf_dir):
    """Mean area over the folds of each kind of classifier, best first."""
    data = labelled(spark, sf_dir)
    out = None
    for kind in ("logistic", "decision_tree", "random_forest", "naive_bayes"):
        row = M.cross_validated(data, kind, FEATURES, "quality", "fold", 3).agg(F.lit(kind).alias("kind"), F.round(F.avg("auc"), 6).alias("mean_auc"), F.count("auc").alias("n_folds"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("mean_auc"), "kind")


@query("feature_importances")
def feature_importances(spark, sf_dir):
    return M.importances(labelled(spark, sf_dir), "random_forest", FEATURES, "quality")


@query("multi_class_boosted")
def multi_class_boosted(spark, sf_dir):
    """Macro scores, on one fold, of boosted trees that tell languages by sizes of texts."""
    from quillon.operators.evaluation import macro_scores

    f = basic_features(F.col("text"))
    d = docs(spark, sf_dir).where("lang is not null").select("doc_id", "lang", *(f[k].cast("double").alias(k) for k in FEATURES))
    d = settled(d.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(4))))
    return macro_scores(M.multi_class(d, FEATURES, "lang", "fold"), "lang", "prediction")


@query("aft_by_fold")
def aft_by_fold(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").alias("price"),
        (F.col("p_partkey") % 3 != 0).cast("int").alias("event"), (F.crc32(F.col("p_partkey").cast("string").cast("binary")) % 5).alias("fold"))
    return M.aft_by_fold(p, ["price"], "p_size", "event", "fold", 5)


@query("ridge_leave_one_out")
def ridge_leave_one_out(spark, sf_dir):
    return M.ridge_leave_one_out(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"])


@query("svd_embed")
def svd_embed(spark, sf_dir):
    return M.truncated_svd(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 5)


@query("pca_embed_50")
def pca_embed_50(spark, sf_dir):
    return M.principal_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 50)


@query("mahalanobis_outliers", """WITH x AS (SELECT o_orderkey, o_totalprice AS a, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS b FROM orders),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS saa, var_samp(b) AS sbb, covar_samp(a, b) AS sab FROM x)
SELECT o_orderkey, round((pow(a - ma, 2) * sbb - 2 * (a - ma) * (b - mb) * sab + pow(b - mb, 2) * saa) / (saa * sbb - sab * sab), 6) AS distance FROM x, m""")
def mahalanobis_outliers(spark, sf_dir):
    return M.mahalanobis(table(spark, sf_dir, "orders").withColumn("day", F.unix_date(F.to_date("o_orderdate"))), "o_orderkey", ["o_totalprice", "day"]).withColumn("distance", F.round("distance", 6))


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    return M.isolation_scores(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"])


@query("knn_classify",
    """WITH d AS (SELECT q.vec_id AS q, t.vec_id AS i, t.label AS y, list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))) AS d FROM embeddings q JOIN embeddings t ON q.vec_id % 20 = 0 AND t.vec_id % 20 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, i) AS r FROM d), v AS (SELECT q, y, count(*) AS n FROM k WHERE r <= 5 GROUP BY q, y) SELECT q AS vec_id, arg_min(y, (-n, y)) AS prediction FROM v GROUP BY q""")
def knn_classify(spark, sf_dir):
    """Majority label of the five nearest vectors, for every vector whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].alias(f"e{i}") for i in range(64)))
    return M.nearest_neighbours(e.where("vec_id % 20 <> 0"), e.where("vec_id % 20 = 0"), "vec_id", [f"e{i}" for i in range(64)], "label", 5)


@query("cluster_sizes")
def cluster_sizes(spark, sf_dir):
    """Clusters of error patterns by size, and the five suppliers with the smallest ids in each as examples."""
    c = dbscan_error_clusters(spark, sf_dir)
    w = Window.partitionBy("cluster").orderBy("s_suppkey")
    top = c.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("s_suppkey")), ",").alias("examples"))
    return c.groupBy("cluster").agg(F.count("*").alias("n")).join(F.broadcast(top), "cluster")  # a row for each cluster


@query("pca_embed")
def pca_embed(spark, sf_dir):
    return M.principal_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 3)


@query("aft_survival")
def aft_survival(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").alias("price"),
        (F.col("p_partkey") % 3 != 0).cast("int").alias("event"))
    return M.aft(p, ["price"], "p_size", "event").select("p_partkey", F.round("prediction", 6).alias("prediction"))


@query("ridge_held_out")
def ridge_held_out(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"), F.col("p_partkey").cast("double").alias("k"),
        F.col("p_retailprice").alias("price"), (F.crc32(F.col("p_partkey").cast("string").cast("binary")) % 4).alias("fold"))
    return M.ridge_held_out(p, ["p_size", "k"], "price", "fold", 4)


@query("dbscan_error_clusters")
def dbscan_error_clusters(spark, sf_dir):
    """Density clusters of suppliers' error patterns: vectors of -1, 0 and 1, cosine distance at most 0.3, two to a cluster."""
    s = F.col("s_suppkey")
    v = F.array(*((s % m % 3 - 1).cast("double") for m in (5, 7, 11, 13)))
    return density_clusters(table(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v")), "s_suppkey", "v", 0.3, 2)
