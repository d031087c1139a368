"""Density clustering of patterns (DBSCAN) over vectors that take few distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranges import settled
from quillon.operators.vectors import close_pairs, norm


def density_clusters(rows: DataFrame, id_col: str, vector: str, eps: float, least: int) -> DataFrame:
    """Per row: id and cluster (smallest id in it), -1 for noise. Cosine distance; a zero vector is near its equals only.

    Equal vectors are one point with a weight: the neighbourhood join is over distinct vectors, which meet in cells
    (close_pairs). Labels spread until none changes.
    """
    points = rows.groupBy(F.col(vector).alias("v")).agg(F.min(id_col).alias("id"), F.count("*").alias("n"))
    points = settled(points)
    unit = points.withColumn("_n", norm(F.col("v"))).where("_n > 0").select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))
    pairs = close_pairs(unit, 1 - eps).select("a", "b")
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(points.select(F.col("id").alias("a"), F.col("id").alias("b")))
    near = pairs.join(points.select(F.col("id").alias("b"), F.col("n").alias("n2")), "b").select(F.col("a").alias("id"), F.col("b").alias("id2"), "n2")
    near = settled(near)
    core = near.groupBy("id").agg(F.sum("n2").alias("w")).where(F.col("w") >= least).select("id")
    links = near.join(core, "id").join(core.select(F.col("id").alias("id2")), "id2").select("id", "id2")
    links = settled(links)
    label = core.select("id", F.col("id").alias("c"))
    while True:
        spread = settled(links.join(label.select(F.col("id").alias("id2"), "c"), "id2").groupBy("id").agg(F.min("c").alias("c")))
        changed = spread.join(label.select("id", F.col("c").alias("o")), "id").where("c <> o").limit(1).count()
        label = spread
        if not changed:
            break
    edge = near.join(label.select(F.col("id").alias("id2"), "c"), "id2").groupBy("id").agg(F.min("c").alias("c"))
    named = points.join(edge, "id", "left").select("v", F.coalesce("c", F.lit(-1)).alias("cluster"))
    return rows.join(named, rows[vector] == named["v"]).select(id_col, "cluster")
