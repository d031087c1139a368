"""Ontologies as node tables: leaves, pruning from the top down, and gated extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_places(region: DataFrame, nation: DataFrame) -> DataFrame:
    """A three-layer ontology (parent, child, layer) of places: world, regions, nations."""
    top = region.agg(F.lit(None).cast("string").alias("parent"), F.max(F.lit("WORLD")).alias("child"), F.max(F.lit(0)).alias("layer"))
    mid = region.select(F.lit("WORLD").alias("parent"), F.col("r_name").alias("child"), F.lit(1).alias("layer"))
    low = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.lit(2).alias("layer"))
    return top.unionByName(mid).unionByName(low)


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.select(F.col("parent").alias("child")).where("child is not null").distinct()
    return nodes.join(parents, "child", "left_anti")


def propagate(nodes: DataFrame, own: str, depth: int = 3) -> DataFrame:
    """Adds `open`: the node and all above it have the flag `own`. One join for each layer below the top."""
    state = nodes.withColumn("open", F.col(own) & F.col("parent").isNull())
    for layer in range(1, depth + 1):
        up = state.where(F.col("layer") == layer - 1).select(F.col("child").alias("parent"), F.col("open").alias("_up"))
        state = state.join(up, "parent", "left").withColumn("open", F.when(F.col("layer") == layer, F.col(own) & F.coalesce("_up", F.lit(False))).otherwise(F.col("open"))).drop("_up")
    return state


def gated(said: DataFrame, leaf: DataFrame, group: str, value: str, gate: str) -> DataFrame:
    """For each group and leaf: what one pass finds, what is found behind the parent's gate, and whether that is open.

    said: rows (group, value, gate); leaf: (child, parent), an ontology of bounded size. Missing values are "not stated".
    """
    hits = said.groupBy(group, F.col(value).alias("child")).agg(F.count("*").alias("hits"))
    gates = said.groupBy(group, F.col(gate).alias("parent")).agg(F.count("*").alias("gate"))
    every = leaf.agg(F.collect_list(F.struct("child", "parent")).alias("l"))  # one row
    grid = said.select(group).distinct().join(F.broadcast(every)).select(group, F.explode("l").alias("x")).select(group, "x.*")
    x = grid.join(hits, [group, "child"], "left").join(gates, [group, "parent"], "left")
    text = F.col("hits").cast("string")
    return x.select(group, F.col("child").alias("element"), F.coalesce(text, F.lit("not stated")).alias("one_pass"), F.when(F.col("gate") > 0,
        text).alias("gated"), (F.coalesce("gate", F.lit(0)) > 0).alias("open")).fillna("not stated", ["gated"])
