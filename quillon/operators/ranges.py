"""Running totals, numbering and exact quantiles over groups of any size.

A window over a whole group puts it into one task. Here rows are dealt out by ranges of (group, order) instead, each range
is summed where it lies, and a row's total is its total within its range plus the sums of earlier ranges of its group: one
row for each range and group.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df written once to the reliable checkpoint folder, so that reading it twice gives the same rows even where executors are lost.

    The folder is spark.checkpoint.dir; where it is unset, a session in one process gets one of its own, a cluster is refused.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="quillon-"))
    return df.checkpoint()


def _same(names: list[str], a: str, b: str) -> Column:
    """Null-safe equality of the columns of two aliased tables; null groups are groups."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.`{n}`").eqNullSafe(F.col(f"{b}.`{n}`")) for n in names), F.lit(True))


def running_total(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of value over the rows of the group up to and including this one. order must tell all rows of a group apart."""
    part, sums, before = (f"_{x}{uuid.uuid4().hex[:8]}" for x in "psb")
    ranged = df.repartitionByRange(*(F.col(c) for c in (*by, *order))).withColumn(part, F.spark_partition_id())
    ranged = settled(ranged)
    within = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sized = ranged.groupBy(part, *by).agg(F.sum(value).alias(sums))  # a row for each range and group in it
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn(before, F.coalesce(F.sum(sums).over(earlier), F.lit(0))).drop(sums)
    summed = ranged.withColumn(name, F.sum(value).over(within)).alias("l")
    joined = summed.join(sized.alias("r"), _same([part, *by], "l", "r"))
    return joined.select(*(F.col(f"l.`{c}`") for c in df.columns), (F.col(f"l.`{name}`") + F.col(f"r.`{before}`")).alias(name))


def numbered(df: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """Adds 1, 2, ... over the rows of each group (of the table without by) in the given order."""
    one = f"_o{uuid.uuid4().hex[:8]}"
    return running_total(df.withColumn(one, F.lit(1).cast("long")), by or [], order, one, name).drop(one)


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: (*by, column_name, n, q), q an array by probability; nulls are left out.

    Equal values are counted first, so a value that very many rows share is one row.
    """
    by = by or []
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_v")) for c in columns))).alias("_x"))
    group = [*by, "column_name"]
    counts = long.select(*by, "_x.column_name", "_x._v").where("_v is not null").groupBy(*group, "_v").agg(F.count("*").alias("_n"))
    up = running_total(counts, group, ["_v"], "_n", "_up")
    total = up.groupBy(*group).agg(F.sum("_n").alias("n"))
    ranked = up.alias("l").join(total.alias("r"), _same(group, "l", "r")).select("l.*", "r.n")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_up") - F.col("_n") <= place) & (place < F.col("_up")), F.col("_v")))

    parts = []
    for p in probabilities:
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = at(F.floor(place)), at(F.ceil(place))
        parts.append(low + (high - low) * F.max(place - F.floor(place)))
    return ranked.groupBy(*group).agg(F.max("n").alias("n"), F.array(*parts).alias("q"))
