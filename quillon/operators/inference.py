"""Paired tests, rank tests, intervals and the bootstrap for annotation metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numeric import binomial_tail, hash_uniform, poisson_weight
from quillon.operators.confusion import outcome_flags
from quillon.operators.ranges import running_total, settled

METRICS = ("accuracy", "sensitivity", "specificity", "ppv", "npv", "fabrication")


def metric_masks(wide: DataFrame) -> dict[str, tuple[Column, Column, Column]]:
    """For each metric: the rows that it looks at, whether the human is right, whether the AI is."""
    s, h, a = F.col("source"), F.col("human"), F.col("ai")
    whole = s.isNotNull() & h.isNotNull() & a.isNotNull()
    right = lambda c: ((s == 1) & (c == "1")) | ((s == 0) & (c == "N/A"))
    called = lambda c: c.isin("1", "3")
    return {
        "accuracy": (whole, right(h), right(a)),
        "sensitivity": (whole & (s == 1), h == "1", a == "1"),
        "specificity": (whole & (s == 0), h == "N/A", a == "N/A"),
        "ppv": (whole & called(h) & called(a), (s == 1) & (h == "1"), (s == 1) & (a == "1")),
        "npv": (whole & (h == "N/A") & (a == "N/A"), s == 0, s == 0),
        "fabrication": (whole, h != "3", a != "3"),
    }


def discordant(wide: DataFrame, by: list[str]) -> DataFrame:
    """For each group and metric: n, b (human right, AI wrong), c (the other way round). One pass over the rows."""
    masks = metric_masks(wide)
    aggs = [F.struct(F.lit(k).alias("metric"), F.count_if(m).alias("n"), F.count_if(m & h & ~a).alias("b"), F.count_if(m & ~h & a).alias("c")).alias(k) for k, (m, h, a) in masks.items()]
    return wide.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*masks)).alias("x")).select(*by, "x.*")


def mcnemar(wide: DataFrame, by: list[str]) -> DataFrame:
    """One-sided exact McNemar: the chance of c or more of b + c discordant pairs in favour of the AI."""
    d = discordant(wide, by)
    return d.withColumn("p", F.round(binomial_tail(F.col("c"), F.col("b") + F.col("c")), 6))


def average_ranks(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds r (average rank of value within the group) and t (number of ties)."""
    w, ties = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return rows.withColumn("t", F.count("*").over(ties)).withColumn("r", F.rank().over(w) + (F.col("t") - 1) / 2)


def counted_ranks(rows: DataFrame, value: str, by: list[str], side: Column) -> DataFrame:
    """Distinct values with their average rank, the number of rows (t) and of rows where side holds (k).

    Ranks come from a running count over distinct values, so a value that very many rows share is one row here.
    """
    v = rows.groupBy(*by, value).agg(F.count("*").alias("t"), F.count_if(side).alias("k"))
    return running_total(v, by, [value], "t", "_up").withColumn("r", F.col("_up") - F.col("t") + (F.col("t") + 1) / 2).drop("_up")


def mann_whitney(rows: DataFrame, value: str, side: Column, by: list[str]) -> DataFrame:
    """U of the rows where side holds against the others, and z with tie correction."""
    g = counted_ranks(rows.where(F.col(value).isNotNull()), value, by, side).groupBy(*by).agg(
        F.sum(F.col("r") * F.col("k")).alias("w"), F.sum("k").alias("n1"), F.sum(F.col("t") - F.col("k")).alias("n2"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("ties")
    )
    n = (F.col("n1") + F.col("n2")).cast("double")
    u = F.col("w") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return g.select(*by, "n1", "n2", F.round(u, 6).alias("u"), F.round(F.try_divide(u - F.col("n1") * F.col("n2") / 2.0, F.sqrt(var)), 6).alias("z"))


def wilcoxon(rows: DataFrame, diff: str, by: list[str]) -> DataFrame:
    """Signed-rank sum of non-zero differences, and z with tie correction, without continuity correction."""
    d = rows.where(F.col(diff) != 0).withColumn("_a", F.abs(F.col(diff)))
    g = counted_ranks(d, "_a", by, F.col(diff) > 0).groupBy(*by).agg(F.sum(F.col("r") * F.col("k")).alias("w"), F.sum("t").alias("n"),
        F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return g.select(*by, "n", F.round("w", 6).alias("w_plus"), F.round((F.col("w") - n * (n + 1) / 4) / F.sqrt(var), 6).alias("z"))


#: Cases of one pattern up to which their weights are drawn one by one.
ONE_BY_ONE = 12


def bootstrap_counts(long: DataFrame, case: str, by: list[str], reps: int, seed: int) -> DataFrame:
    """Confusion counts of `reps` resamples of cases: (b, *by, tp, fp, fn, tn).

    Every case has a Poisson(1) weight in each resample, the same for all groups of `by`. Cases with equal counts in all
    groups are one pattern, and the sum of n such weights is Poisson(n): drawn one by one up to ONE_BY_ONE, beyond it by the
    normal quantile with its first correction for skew. So the work grows with patterns and resamples, not with cases.
    """
    flags = outcome_flags(F.col("source"), F.col("code"))
    per = long.groupBy(case, *by).agg(*(F.count_if(c).alias(k) for k, c in flags.items()))
    named = F.concat_ws(":", *(F.col(c).cast("string") for c in (*by, *flags)))
    whole = per.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(named.alias("k"), *by, *flags))).alias("g"))
    patterns = whole.groupBy(F.array_join(F.transform("g", lambda x: x["k"]), ";").alias("pattern")).agg(F.count("*").alias("n"), F.first("g").alias("g"))
    # Few rows become very many: they are dealt out to all cores, whatever their own size.
    cores = long.sparkSession.sparkContext.defaultParallelism
    each = settled(patterns).repartition(max(8, cores)).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    draw = lambda j: hash_uniform(F.lit(seed), F.col("b"), F.col("pattern"), j)
    few = each.where(F.col("n") <= ONE_BY_ONE).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    few = few.withColumn("u", draw(F.col("j"))).select("b", "g", poisson_weight(F.col("u")).cast("long").alias("w"))
    many = each.where(F.col("n") > ONE_BY_ONE).withColumns({c: (draw(F.lit(j)) + 0.5) / 4294967296.0 for c, j in (("u", -1), ("v", -2))})
    many = many.withColumn("z", F.sqrt(-2 * F.ln("u")) * F.cos(2 * math.pi * F.col("v")))
    many = many.select("b", "g", F.greatest(F.round(F.col("n") + F.sqrt("n") * F.col("z") + (F.col("z") * F.col("z") - 1) / 6).cast("long"), F.lit(0)).alias("w"))
    weighed = few.unionByName(many).where("w > 0")
    parts = weighed.select("b", "w", F.explode("g").alias("x")).select("b", "w", *(F.col(f"x.{c}").alias(c) for c in (*by, *flags)))
    return parts.groupBy("b", *by).agg(*(F.sum(F.col(k) * F.col("w")).alias(k) for k in flags))
