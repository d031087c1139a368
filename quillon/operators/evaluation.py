"""Evaluation of predictions: areas, calibration, macro scores, concordance, folds, privacy measures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.inference import counted_ranks
from quillon.operators.ranges import numbered, running_total, settled


def auc_brier(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve by ranks of distinct scores, Brier score and accuracy at one half. One row."""
    base = df.withColumns({"_one": F.lit(1)})
    v = counted_ranks(base, p, ["_one"], F.col(y) == 1)
    area = v.agg(F.sum(F.col("r") * F.col("k")).alias("w"), F.sum("k").alias("n1"), F.sum(F.col("t") - F.col("k")).alias("n0"))
    rest = df.agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("b"), F.avg(((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("double")).alias("a"))
    auc = F.try_divide(F.col("w") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1").cast("double") * F.col("n0"))
    return area.join(F.broadcast(rest)).select(F.round(auc, 6).alias("auc"), F.round("b", 6).alias("brier"), F.round("a", 6).alias("accuracy"))  # one row each


def multiclass_auc(df: DataFrame, klass: str, y: str, p: str) -> DataFrame:
    """Areas of each class against the rest, of all decisions together (micro), and the classes' mean (macro).

    df: a row for each case and class, y telling whether the case is of the class.
    """
    both = df.select(F.explode(F.array(F.col(klass), F.lit("micro"))).alias("class"), F.col(y).alias("y"), F.col(p).alias("p"))
    v = counted_ranks(both, "p", ["class"], F.col("y") == 1)
    g = v.groupBy("class").agg(F.sum(F.col("r") * F.col("k")).alias("w"), F.sum("k").alias("n1"), F.sum(F.col("t") - F.col("k")).alias("n0"))
    g = g.select("class", F.try_divide(F.col("w") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1").cast("double") * F.col("n0")).alias("auc"))
    macro = g.where("class <> 'micro'").agg(F.lit("macro").alias("class"), F.avg("auc").alias("auc"))
    return g.unionByName(macro).select("class", F.round("auc", 6).alias("auc"))


def macro_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """Means over classes of precision, recall and F1; 0 where undefined. From the confusion table."""
    t = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    long = t.select(F.explode(F.array(F.struct(F.col("y").alias("k"), F.lit(1).alias("truth")), F.struct(F.col("p").alias("k"),
        F.lit(0).alias("truth")))).alias("s"), "n", (F.col("y") == F.col("p")).alias("same")).select("s.*", "n", "same")
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    m = long.groupBy("k").agg(hit((F.col("truth") == 1) & F.col("same")).alias("tp"), hit((F.col("truth") == 0) & ~F.col("same")).alias("fp"), hit((F.col("truth") == 1) & ~F.col("same")).alias("fn"))
    mean = lambda a, b: F.round(F.avg(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return m.agg(mean(tp, tp + fp).alias("macro_precision"), mean(tp, tp + fn).alias("macro_recall"), mean(2 * tp, 2 * tp + fp + fn).alias("macro_f1"))


def concordance(df: DataFrame, time: str, event: str, risk: str, by: str) -> DataFrame:
    """Share of comparable pairs within strata whose risks are ordered as their times are.

    Pairs are counted, never made. Distinct times of a stratum are numbered; two times differ first at one bit of their
    numbers, so every pair is counted once, at that bit: among rows that agree in the bits above it, those with a 0 there
    are earlier than those with a 1, and running counts over risks tell how many of them have a higher one.
    """
    x = df.groupBy(by, F.col(time).alias("t"), F.col(event).alias("e"), F.col(risk).alias("r")).agg(F.count("*").alias("n"))
    times = settled(numbered(x.select(by, "t").where("t is not null").distinct(), ["t"], "k", by=[by]))
    bits = max(1, int(times.agg(F.max("k")).first()[0] or 1).bit_length())
    x = x.join(times, [by, "t"]).where("r is not null").withColumn("k", F.col("k") - 1)
    each = x.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    late = F.expr("shiftright(k, level) & 1")
    each = each.select(by, "level", F.expr("shiftright(k, level + 1)").alias("above"), "r", F.when((late == 0) & (F.col("e") == 1),
        F.col("n")).otherwise(0).alias("early"), F.when(late == 1, F.col("n")).otherwise(0).alias("late"))
    group = [by, "level", "above"]
    sums = each.groupBy(*group, "r").agg(F.sum("early").alias("early"), F.sum("late").alias("late"))
    up = running_total(sums, group, ["r"], "early", "up")
    total = up.groupBy(*group).agg(F.sum("early").alias("whole")).where("whole > 0")
    met = up.where("late > 0").join(total, group)
    good = (F.col("whole") - F.col("up") + F.col("early") / 2) * F.col("late")
    n = F.col("whole") * F.col("late")
    return met.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n_pairs"), F.round(F.try_divide(F.sum(good), F.sum(n)), 6).alias("c_index"))


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int) -> DataFrame:
    """Adds fold: rows of each label in the order of a hash of the id, dealt out in turn."""
    rows = df.withColumn("_h", F.md5(F.col(id_col).cast("string")))
    return numbered(rows, ["_h", id_col], "fold", by=[label]).withColumn("fold", ((F.col("fold") - 1) % k).cast("int")).drop("_h")


def k_anonymity(df: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest group, number of groups of one row and number of groups over the given columns."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.min("n").alias("k"), F.count_if(F.col("n") == 1).alias("n_unique"), F.count("*").alias("n_groups"))


def problem_summary(df: DataFrame, by: str, acc: str, mean_below: float, min_below: float) -> DataFrame:
    g = df.groupBy(by).agg(F.avg(acc).alias("m"), F.max(acc).alias("hi"), F.min(acc).alias("lo"), F.count("*").alias("n"))
    return g.select(by, F.round("m", 6).alias("mean_acc"), F.round("hi", 6).alias("max_acc"), F.round("lo", 6).alias("min_acc"), "n",
        ((F.col("m") < mean_below) | (F.col("lo") < min_below)).alias("needs_refinement"))


def linear_contributions(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean absolute contribution weight * (x - mean) of each feature, ranked."""
    mean = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in weights))  # one row
    one = df.join(F.broadcast(mean)).agg(*(F.round(F.avg(F.abs(w * (F.col(c) - F.col(f"_m_{c}")))), 6).alias(c) for c, w in weights.items()))
    long = one.unpivot([], list(weights), "feature", "contribution")
    return long.withColumn("place", F.row_number().over(Window.orderBy(F.desc("contribution"), "feature")))


def with_lcs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds lcs (longest common subsequence of two word arrays) and rouge_l (its F1)."""

    def length(x, y) -> int:
        """A row of the table is the bits of one integer: a zero for each column where the length grows."""
        at: dict = {}
        for i, u in enumerate(x):
            at[u] = at.get(u, 0) | 1 << i
        every = (1 << len(x)) - 1
        row = every
        for v in y:
            same = row & at.get(v, 0)
            row = ((row + same) | (row - same)) & every
        return len(x) - row.bit_count()

    @F.pandas_udf("int")
    def lcs(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([length(list(p), list(q)) for p, q in zip(x, y)], dtype="int32")

    out = df.withColumn("lcs", lcs(a, b))
    return out.withColumn("rouge_l", F.round(F.coalesce(F.try_divide(2.0 * F.col("lcs"), F.size(a) + F.size(b)), F.lit(0.0)), 6))
