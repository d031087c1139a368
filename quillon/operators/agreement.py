"""Row-level outcomes of annotations, case-level accuracy and agreement between annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.annotations import numeric_code
from quillon.operators.ranges import quantiles


def status(code: Column) -> Column:
    n = numeric_code(code)
    return F.when(n == 1, "correct").when(n == 2, "omitted").when(n == 3, "fabricated").when(code.isNull(), "missing").otherwise("other")


def outcome(source: Column, code: Column) -> Column:
    """TP, FN, FP (fabricated where the source has nothing), TN, unknown or not_evaluated."""
    n = numeric_code(code)
    return (
        F.when(source.isNull() | code.isNull(), "not_evaluated")
        .when((source == 1) & (n == 1), "TP")
        .when((source == 1) & (n == 2), "FN")
        .when((source == 0) & (n == 3), "FP")
        .when((source == 0) & (code == "N/A"), "TN")
        .otherwise("unknown")
    )


def correct(source: Column, code: Column) -> Column:
    """1 or 0; NULL where the row can't be judged."""
    right = ((source == 1) & (code == "1")) | ((source == 0) & (code == "N/A"))
    return F.when(source.isNotNull() & code.isNotNull(), right.cast("int"))


def encode(source: Column, called: Column) -> Column:
    """Code of a call (true: said to be present) against the source."""
    return F.when((source == 1) & called, "1").when(source == 1, "2").when((source == 0) & called, "3").when(source == 0, "N/A")


def stars(p: Column) -> Column:
    return F.when(p.isNull(), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def case_accuracy(long: DataFrame, digits: int | None = 6) -> DataFrame:
    c = correct(F.col("source"), F.col("code"))
    out = long.groupBy("case_id", "annotator").agg(F.sum(c).alias("n_correct"), F.count(c).alias("n_evaluated")).where("n_evaluated > 0")
    acc = F.col("n_correct") / F.col("n_evaluated")
    return out.withColumn("accuracy", F.round(acc, digits) if digits is not None else acc)


def complexity_gap(wide: DataFrame) -> DataFrame:
    """Cases with at least the median number of present elements against the others: mean of AI minus human share."""
    ok = {k: F.sum(correct(F.col("source"), F.col(k))) for k in ("human", "ai")}
    x = wide.groupBy("case_id").agg(F.count_if(F.col("source") == 1).alias("n_present"), ok["human"].alias("h"), ok["ai"].alias("a"), F.count("*").alias("n"))
    mid = quantiles(x, ["n_present"], [0.5]).select(F.col("q")[0].alias("mid"))  # one row
    kind = F.when(F.col("n_present") >= F.col("mid"), "complex").otherwise("simple")
    return x.join(F.broadcast(mid)).groupBy(kind.alias("complexity")).agg(F.count("*").alias("n_cases"), F.round(F.avg(F.col("a") / F.col("n") - F.col("h") / F.col("n")), 6).alias("mean_gap"))


def balance_audit(counts: DataFrame) -> DataFrame:
    p, n = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    acc = F.try_divide(F.col("tp") + F.col("tn"), p + n)
    bal = (F.try_divide(F.col("tp"), p) + F.try_divide(F.col("tn"), n)) / 2
    flag = F.when((p == 0) | (n == 0), "one class").when(F.greatest(p, n) >= 3 * F.least(p, n), "imbalanced").otherwise("balanced")
    advice = F.when(bal.isNull(), "accuracy").when(F.abs(acc - bal) > 0.05, "balanced_accuracy").otherwise("either")
    return counts.select("element", "annotator", p.alias("n_positive"), n.alias("n_negative"), flag.alias("imbalance_flag"), F.round(acc,
        6).alias("accuracy"), F.round(bal, 6).alias("balanced_accuracy"), advice.alias("recommendation"))


def binary_curve_areas(long: DataFrame) -> DataFrame:
    """ROC and precision-recall areas of calls without scores (codes 1 and 3 say present); NULL where one class is absent."""
    y, p = F.col("source") == 1, F.col("code").isin("1", "3")
    c = long.where("source is not null and code is not null").groupBy("element", "annotator").agg(F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    r, sp, pr = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp), F.try_divide(tp, tp + fp)
    prev = F.try_divide(tp + fn, tp + fp + fn + tn)
    area = r * (1 + F.coalesce(pr, F.lit(1.0))) / 2 + (1 - r) * (F.coalesce(pr, prev) + prev) / 2
    return c.select("element", "annotator", F.round((r + sp) / 2, 6).alias("roc_auc"), F.round(F.when(r.isNotNull() & sp.isNotNull(), area), 6).alias("pr_auc"))


def cohen_kappa(wide: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Chance-corrected agreement of two code columns, from their contingency table."""
    t = wide.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("n"))
    total = t.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("o"))
    left = t.groupBy(*by, F.col(a).alias("k")).agg(F.sum("n").alias("x"))
    right = t.groupBy(*by, F.col(b).alias("k")).agg(F.sum("n").alias("y"))
    chance = left.join(right, [*by, "k"]).groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("e"))
    po, pe = F.col("o") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return total.join(chance, by).select(*by, "n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))
