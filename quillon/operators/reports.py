"""Tables for reports: column selection, cleaning, element tables with intervals and tests, features against correctness."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distributions import normal_sf, paired_t, shapiro_wilk, signed_rank, student_sf
from quillon.operators.ranges import quantiles

LOWER_IS_BETTER = ("fabrication_rate",)


def nulled(df: DataFrame, columns: list[str], placeholders: tuple) -> DataFrame:
    """Placeholders become NULL."""
    return df.withColumns({c: F.when(~F.col(c).isin(*placeholders), F.col(c)) for c in columns})


def find_column(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """The first column that equals a candidate but for case and outer spaces, else the first that contains one."""
    columns, wanted = list(columns), [c.strip().upper() for c in candidates]
    exact = (c for w in wanted for c in columns if c.strip().upper() == w)
    inside = (c for w in wanted for c in columns if w in c.strip().upper())
    return next(exact, None) or next(inside, None)


def without_identifiers(df: DataFrame, deny: Iterable[str], allow: Iterable[str] | None = None) -> tuple[DataFrame, list[str]]:
    """df without the denied columns and, with allow, with allowed ones only; and the names of what went, in order."""
    deny, allow = set(deny), None if allow is None else set(allow)
    gone = [c for c in df.columns if c in deny or (allow is not None and c not in allow)]
    return df.drop(*gone), gone


def audit(df: DataFrame, dropped: list[str], surrogates: dict[str, str]) -> DataFrame:
    """One row: record_count, dropped_columns, and for each surrogate column (by its original) how many values it stands for."""
    stats = [F.struct(F.lit(k).alias("column"), F.count_distinct(v).alias("n_unique"), F.count_if(F.col(v).isNull()).alias("n_missing")) for k, v in surrogates.items()]
    return df.agg(F.count("*").alias("record_count"), F.max(F.lit("|".join(dropped))).alias("dropped_columns"), F.to_json(F.array(*stats)).alias("surrogates"))


def stars_of_interval(lo: Column, hi: Column) -> Column:
    """A star where the interval leaves out 0."""
    return F.when((lo > 0) | (hi < 0), "*").otherwise("")


def with_interval(x: Column, lo: Column, hi: Column, digits: int = 3) -> Column:
    form = f"%.{digits}f"
    return F.when(x.isNull() | F.isnan(x), "NA").otherwise(F.format_string(f"{form} ({form}, {form})", x, lo, hi))


def quantile_bins(df: DataFrame, column: str, order: list[str], by: list[str], n: int = 4) -> DataFrame:
    """Adds bin (0 to n - 1): rows in the order of column and `order` have ranks 1, 2, ...; edges are quantiles of the ranks.

    A rank on an edge belongs to the lower bin.
    """
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(column, *order))).withColumn("_m", F.count("*").over(w))
    place = (F.col("_r") - 1) * F.lit(n) / F.greatest(F.col("_m") - 1, F.lit(1))
    return ranked.withColumn("bin", F.greatest(F.ceil(place) - 1, F.lit(0)).cast("int")).drop("_r", "_m")


def indicators(df: DataFrame, column: str, items: list[str], pattern: str = "[;|,]") -> dict[str, Column]:
    """1 where the separated list in column has the item, for each item."""
    have = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), pattern), lambda x: F.trim(x))
    return {i: F.array_contains(have, i).cast("int") for i in items}


def first_known(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """The first value of each column that isn't null, in the given order; NULL without one."""
    return df.groupBy(*by).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def five_numbers(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Of each group: minimum, quartiles, maximum, and the whiskers' ends (the furthest values within 1.5 IQR of the box)."""
    q = quantiles(df, [column], [0.0, 0.25, 0.5, 0.75, 1.0], by).select(*by, "n", *(F.col("q")[i].alias(k) for i, k in enumerate(("lowest", "q25", "q50", "q75", "highest"))))
    x, spread = F.col(column), F.col("q75") - F.col("q25")
    met = df.where(x.isNotNull()).join(F.broadcast(q), by)  # a row for each group
    ends = met.where((x >= F.col("q25") - 1.5 * spread) & (x <= F.col("q75") + 1.5 * spread)).groupBy(*by).agg(F.min(x).alias("whisker_lo"), F.max(x).alias("whisker_hi"))
    return q.join(ends, by)


def features_by_correctness(cases: DataFrame, judged: str, features: list[str], by: list[str]) -> DataFrame:
    """For each group and verdict (a boolean column; NULL is left out): n, and mean, median and deviation of each feature."""
    known = cases.where(F.col(judged).isNotNull())
    group = [*by, judged]
    stats = known.groupBy(*group).agg(F.count("*").alias("n"), *(F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.stddev_samp(f).alias("std")).alias(f) for f in features))
    long = stats.select(*group, "n", F.explode(F.array(*features)).alias("x")).select(*group, "n", "x.*")
    mid = quantiles(known, features, [0.5], group).select(*group, F.col("column_name").alias("feature"), F.col("q")[0].alias("median"))
    r = lambda c: F.round(c, 2).alias(c)
    return long.join(mid, [*group, "feature"]).select(*group, "feature", "n", r("mean"), r("median"), r("std"))


def significance(df: DataFrame, metric: str, p: str, lo: str, hi: str) -> Column:
    """F1 is significant where its interval leaves out 0, other metrics by their p-value."""
    by_p = F.when(F.col(p).isNull(), "").when(F.col(p) < 0.001, "***").when(F.col(p) < 0.01, "**").when(F.col(p) < 0.05, "*").otherwise("")
    return F.when(F.lower(F.trim(metric)) == "f1", F.coalesce(stars_of_interval(F.col(lo), F.col(hi)), F.lit(""))).otherwise(by_p)


def chi_square_1_sf(x: Column) -> Column:
    """P(X > x) for one degree of freedom: twice a normal tail, by a rational approximation (error below 1.2e-7)."""
    z = F.sqrt(x / 2)
    t = 1 / (1 + 0.5 * z)
    # Coefficients of the approximation of erfc.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + k
    return t * F.exp(-z * z + poly)


def paired_metric_tests(metrics: DataFrame, names: list[str], unit: str = "element", annotator: str = "annotator") -> DataFrame:
    """Of each metric, over units that both annotators have: means, Shapiro-Wilk on the differences (AI minus human), and a
    one-sided paired t-test where they look normal, else a signed-rank test; the direction is that in which AI is better.

    metrics: a row for each unit and annotator, so a group is as large as the number of units.
    """
    out = "metric string, n bigint, human_mean double, ai_mean double, mean_diff double, shapiro_p double, is_normal boolean, test string, stat double, p double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = (pdf["ai"] - pdf["human"]).sort_values().to_numpy(float)
        name, n = pdf["metric"].iloc[0], len(d)
        normal_p = shapiro_wilk(d)[1]
        is_normal = normal_p > 0.05
        better = -1 if name in LOWER_IS_BETTER else 1
        if n < 3:
            test, stat, p = "insufficient pairs", math.nan, math.nan
        elif is_normal:
            test, stat, p = "paired t", paired_t(d)[0], paired_t(better * d)[1]
        else:
            test, stat, p = "signed rank", signed_rank(d)[0], signed_rank(better * d)[1]
        row = (name, n, pdf["human"].mean(), pdf["ai"].mean(), d.mean(), normal_p, bool(is_normal), test, stat, p)
        return pd.DataFrame([row], columns=[c.split()[0] for c in out.split(", ")]).astype({"n": "int64"})

    long = metrics.select(unit, annotator, *names).unpivot([unit, annotator], names, "metric", "v")
    pairs = long.groupBy("metric", unit).agg(*(F.max(F.when(F.col(annotator) == k, F.col("v"))).alias(k) for k in ("human", "ai"))).where("human is not null and ai is not null")
    tested = pairs.groupBy("metric").applyInPandas(run, out)
    shown = ("human_mean", "ai_mean", "mean_diff", "shapiro_p", "stat", "p")
    return tested.withColumns({c: F.round(F.when(~F.isnan(c), F.col(c)), 6) for c in shown})


def two_sided_p(t: Column, df: Column) -> Column:
    """Of Student's t, for a row each group."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([2 * student_sf(abs(a), b) if pd.notna(a) and b > 0 else None for a, b in zip(t, df)], dtype="float64")

    return p(t.cast("double"), df.cast("double"))


def normal_p(z: Column) -> Column:
    """P(Z > z), for a row each group."""

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return z.map(normal_sf)

    return p(z)


def fleiss_kappa(ratings: DataFrame, subject: str, category: str) -> DataFrame:
    """One row: subjects, ratings and kappa of any number of raters; a subject needs two ratings."""
    n = ratings.where(F.col(category).isNotNull()).groupBy(subject, category).agg(F.count("*").alias("_k"))
    per = n.groupBy(subject).agg(F.sum("_k").alias("m"), F.sum(F.col("_k") * (F.col("_k") - 1)).alias("same")).where("m > 1")
    agree = per.agg(F.count("*").alias("subjects"), F.sum("m").alias("ratings"), F.avg(F.col("same") / (F.col("m") * (F.col("m") - 1))).alias("p"))
    shares = n.join(per.select(subject), subject, "left_semi").groupBy(category).agg(F.sum("_k").alias("_k"))
    chance = shares.agg((F.sum(F.col("_k") * F.col("_k")) / (F.sum("_k") * F.sum("_k"))).alias("e"))
    return agree.join(F.broadcast(chance)).select("subjects", "ratings", F.round(F.try_divide(F.col("p") - F.col("e"), 1 - F.col("e")), 6).alias("kappa"))  # one row each


def one_vs_rest(code: Column) -> dict[str, Column]:
    """1 or 0 for each outcome of a code; NULL for missing codes."""
    n = code.try_cast("int")
    return {name: F.when(n.isNotNull(), (n == k).cast("int")) for name, k in (("is_correct", 1), ("is_omission", 2), ("is_fabrication", 3))}


def redaction_quality(spans: DataFrame, severity: dict[str, int]) -> DataFrame:
    """For each type: recall, precision, F1, false negative rate, over-redaction and residual risk.

    spans: type, truth, redacted (booleans of each candidate span). Residual risk is the severity of what was missed by that of all.
    """
    s = F.element_at(F.create_map(*(F.lit(x) for kv in severity.items() for x in kv)), F.col("type"))
    hit = lambda a, b: F.count_if((F.col("truth") == a) & (F.col("redacted") == b))
    g = spans.withColumn("_s", F.coalesce(s, F.lit(1))).groupBy("type").agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True,
        False).alias("fn"), hit(False, False).alias("tn"), F.sum(F.when(F.col("truth"), F.col("_s"))).alias("_all"),
        F.sum(F.when(F.col("truth") & ~F.col("redacted"), F.col("_s")).otherwise(0)).alias("_missed"))
    r = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select("type", "tp", "fp", "fn", "tn", r(tp, tp + fn).alias("recall"), r(tp, tp + fp).alias("precision"), r(2 * tp,
        2 * tp + fp + fn).alias("f1"), r(fn, tp + fn).alias("fnr"), r(fp, fp + tn).alias("fpr"), r(fp, tp + fp).alias("over_redaction"),
        r(F.col("_missed"), F.col("_all")).alias("residual_risk"))
