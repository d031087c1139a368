"""Profiles of tables: missing values, descriptions, outliers, bins, imputation, cross-tables and Table 1.

Statistics of many columns come from one pass: aggregates are packed into an array of structs and exploded afterwards.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.ranges import quantiles


def per_column(df: DataFrame, columns: list[str], stats) -> DataFrame:
    """One row for each column: its name and what stats(name) -> {label: aggregate} says. A single aggregation."""
    packed = [F.struct(F.lit(c).alias("column_name"), *(a.alias(k) for k, a in stats(c).items())).alias(f"_{i}") for i, c in enumerate(columns)]
    one = df.agg(*packed)
    return one.select(F.explode(F.array(*(F.col(f"_{i}") for i in range(len(columns))))).alias("x")).select("x.*")


def missing_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_missing, n_present and pct_missing of each column; a column that the table lacks is wholly missing."""
    there = [c for c in columns if c in df.columns]
    absent = [c for c in columns if c not in df.columns]
    full = df.select(*there, *(F.lit(None).cast("string").alias(c) for c in absent))
    n = F.count("*")
    return per_column(full, columns, lambda c: {"n_missing": n - F.count(c), "n_present": F.count(c), "pct_missing": F.round(F.try_divide((n - F.count(c)) * 100.0, n), 6)})


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, extremes and exact quartiles (linear interpolation)."""
    r = lambda v: F.round(v, 6)

    def stats(c: str) -> dict[str, Column]:
        x = F.col(c).cast("double")
        return {"n": F.count(x), "mean": r(F.avg(x)), "std": r(F.stddev_samp(x)), "min": r(F.min(x)), "max": r(F.max(x))}

    q = quantiles(df, columns, [0.25, 0.5, 0.75]).select("column_name", r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("q50"), r(F.col("q")[2]).alias("q75"))
    return per_column(df, columns, stats).join(F.broadcast(q), "column_name", "left")  # a row for each column


def value_counts(df: DataFrame, column: str, dropna: bool = False) -> DataFrame:
    """value, n and share of all; ties have no order of their own."""
    rows = df.where(F.col(column).isNotNull()) if dropna else df
    n = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("_all"))  # one row
    return n.join(F.broadcast(whole)).select("value", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def describe_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, number of values, most frequent value (smallest among ties) and its count."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*").where("v is not null")
    n = long.groupBy("column_name", "v").agg(F.count("*").alias("k"))
    best = F.min(F.struct((-F.col("k")).alias("k"), F.col("v").alias("v")))
    return n.groupBy("column_name").agg(F.sum("k").alias("n"), F.count("*").alias("n_unique"), best.alias("b")).select("column_name", "n", "n_unique",
        F.col("b.v").alias("top"), (-F.col("b.k")).alias("freq"))


def iqr_fences(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """One row: lo and hi."""
    found = quantiles(df, [column], [0.25, 0.75])
    return found.select((F.col("q")[0] - k * (F.col("q")[1] - F.col("q")[0])).alias("lo"), (F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])).alias("hi"))


def outlier_share(df: DataFrame, column: str) -> DataFrame:
    f = df.join(F.broadcast(iqr_fences(df, column)))  # one row
    out = (F.col(column) < F.col("lo")) | (F.col(column) > F.col("hi"))
    return f.agg(F.count(column).alias("n"), F.count_if(out).alias("n_outliers"), F.round(100.0 * F.count_if(out) / F.count(column),
        6).alias("pct_outliers")).select(F.lit(column).alias("column_name"), "*")


def clipped(df: DataFrame, column: str) -> DataFrame:
    """column drawn in to the fences."""
    f = df.join(F.broadcast(iqr_fences(df, column)))  # one row
    return f.withColumn(column, F.least(F.greatest(F.col(column), F.col("lo")), F.col("hi"))).drop("lo", "hi")


def cut(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Left-closed bins; NULL outside."""
    out = F.lit(None).cast("string")
    for a, b, name in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((x >= a) & (x < b), name).otherwise(out)
    return out


def impute(df: DataFrame, column: str, by: list[str], how: str = "mean") -> DataFrame:
    """NULLs of column filled with the group's mean or median; a group without values stays NULL. Adds `filled`."""
    if how == "median":
        fill = quantiles(df, [column], [0.5], by).select(*by, F.col("q")[0].alias("_fill"))
    else:
        fill = df.groupBy(*by).agg(F.avg(column).alias("_fill"))
    return df.join(fill, by, "left").withColumn("filled", F.coalesce(column, "_fill")).drop("_fill")


def cross_table(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts and row percentages: n_<value>, pct_<value>."""
    n = [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    p = [F.round(100.0 * F.count_if(F.col(column) == v) / F.count("*"), 6).alias(f"pct_{v}") for v in values]
    return df.groupBy(row).agg(*n, *p)


def table_one(df: DataFrame, group: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Rows (variable, level, grp, n, value): median (IQR) of numbers, n (%) of categories, by group and in Total."""
    both = df.select(*numeric, *categorical, F.explode(F.array(F.col(group), F.lit("Total"))).alias("grp"))
    fmt = lambda c: F.format_string("%.4f", c)
    parts = []
    num = quantiles(both, numeric, [0.25, 0.5, 0.75], ["grp"])
    value = F.concat(fmt(F.col("q")[1]), F.lit(" ("), fmt(F.col("q")[0]), F.lit(", "), fmt(F.col("q")[2]), F.lit(")"))
    num = num.select(F.col("column_name").alias("variable"), F.lit("").alias("level"), "grp", "n", value.alias("value"))
    parts.append(num)
    long = both.select("grp", F.explode(F.array(*(F.struct(F.lit(c).alias("variable"),
        F.col(c).cast("string").alias("level")) for c in categorical))).alias("x")).select("grp", "x.*").where("level is not null")
    k = long.groupBy("variable", "level", "grp").agg(F.count("*").alias("n"))
    share = F.format_string("%.1f", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("variable", "grp")))
    parts.append(k.select("variable", "level", "grp", "n", F.concat(F.col("n").cast("string"), F.lit(" ("), share, F.lit(")")).alias("value")))
    return parts[0].unionByName(parts[1])


def catalogue(df: DataFrame) -> DataFrame:
    """position, type, number of distinct and of missing values of each column."""
    n = F.count("*")
    out = per_column(df, df.columns, lambda c: {"position": F.max(F.lit(df.columns.index(c) + 1)),
        "data_type": F.max(F.lit(kind_of(df.schema[c].dataType))), "n_unique": F.count_distinct(c), "n_missing": n - F.count(c),
        "pct_missing": F.round((n - F.count(c)) * 100.0 / n, 6)})
    return out


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, (T.IntegerType, T.LongType, T.ShortType)):
        return "integer"
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return "number"
    return "other"


def role_of(name: str) -> str:
    """Role of a column by its name."""
    for part, role in (("key", "identifier"), ("name", "label"), ("date", "time"), ("price", "measure"), ("bal", "measure"), ("status", "category"), ("priority", "category"), ("segment", "category")):
        if part in name:
            return role
    return "attribute"


def label_of(name: str) -> str:
    """A column's name as words: without a short prefix, underscores as spaces."""
    return re.sub(r"^[a-z]{1,2}_", "", name).replace("_", " ")
