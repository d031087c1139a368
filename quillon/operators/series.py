"""Ordered series: trends, smoothing, change points and feasibility of forecasts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ranges import numbered


def iterations(df: DataFrame, by: str, order: list[str], name: str = "iteration") -> DataFrame:
    """Adds 0, 1, ... in the order of `order`, which must tell a group's rows apart; a group may be of any size."""
    return numbered(df, order, name, by=[by]).withColumn(name, F.col(name) - 1)


def linear_trend(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Slope, intercept, r2 and the slope's standard error for each group, from running sums only."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    g = df.groupBy(by).agg(F.count(b).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b,
        a).alias("r2"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"))
    err = F.sqrt(F.try_divide(F.col("syy") * (1 - F.col("r2")), (F.col("n") - 2) * F.col("sxx")))
    direction = F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("flat")
    return g.select(by, "n", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")), F.round(err, 6).alias("stderr"), direction.alias("direction"))


def trend_test(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """t of each group's slope and its two-sided p-value."""
    from quillon.operators.reports import two_sided_p

    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    g = df.groupBy(by).agg(F.count(b).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_r2(b, a).alias("r2"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"))
    err = F.sqrt(F.try_divide(F.col("syy") * (1 - F.col("r2")), (F.col("n") - 2) * F.col("sxx")))
    t = g.select(by, "n", F.try_divide(F.col("slope"), err).alias("t"))
    return t.select(by, "n", F.round("t", 6).alias("t"), F.round(two_sided_p(F.col("t"), F.col("n") - 2), 6).alias("p"))


def cusum(df: DataFrame, by: str, order: str, y: str) -> DataFrame:
    """The place where the running sum of deviations from the mean is farthest from 0; means before and after it."""
    w = Window.partitionBy(by)
    d = df.withColumn("_c", F.col(y) - F.avg(y).over(w)).withColumn("_s", F.sum("_c").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    at = d.groupBy(by).agg(F.max_by(order, F.struct(F.round(F.abs("_s"), 9), -F.col(order))).alias("at"), F.max(F.abs("_s")).alias("peak"), F.stddev_pop(y).alias("sd"), F.count("*").alias("n"))
    m = df.join(at, by).groupBy(by).agg(F.avg(F.when(F.col(order) <= F.col("at"), F.col(y))).alias("before"), F.avg(F.when(F.col(order) > F.col("at"), F.col(y))).alias("after"))
    return at.join(m, by).select(by, "at", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), (F.col("peak") > F.col("sd") * F.sqrt("n")).alias("significant"))


def feasibility(df: DataFrame, by: str, y: str) -> DataFrame:
    """Whether a series is long and steady enough to be forecast."""
    g = df.groupBy(by).agg(F.count(y).alias("n"), F.try_divide(F.stddev_samp(y), F.avg(y)).alias("cv"))
    return g.select(by, "n", F.when(F.col("n") < 3, "too short").when(F.col("n") < 8, "trend only").otherwise("feasible").alias("verdict"), (F.col("cv") > 0.2).alias("unsteady"))


def holt(df: DataFrame, by: str, order: str, y: str, steps: int = 3) -> DataFrame:
    """Holt's linear smoothing with the best of a grid of factors: forecasts, mean absolute and root mean square errors.

    A group is one series and is smoothed in one task; build series by aggregation first.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[y].to_numpy(float)
        best = None
        for a in np.arange(0.1, 1.0, 0.2):
            for b in np.arange(0.1, 1.0, 0.2):
                level, slope, errors = v[0], (v[1] - v[0] if len(v) > 1 else 0.0), []
                for x in v[1:]:
                    errors.append(x - level - slope)
                    last, level = level, a * x + (1 - a) * (level + slope)
                    slope = b * (level - last) + (1 - b) * slope
                e = np.array(errors or [0.0])
                if best is None or (e**2).sum() < best[0]:
                    best = ((e**2).sum(), a, b, level, slope, np.abs(e).mean(), np.sqrt((e**2).mean()))
        _, a, b, level, slope, mae, rmse = best
        return pd.DataFrame({by: [pdf[by].iloc[0]] * steps, "step": range(1, steps + 1), "forecast": [round(level + k * slope, 6) for k in range(1,
            steps + 1)], "alpha": a, "beta": b, "mae": round(mae, 6), "rmse": round(rmse, 6)})

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, order, y).groupBy(by).applyInPandas(one, f"{by} {kind}, step int, forecast double, alpha double, beta double, mae double, rmse double")


def arma_fit(x: np.ndarray) -> tuple[float, float, float, float, float, float]:
    """phi, theta, variance, log-likelihood, last error and its relative variance of a zero-mean ARMA(1, 1), by exact likelihood.

    Errors come from the innovations recursion, the variance in closed form; phi and theta from a grid that is refined.
    """

    def likelihood(phi: float, theta: float):
        guess, v, total, logs, e = 0.0, (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi), 0.0, 0.0, 0.0
        for value in x:
            e, last = value - guess, v
            total += e * e / v
            logs += math.log(v)
            guess = phi * value + theta * e / v
            v = 1 + theta * theta - theta * theta / v
        var = max(total / len(x), 1e-300)
        return -0.5 * (len(x) * (math.log(2 * math.pi * var) + 1) + logs), var, guess

    best, at, width = -math.inf, (0.0, 0.0), 0.24
    points = [(p, t) for p in np.arange(-0.96, 0.97, 0.24) for t in np.arange(-0.96, 0.97, 0.24)]
    for _ in range(14):
        for p, t in points:
            if abs(p) < 0.999 and abs(t) < 0.999 and (ll := likelihood(p, t)[0]) > best:
                best, at = ll, (float(p), float(t))
        width /= 2
        points = [(at[0] + i * width, at[1] + j * width) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    ll, var, guess = likelihood(*at)
    return (*at, var, ll, guess, len(x))


def arima(df: DataFrame, by: str, order: str, y: str, steps: int = 3, least: int = 8) -> DataFrame:
    """ARIMA(1, 1, 1) without a constant: forecasts, AIC and BIC of each series of `least` values or more.

    A group is one series and is fitted in one task; build series by aggregation first.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[y].dropna().to_numpy(float)
        if len(v) < least:
            none = np.empty(0)
            return pd.DataFrame({by: pdf[by].iloc[:0], "step": none.astype("int32"), "forecast": none, "aic": none, "bic": none})
        phi, _, _, ll, guess, n = arma_fit(np.diff(v))
        change = guess * phi ** np.arange(steps)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * steps, "step": range(1, steps + 1), "forecast": (v[-1] + np.cumsum(change)).round(4), "aic": round(6 - 2 * ll, 2), "bic": round(3 * math.log(n) - 2 * ll, 2)})

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, order, y).groupBy(by).applyInPandas(one, f"{by} {kind}, step int, forecast double, aic double, bic double")
