"""Confusion counts and the diagnostic metrics that follow from them.

`fp_rule`: a fabricated code counts as a false positive where the source has the element ("source_present") or where it
has not ("source_absent"). `fab_def`: the fabrication rate is FP over all positives called ("ppv", 0 without any), over
all negatives ("fpr") or over all counted ("total"). A metric whose denominator is 0 is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.annotations import numeric_code

COUNTS = ("tp", "fp", "fn", "tn")


def outcome_flags(source: Column, code: Column, fp_rule: str = "source_present") -> dict[str, Column]:
    """Boolean columns of the four outcomes."""
    n = numeric_code(code)
    fp_source = {"source_present": 1, "source_absent": 0}[fp_rule]
    return {
        "tp": (source == 1) & (n == 1),
        "fp": (source == fp_source) & (n == 3),
        "fn": (source == 1) & (n == 2),
        "tn": (source == 0) & (code == "N/A"),
    }


def confusion_counts(long: DataFrame, by: list[str], *, fp_rule: str = "source_present", complete_case: bool = False) -> DataFrame:
    """tp, fp, fn, tn of each group. complete_case: only rows with a source and a code."""
    rows = long.where("source is not null and code is not null") if complete_case else long
    flags = outcome_flags(F.col("source"), F.col("code"), fp_rule)
    return rows.groupBy(*by).agg(*(F.count_if(c).alias(k) for k, c in flags.items()))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def metric_columns(fab_def: str = "ppv", digits: int | None = 6) -> dict[str, Column]:
    """The metrics as columns over tp, fp, fn and tn."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    total = tp + fp + fn + tn
    sens, spec, ppv = _ratio(tp, tp + fn), _ratio(tn, tn + fp), _ratio(tp, tp + fp)
    fab = {"ppv": F.coalesce(_ratio(fp, tp + fp), F.lit(0.0)), "fpr": _ratio(fp, fp + tn), "total": _ratio(fp, total)}[fab_def]
    out = {
        "sensitivity": sens,
        "specificity": spec,
        "ppv": ppv,
        "npv": _ratio(tn, tn + fn),
        "accuracy": _ratio(tp + tn, total),
        "f1": F.try_divide(2 * ppv * sens, ppv + sens),
        "fabrication_rate": fab,
        "prevalence": _ratio(tp + fn, total),
        "balanced_accuracy": (sens + spec) / 2,
    }
    return {k: F.round(c, digits) if digits is not None else c for k, c in out.items()}


def with_metrics(counts: DataFrame, fab_def: str = "ppv", digits: int | None = 6) -> DataFrame:
    return counts.withColumns(metric_columns(fab_def, digits))


def counts_sql(fp: int = 1) -> str:
    return f"""CAST(count(*) FILTER (source = 1 AND code = '1') AS BIGINT) AS tp, CAST(count(*) FILTER (source = {fp} AND code = '3') AS BIGINT) AS fp,
      CAST(count(*) FILTER (source = 1 AND code = '2') AS BIGINT) AS fn, CAST(count(*) FILTER (source = 0 AND code = 'N/A') AS BIGINT) AS tn"""


def metrics_sql(fab: str = "coalesce(fp / nullif(tp + fp, 0), 0.0)") -> str:
    return f"""round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS ppv,
      round(tn / nullif(tn + fn, 0), 6) AS npv, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy,
      round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1,
      round({fab}, 6) AS fabrication_rate, round((tp + fn) / nullif(tp + fp + fn + tn, 0), 6) AS prevalence,
      round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy"""
