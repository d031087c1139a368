"""Queries over coded annotations: outcomes, diagnostic metrics, roll-ups and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import agreement as G
from quillon.operators.annotations import CTE, domain_bridge, from_lineitem, long_form, numeric_code
from quillon.operators.confusion import COUNTS, confusion_counts, counts_sql, metric_columns, metrics_sql, outcome_flags, with_metrics
from quillon.plans.register import query
from quillon.sources.tables import table


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_lineitem(table(spark, sf_dir, "lineitem"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(wide(spark, sf_dir))


W = f"WITH {CTE}"
BY_ELEMENT = f"{W}, c AS (SELECT element, annotator, {counts_sql()} FROM ann GROUP BY ALL)"


@query("confusion_by_element", f"{BY_ELEMENT} SELECT * FROM c")
def confusion_by_element(spark, sf_dir):
    return confusion_counts(long(spark, sf_dir), ["element", "annotator"])


@query("confusion_rates", f"{BY_ELEMENT} SELECT element, annotator, tp + fn AS positives, fp + tn AS negatives, tp + fp + fn + tn AS observations, "
    f"round(tp / nullif(tp + fn, 0), 6) AS tpr, round(fn / nullif(tp + fn, 0), 6) AS fnr, round(fp / nullif(fp + tn, 0), 6) AS fpr, "
    f"round(tn / nullif(fp + tn, 0), 6) AS tnr FROM c")
def confusion_rates(spark, sf_dir):
    c = confusion_counts(long(spark, sf_dir), ["element", "annotator"])
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    rate = lambda a, b: F.round(F.try_divide(F.col(a), b), 6)
    return c.select("element", "annotator", p.alias("positives"), n.alias("negatives"), (p + n).alias("observations"), rate("tp", p).alias("tpr"),
        rate("fn", p).alias("fnr"), rate("fp", n).alias("fpr"), rate("tn", n).alias("tnr"))


@query("confusion_frame", f"{W}, c AS (SELECT annotator, {counts_sql()} FROM ann GROUP BY ALL) SELECT annotator, 'positive' AS predicted, tp AS true_positive, fp "
    f"AS true_negative FROM c UNION ALL SELECT annotator, 'negative', fn, tn FROM c")
def confusion_frame(spark, sf_dir):
    c = confusion_counts(long(spark, sf_dir), ["annotator"])
    return c.selectExpr("annotator", "stack(2, 'positive', tp, fp, 'negative', fn, tn) as (predicted, true_positive, true_negative)")


@query("metrics_by_element", f"{BY_ELEMENT} SELECT *, {metrics_sql()} FROM c")
def metrics_by_element(spark, sf_dir):
    return with_metrics(confusion_by_element(spark, sf_dir))


@query("metrics_fp_rule_b",
    f"{W}, c AS (SELECT element, annotator, {counts_sql(0)} FROM ann WHERE source IS NOT NULL AND code IS NOT NULL GROUP BY ALL) SELECT *, {metrics_sql('fp / nullif(tp + fp + fn + tn, 0)')} FROM c")
def metrics_fp_rule_b(spark, sf_dir):
    return with_metrics(confusion_counts(long(spark, sf_dir), ["element", "annotator"], fp_rule="source_absent", complete_case=True), "total")


@query("metrics_fab_fpr", f"{BY_ELEMENT} SELECT element, annotator, fp, tn, round(fp / nullif(fp + tn, 0), 6) AS fabrication_rate FROM c")
def metrics_fab_fpr(spark, sf_dir):
    return with_metrics(confusion_by_element(spark, sf_dir), "fpr").select("element", "annotator", "fp", "tn", "fabrication_rate")


@query("run_metrics",
    f"""{W}, c AS (SELECT coalesce(element, '__AGGREGATE__') AS element, annotator, {counts_sql(0)} FROM ann WHERE source IS NOT NULL AND code IS NOT NULL
  GROUP BY GROUPING SETS ((element, annotator), (annotator)))
SELECT element, annotator, tp, fp, fn, tn, tp + fp + fn + tn AS total_evaluated, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 4) AS accuracy,
  round(fp / nullif(tp + fp + fn + tn, 0), 4) AS fabrication_rate FROM c""")
def run_metrics(spark, sf_dir):
    rows = long(spark, sf_dir).where("source is not null and code is not null")
    flags = outcome_flags(F.col("source"), F.col("code"), "source_absent")
    one = rows.select("element", "annotator", *(c.cast("int").alias(k) for k, c in flags.items()))
    c = one.groupingSets([["element", "annotator"], ["annotator"]], "element", "annotator").agg(*(F.sum(k).alias(k) for k in COUNTS))
    total = sum((F.col(k) for k in COUNTS), F.lit(0))
    rate = lambda x: F.round(F.try_divide(x, total), 4)
    return c.select(F.coalesce("element", F.lit("__AGGREGATE__")).alias("element"), "annotator", *COUNTS, total.cast("long").alias("total_evaluated"),
        rate(F.col("tp") + F.col("tn")).alias("accuracy"), rate(F.col("fp")).alias("fabrication_rate"))


@query("metrics_by_domain_pooled", f"{W}, c AS (SELECT domain, annotator, {counts_sql()} FROM ann JOIN bridge USING (element) GROUP BY ALL) SELECT *, {metrics_sql()} FROM c")
def metrics_by_domain_pooled(spark, sf_dir):
    # Counts are summed over elements first: the bridge joins a few rows, not the annotations.
    per = confusion_counts(long(spark, sf_dir), ["element", "annotator"]).join(F.broadcast(domain_bridge(spark)), "element")
    return with_metrics(per.groupBy("domain", "annotator").agg(*(F.sum(k).alias(k) for k in COUNTS)))


BALANCED = ("sensitivity", "specificity", "accuracy", "f1", "fabrication_rate")


@query("metrics_by_domain_balanced", f"{BY_ELEMENT}, m AS (SELECT element, annotator, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity, "
    f"(tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, "
    f"0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0) AS f1, coalesce(fp / nullif(tp + fp, 0), 0.0) AS fabrication_rate "
    f"FROM c) SELECT domain, annotator, count(*) AS n_elements, " + ", ".join(f"round(avg({k}), 6) AS {k}" for k in BALANCED) + " FROM m JOIN bridge USING (element) GROUP BY ALL")
def metrics_by_domain_balanced(spark, sf_dir):
    m = with_metrics(confusion_by_element(spark, sf_dir), digits=None).join(F.broadcast(domain_bridge(spark)), "element")
    return m.groupBy("domain", "annotator").agg(F.count("*").alias("n_elements"), *(F.round(F.avg(k), 6).alias(k) for k in BALANCED))


@query("metrics_overall_grouping_sets", f"{W}, c AS (SELECT coalesce(domain, 'ALL') AS domain, coalesce(element, 'ALL') AS element, annotator, {counts_sql()} FROM ann "
    f"JOIN bridge USING (element) GROUP BY GROUPING SETS ((domain, element, annotator), (domain, annotator), (annotator))) SELECT *, {metrics_sql()} FROM c")
def metrics_overall_grouping_sets(spark, sf_dir):
    per = confusion_counts(long(spark, sf_dir), ["element", "annotator"]).join(F.broadcast(domain_bridge(spark)), "element")
    sets = per.groupingSets([["domain", "element", "annotator"], ["domain", "annotator"], ["annotator"]], "domain", "element", "annotator").agg(*(F.sum(k).alias(k) for k in COUNTS))
    return with_metrics(sets.select(F.coalesce("domain", F.lit("ALL")).alias("domain"), F.coalesce("element", F.lit("ALL")).alias("element"), "annotator", *COUNTS))


STATUS = "CASE WHEN code = '1' THEN 'correct' WHEN code = '2' THEN 'omitted' WHEN code = '3' THEN 'fabricated' WHEN code IS NULL THEN 'missing' ELSE 'other' END"
STATES = ("correct", "omitted", "fabricated", "missing", "other")


@query("status_counts_pivot", f"{W} SELECT element, annotator, " + ", ".join(f"count(*) FILTER ({STATUS} = '{s}') AS {s}" for s in STATES) + " FROM ann GROUP BY ALL")
def status_counts_pivot(spark, sf_dir):
    return long(spark, sf_dir).withColumn("status", G.status(F.col("code"))).groupBy("element", "annotator").pivot("status", list(STATES)).count().fillna(0)


@query("obs_totals", f"{W} SELECT annotator, {STATUS} AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY annotator), 6) AS share FROM ann GROUP BY annotator, status")
def obs_totals(spark, sf_dir):
    from pyspark.sql import Window

    n = long(spark, sf_dir).groupBy("annotator", G.status(F.col("code")).alias("status")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("annotator")), 6))


@query("element_wide_delta", f"{BY_ELEMENT}, m AS (SELECT element, annotator, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, tp / nullif(tp + fn, 0) "
    f"AS sensitivity FROM c) SELECT h.element, round(h.accuracy, 6) AS accuracy_human, round(a.accuracy, 6) AS accuracy_ai, "
    f"round(a.accuracy - h.accuracy, 6) AS accuracy_delta, round(h.sensitivity, 6) AS sensitivity_human, round(a.sensitivity, 6) "
    f"AS sensitivity_ai, round(a.sensitivity - h.sensitivity, 6) AS sensitivity_delta FROM m h JOIN m a ON h.element = a.element "
    f"AND h.annotator = 'human' AND a.annotator = 'ai'")
def element_wide_delta(spark, sf_dir):
    m = metric_columns(digits=None)
    c = confusion_by_element(spark, sf_dir).select("element", "annotator", m["accuracy"].alias("accuracy"), m["sensitivity"].alias("sensitivity"))
    p = c.groupBy("element").pivot("annotator", ["human", "ai"]).agg(F.first("accuracy").alias("a"), F.first("sensitivity").alias("s"))
    r = lambda x: F.round(x, 6)
    return p.select("element", r("human_a").alias("accuracy_human"), r("ai_a").alias("accuracy_ai"),
        r(F.col("ai_a") - F.col("human_a")).alias("accuracy_delta"), r("human_s").alias("sensitivity_human"), r("ai_s").alias("sensitivity_ai"),
        r(F.col("ai_s") - F.col("human_s")).alias("sensitivity_delta"))


@query("acc_vs_balanced",
    f"""{BY_ELEMENT}, m AS (SELECT element, annotator, tp + fn AS n_positive, tn + fp AS n_negative, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_accuracy FROM c)
SELECT element, annotator, n_positive, n_negative, CASE WHEN n_positive = 0 OR n_negative = 0 THEN 'one class'
  WHEN greatest(n_positive, n_negative) >= 3 * least(n_positive, n_negative) THEN 'imbalanced' ELSE 'balanced' END AS imbalance_flag, round(accuracy, 6) AS accuracy,
  round(balanced_accuracy, 6) AS balanced_accuracy,
  CASE WHEN balanced_accuracy IS NULL THEN 'accuracy' WHEN abs(accuracy - balanced_accuracy) > 0.05 THEN 'balanced_accuracy' ELSE 'either' END AS recommendation FROM m""")
def acc_vs_balanced(spark, sf_dir):
    return G.balance_audit(confusion_by_element(spark, sf_dir))


@query("fabrication_focus", f"{BY_ELEMENT} SELECT element, annotator, fp, tp, round(fp / nullif(tp + fp, 0), 6) AS fabrication_rate, rank() "
    f"OVER (PARTITION BY annotator ORDER BY coalesce(fp / nullif(tp + fp, 0), 0) DESC, element) AS place FROM c")
def fabrication_focus(spark, sf_dir):
    from pyspark.sql import Window

    rate = F.try_divide(F.col("fp"), F.col("tp") + F.col("fp"))
    w = Window.partitionBy("annotator").orderBy(F.coalesce(rate, F.lit(0.0)).desc(), "element")
    return confusion_by_element(spark, sf_dir).select("element", "annotator", "fp", "tp", F.round(rate, 6).alias("fabrication_rate"), F.rank().over(w).alias("place"))


CORRECT = "CASE WHEN source IS NULL OR code IS NULL THEN NULL WHEN (source = 1 AND code = '1') OR (source = 0 AND code = 'N/A') THEN 1 ELSE 0 END"


@query("outcome_labels",
    f"""{W} SELECT annotator, CASE WHEN source IS NULL OR code IS NULL THEN 'not_evaluated' WHEN source = 1 AND code = '1' THEN 'TP' WHEN source = 1 AND code = '2' THEN 'FN'
  WHEN source = 0 AND code = '3' THEN 'FP' WHEN source = 0 AND code = 'N/A' THEN 'TN' ELSE 'unknown' END AS outcome, count(*) AS n FROM ann GROUP BY ALL""")
def outcome_labels(spark, sf_dir):
    return long(spark, sf_dir).groupBy("annotator", G.outcome(F.col("source"), F.col("code")).alias("outcome")).agg(F.count("*").alias("n"))


@query("case_accuracy", f"{W} SELECT case_id, annotator, sum({CORRECT}) AS n_correct, count({CORRECT}) AS n_evaluated, round(sum({CORRECT}) / count({CORRECT}), "
    f"6) AS accuracy FROM ann GROUP BY ALL HAVING count({CORRECT}) > 0")
def case_accuracy(spark, sf_dir):
    return G.case_accuracy(long(spark, sf_dir))


@query("case_complexity_gap",
    f"""{W}, x AS (SELECT case_id, count(*) FILTER (source = 1) AS n_present, sum(CASE WHEN source IS NULL OR human IS NULL THEN NULL
  WHEN (source = 1 AND human = '1') OR (source = 0 AND human = 'N/A') THEN 1 ELSE 0 END) AS h,
  sum(CASE WHEN source IS NULL OR ai IS NULL THEN NULL WHEN (source = 1 AND ai = '1') OR (source = 0 AND ai = 'N/A') THEN 1 ELSE 0 END) AS a, count(*) AS n FROM wide0 GROUP BY case_id)
SELECT CASE WHEN n_present >= (SELECT median(n_present) FROM x) THEN 'complex' ELSE 'simple' END AS complexity, count(*) AS n_cases, round(avg(a / n - h / n), 6) AS mean_gap FROM x GROUP BY ALL""")
def case_complexity_gap(spark, sf_dir):
    return G.complexity_gap(wide(spark, sf_dir))


@query("perfect_cases", f"{W}, x AS (SELECT case_id, annotator, sum({CORRECT}) / count({CORRECT}) AS acc, count({CORRECT}) AS n FROM ann GROUP BY ALL "
    f"HAVING count({CORRECT}) > 0) SELECT annotator, acc = 1 AS perfect, count(*) AS n_cases, round(avg(n), 6) AS mean_evaluated FROM x GROUP BY ALL")
def perfect_cases(spark, sf_dir):
    c = G.case_accuracy(long(spark, sf_dir), digits=None)
    return c.groupBy("annotator", (F.col("accuracy") == 1).alias("perfect")).agg(F.count("*").alias("n_cases"), F.round(F.avg("n_evaluated"), 6).alias("mean_evaluated"))


@query("pseudo_roc_pr", f"""{W}, b AS (SELECT element, annotator, source AS y, CASE WHEN code IN ('1', '3') THEN 1 ELSE 0 END AS p FROM ann WHERE source IS NOT NULL AND code IS NOT NULL),
c AS (SELECT element, annotator, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn,
  count(*) FILTER (y = 0 AND p = 0) AS tn FROM b GROUP BY ALL),
m AS (SELECT *, tp / nullif(tp + fn, 0) AS r, tp / nullif(tp + fp, 0) AS pr, (tp + fn) / nullif(tp + fp + fn + tn, 0) AS prev, tn / nullif(tn + fp, 0) AS sp FROM c)
SELECT element, annotator, round((r + sp) / 2, 6) AS roc_auc, round(CASE WHEN r IS NULL OR sp IS NULL THEN NULL
  ELSE r * (1 + coalesce(pr, 1)) / 2 + (1 - r) * (coalesce(pr, prev) + prev) / 2 END, 6) AS pr_auc FROM m""")
def pseudo_roc_pr(spark, sf_dir):
    return G.binary_curve_areas(long(spark, sf_dir))


@query("cohen_kappa",
    f"""{W}, t AS (SELECT element, human, ai, count(*) AS n FROM wide0 WHERE human IS NOT NULL AND ai IS NOT NULL
  GROUP BY ALL), s AS (SELECT element, sum(n) AS n, sum(n) FILTER (human = ai) AS o FROM t GROUP BY element),
h AS (SELECT element, human AS k, sum(n) AS n FROM t GROUP BY ALL), a AS (SELECT element, ai AS k, sum(n) AS n FROM t
  GROUP BY ALL), e AS (SELECT h.element, sum(h.n * a.n) AS e FROM h JOIN a ON h.element = a.element AND h.k = a.k GROUP BY ALL)
SELECT s.element, CAST(s.n AS BIGINT) AS n, round(s.o / s.n, 6) AS observed, round(e.e / (s.n * s.n), 6) AS expected,
  round((s.o / s.n - e.e / (s.n * s.n)) / nullif(1 - e.e / (s.n * s.n), 0), 6) AS kappa FROM s JOIN e USING (element)""")
def cohen_kappa(spark, sf_dir):
    return G.cohen_kappa(wide(spark, sf_dir), "human", "ai", ["element"])


@query("agreement_rates",
    f"""{W} SELECT element, count(*) AS n, round(avg(CASE WHEN human = ai THEN 1.0 ELSE 0.0 END), 6) AS agreement,
  round(count(*) FILTER (source = 1 AND human = '2') / count(*), 6) AS human_miss_rate, round(count(*) FILTER (source = 1 AND ai = '2') / count(*), 6) AS ai_miss_rate,
  round(count(*) FILTER (human = '3') / count(*), 6) AS human_fab_rate, round(count(*) FILTER (ai = '3') / count(*), 6) AS ai_fab_rate FROM wide0 GROUP BY ALL""")
def agreement_rates(spark, sf_dir):
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    present = F.col("source") == 1
    return wide(spark, sf_dir).groupBy("element").agg(F.count("*").alias("n"), share(F.col("human") == F.col("ai")).alias("agreement"),
        share(present & (F.col("human") == "2")).alias("human_miss_rate"), share(present & (F.col("ai") == "2")).alias("ai_miss_rate"),
        share(F.col("human") == "3").alias("human_fab_rate"), share(F.col("ai") == "3").alias("ai_fab_rate"))


@query("outcome_rates_by_domain", f"{W} SELECT domain, annotator, count(*) AS n, round(avg(CASE WHEN code = '1' THEN 1.0 ELSE 0.0 END), 6) AS correct_rate, round(avg(CASE "
    f"WHEN code = '2' THEN 1.0 ELSE 0.0 END), 6) AS omission_rate, round(avg(CASE WHEN code = '3' THEN 1.0 ELSE 0.0 END), 6) "
    f"AS fabrication_rate FROM ann JOIN bridge USING (element) WHERE code IN ('1', '2', '3') GROUP BY ALL")
def outcome_rates_by_domain(spark, sf_dir):
    coded = long(spark, sf_dir).where(numeric_code(F.col("code")).isin(1, 2, 3))
    n = coded.groupBy("element", "annotator").agg(F.count("*").alias("n"), *(F.count_if(F.col("code") == k).alias(f"k{k}") for k in "123"))
    d = n.join(F.broadcast(domain_bridge(spark)), "element").groupBy("domain", "annotator").agg(*(F.sum(k).alias(k) for k in ("n", "k1", "k2", "k3")))
    return d.select("domain", "annotator", "n", *(F.round(F.col(k) / F.col("n"), 6).alias(a) for k, a in (("k1", "correct_rate"), ("k2", "omission_rate"), ("k3", "fabrication_rate"))))


@query("legacy_accuracy_gap", f"{W}, x AS (SELECT element, count(*) FILTER (source = 1) AS s, count(*) FILTER (human = '1') AS h, count(*) FILTER (ai = '1') AS a "
    f"FROM wide0 GROUP BY ALL) SELECT element, round(h / nullif(s, 0), 6) AS human_accuracy, round(a / nullif(s, 0), 6) AS ai_accuracy, "
    f"round((a - h) / nullif(s, 0), 6) AS gap FROM x")
def legacy_accuracy_gap(spark, sf_dir):
    x = wide(spark, sf_dir).groupBy("element").agg(F.count_if(F.col("source") == 1).alias("s"), F.count_if(F.col("human") == "1").alias("h"), F.count_if(F.col("ai") == "1").alias("a"))
    return x.selectExpr("element", "round(try_divide(h, s), 6) as human_accuracy", "round(try_divide(a, s), 6) as ai_accuracy", "round(try_divide(a - h, s), 6) as gap")


@query("any_code3_rows", f"{W} SELECT case_id, element, human, ai FROM wide0 WHERE human = '3' OR ai = '3'")
def any_code3_rows(spark, sf_dir):
    # COALESCE: a missing code beside a 3 must not hide it.
    return wide(spark, sf_dir).where(F.exists(F.array("human", "ai"), lambda x: F.coalesce(x == "3", F.lit(False)))).select("case_id", "element", "human", "ai")


@query("significance_stars", f"{BY_ELEMENT}, m AS (SELECT element, annotator, fp / nullif(tp + fp + fn + tn, 0) AS p FROM c) SELECT element, annotator, round(p, 6) "
    f"AS p, CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM m")
def significance_stars(spark, sf_dir):
    c = with_metrics(confusion_by_element(spark, sf_dir), "total", digits=None).withColumn("p", F.col("fabrication_rate"))
    return c.select("element", "annotator", F.round("p", 6).alias("p"), G.stars(F.col("p")).alias("stars"))


@query("encode_presence", f"{W} SELECT CASE WHEN source = 1 AND ai = '1' THEN '1' WHEN source = 1 THEN '2' WHEN source = 0 AND ai = '3' THEN '3' WHEN source = 0 "
    f"THEN 'N/A' END AS encoded, count(*) AS n FROM wide0 GROUP BY ALL")
def encode_presence(spark, sf_dir):
    present = F.coalesce(F.when(F.col("source") == 1, F.col("ai") == "1").otherwise(F.col("ai") == "3"), F.lit(False))
    return wide(spark, sf_dir).groupBy(G.encode(F.col("source"), present).alias("encoded")).agg(F.count("*").alias("n"))


@query("delta_order", f"{BY_ELEMENT}, m AS (SELECT element, annotator, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS v FROM c), d AS (SELECT h.element, h.v - a.v "
    f"AS d FROM m h JOIN m a ON h.element = a.element WHERE h.annotator = 'human' AND a.annotator = 'ai') SELECT element, round(d, 6) "
    f"AS delta, row_number() OVER (ORDER BY d, element) AS place FROM d")
def delta_order(spark, sf_dir):
    from pyspark.sql import Window

    c = confusion_by_element(spark, sf_dir).select("element", "annotator", metric_columns(digits=None)["accuracy"].alias("v"))
    d = c.groupBy("element").agg((F.max(F.when(F.col("annotator") == "human", F.col("v"))) - F.max(F.when(F.col("annotator") == "ai", F.col("v")))).alias("d"))
    return d.select("element", F.round("d", 6).alias("delta"), F.row_number().over(Window.orderBy("d", "element")).alias("place"))
