"""Queries for paired tests, intervals and the bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.numeric import Z95, agresti_coull, poisson_weight_sql, wilson
from quillon.operators import inference as I
from quillon.operators.agreement import case_accuracy, correct
from quillon.operators.annotations import CTE, domain_bridge
from quillon.operators.confusion import COUNTS, counts_sql, metric_columns
from quillon.plans.annotation_queries import BY_ELEMENT, confusion_by_element, long, wide
from quillon.plans.register import query

W = f"WITH {CTE}"
_OK = "source IS NOT NULL AND human IS NOT NULL AND ai IS NOT NULL"
_R = "((source = 1 AND {0} = '1') OR (source = 0 AND {0} = 'N/A'))"
_MASKS = {
    "accuracy": ("true", _R.format("human"), _R.format("ai")),
    "sensitivity": ("source = 1", "human = '1'", "ai = '1'"),
    "specificity": ("source = 0", "human = 'N/A'", "ai = 'N/A'"),
    "ppv": ("human IN ('1','3') AND ai IN ('1','3')", "source = 1 AND human = '1'", "source = 1 AND ai = '1'"),
    "npv": ("human = 'N/A' AND ai = 'N/A'", "source = 0", "source = 0"),
    "fabrication": ("true", "human <> '3'", "ai <> '3'"),
}
DISC = ", d AS (" + " UNION ALL ".join(
    f"SELECT element, '{k}' AS metric, count(*) FILTER ({m}) AS n, count(*) FILTER ({m} AND ({h}) AND NOT ({a})) AS b, count(*) "
        f"FILTER ({m} AND NOT ({h}) AND ({a})) AS c FROM wide0 WHERE {_OK} GROUP BY element"
    for k, (m, h, a) in _MASKS.items()
) + ")"
TAIL = "CASE WHEN b + c > 0 THEN list_sum(list_transform(range(c, b + c + 1), lambda k: exp(lgamma(b + c + 1.0) - lgamma(k + 1.0) - lgamma(b + c - k + 1.0) - (b + c) * ln(2.0)))) END"


@query("paired_masks", f"{W}{DISC} SELECT * FROM d")
def paired_masks(spark, sf_dir):
    return I.discordant(wide(spark, sf_dir), ["element"])


@query("mcnemar_exact", f"{W}{DISC} SELECT element, metric, n, b, c, round({TAIL}, 6) AS p FROM d")
def mcnemar_exact(spark, sf_dir):
    return I.mcnemar(wide(spark, sf_dir), ["element"])


@query("domain_min_p", f"{W}{DISC}, p AS (SELECT element, metric, {TAIL} AS p FROM d) SELECT domain, metric, round(min(p), 6) AS min_p FROM p JOIN bridge USING (element) GROUP BY ALL")
def domain_min_p(spark, sf_dir):
    p = I.mcnemar(wide(spark, sf_dir), ["element"]).join(F.broadcast(domain_bridge(spark)), "element")
    return p.groupBy("domain", "metric").agg(F.min("p").alias("min_p"))


@query("holm_adjusted",
    f"""{W}{DISC}, p AS (SELECT element, round({TAIL}, 6) AS p FROM d WHERE metric = 'accuracy'), r AS (SELECT element, p, row_number() OVER (ORDER BY p, element) AS k, count(*) OVER () AS m FROM p)
SELECT element, p, round(least(1.0, max((m - k + 1) * p) OVER (ORDER BY k)), 6) AS p_holm FROM r""")
def holm_adjusted(spark, sf_dir):
    from pyspark.sql import Window

    p = I.mcnemar(wide(spark, sf_dir), ["element"]).where("metric = 'accuracy'").select("element", "p")
    w = Window.orderBy("p", "element")  # one row for each element
    r = p.withColumn("k", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy()))
    return r.select("element", "p", F.round(F.least(F.lit(1.0), F.max((F.col("m") - F.col("k") + 1) * F.col("p")).over(w.rowsBetween(Window.unboundedPreceding, 0))), 6).alias("p_holm"))


def _wilson_sql(x: str, n: str, z: float = Z95) -> tuple[str, str]:
    p, nn = f"({x} / nullif({n}, 0))", f"nullif({n}, 0)"
    mid, half = f"(({p} + {z * z} / (2 * {nn})) / (1 + {z * z} / {nn}))", f"({z} * sqrt({p} * (1 - {p}) / {nn} + {z * z} / (4 * {nn} * {nn})) / (1 + {z * z} / {nn}))"
    return f"CASE WHEN {n} > 0 THEN greatest({mid} - {half}, 0.0) END", f"CASE WHEN {n} > 0 THEN least({mid} + {half}, 1.0) END"


_OWN = {"sensitivity": ("tp", "tp + fn"), "specificity": ("tn", "tn + fp"), "ppv": ("tp", "tp + fp"), "npv": ("tn", "tn + fn"), "accuracy": ("tp + tn", "tp + fp + fn + tn")}


@query("diagnostic_wilson",
    BY_ELEMENT + ", x AS (" + " UNION ALL ".join(f"SELECT element, annotator, '{k}' AS metric, {x} AS x, {n} AS n FROM c" for k, (x,
    n) in _OWN.items()) + f") SELECT element, annotator, metric, x, n, round({_wilson_sql('x', 'n')[0]}, 6) AS lo, round({_wilson_sql('x', 'n')[1]}, 6) AS hi FROM x")
def diagnostic_wilson(spark, sf_dir):
    parts = F.array(*(F.struct(F.lit(k).alias("metric"), F.expr(x).alias("x"), F.expr(n).alias("n")) for k, (x, n) in _OWN.items()))
    x = confusion_by_element(spark, sf_dir).select("element", "annotator", F.explode(parts).alias("s")).select("element", "annotator", "s.*")
    lo, hi = wilson(F.col("x"), F.col("n"))
    return x.withColumns({"lo": F.round(lo, 6), "hi": F.round(hi, 6)})


@query("wilson_ci", f"{W}, c AS (SELECT annotator, {counts_sql()} FROM ann GROUP BY ALL) SELECT annotator, tp + tn AS x, tp + fp + fn + tn AS n, "
    f"round({_wilson_sql('(tp + tn)', '(tp + fp + fn + tn)')[0]}, 6) AS lo, round({_wilson_sql('(tp + tn)', '(tp + fp + fn + tn)')[1]}, 6) AS hi FROM c")
def wilson_ci(spark, sf_dir):
    c = confusion_by_element(spark, sf_dir).groupBy("annotator").agg(F.sum(F.col("tp") + F.col("tn")).alias("x"), F.sum(sum((F.col(k) for k in COUNTS), F.lit(0))).cast("long").alias("n"))
    lo, hi = wilson(F.col("x"), F.col("n"))
    return c.withColumns({"lo": F.round(lo, 6), "hi": F.round(hi, 6)})


_M, _P = "(n + 1.96 * 1.96)", "((x + 1.96 * 1.96 / 2) / (n + 1.96 * 1.96))"


@query("agresti_coull_ci", f"{BY_ELEMENT}, x AS (SELECT element, annotator, fp AS x, tp + fp AS n FROM c) SELECT element, annotator, x, n, "
    f"round(greatest({_P} - 1.96 * sqrt({_P} * (1 - {_P}) / {_M}), 0.0), 6) AS lo, round(least({_P} + 1.96 * sqrt({_P} * (1 - {_P}) / {_M}), "
    f"1.0), 6) AS hi FROM x")
def agresti_coull_ci(spark, sf_dir):
    x = confusion_by_element(spark, sf_dir).selectExpr("element", "annotator", "fp as x", "tp + fp as n")
    lo, hi = agresti_coull(F.col("x"), F.col("n"))
    return x.withColumns({"lo": F.round(lo, 6), "hi": F.round(hi, 6)})


_H, _A = _wilson_sql("h", "n"), _wilson_sql("a", "n")


@query("newcombe_diff_ci",
    f"""{W}, x AS (SELECT element, count(*) AS n, count(*) FILTER ({_MASKS['accuracy'][1]}) AS h, count(*) FILTER ({_MASKS['accuracy'][2]}) AS a FROM wide0 WHERE {_OK} GROUP BY element)
SELECT element, round(a / n - h / n, 6) AS diff, round((a / n - h / n) - sqrt(pow(a / n - ({_A[0]}), 2) + pow(({_H[1]}) - h / n, 2)), 6) AS lo,
  round((a / n - h / n) + sqrt(pow(({_A[1]}) - a / n, 2) + pow(h / n - ({_H[0]}), 2)), 6) AS hi FROM x""")
def newcombe_diff_ci(spark, sf_dir):
    s = F.col("source")
    h, a = correct(s, F.col("human")), correct(s, F.col("ai"))
    x = wide(spark, sf_dir).where("source is not null and human is not null and ai is not null").groupBy("element").agg(F.count("*").alias("n"), F.sum(h).alias("h"), F.sum(a).alias("a"))
    n, ph, pa = F.col("n"), F.col("h") / F.col("n"), F.col("a") / F.col("n")
    (hl, hh), (al, ah) = wilson(F.col("h"), n), wilson(F.col("a"), n)
    sq = lambda u, v: F.sqrt(F.pow(u, F.lit(2)) + F.pow(v, F.lit(2)))
    return x.select("element", F.round(pa - ph, 6).alias("diff"), F.round(pa - ph - sq(pa - al, hh - ph), 6).alias("lo"), F.round(pa - ph + sq(ah - pa, ph - hl), 6).alias("hi"))


@query("conditional_mcnemar",
    f"""{W}, d AS (SELECT 'recall' AS kind, count(*) FILTER (human = '1' AND ai <> '1') AS b, count(*) FILTER (human <> '1' AND ai = '1') AS c FROM wide0 WHERE {_OK} AND source = 1
UNION ALL SELECT 'precision', count(*) FILTER (human = '1' AND source = 1 AND NOT (ai = '1' AND source = 1)),
  count(*) FILTER (NOT (human = '1' AND source = 1) AND ai = '1' AND source = 1) FROM wide0 WHERE {_OK} AND human IN ('1','3') AND ai IN ('1','3'))
SELECT kind, b, c, round(CASE WHEN b + c > 0 THEN (abs(b - c) - 1) * (abs(b - c) - 1) / (b + c) END, 6) AS chi2 FROM d""")
def conditional_mcnemar(spark, sf_dir):
    d = I.discordant(wide(spark, sf_dir), []).where("metric in ('sensitivity', 'ppv')")
    kind = F.when(F.col("metric") == "sensitivity", "recall").otherwise("precision")
    return d.select(kind.alias("kind"), "b", "c", F.round(F.expr("try_divide((abs(b - c) - 1) * (abs(b - c) - 1), b + c)"), 6).alias("chi2"))


_CASE = "CASE WHEN source IS NULL OR code IS NULL THEN NULL WHEN (source = 1 AND code = '1') OR (source = 0 AND code = 'N/A') THEN 1 ELSE 0 END"


@query("mann_whitney", f"""{W}, x AS (SELECT case_id, annotator, round(sum({_CASE}) / count({_CASE}), 9) AS v FROM ann GROUP BY ALL HAVING count({_CASE}) > 0),
r AS (SELECT annotator, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM x), t AS (SELECT sum(pow(n, 3) - n) AS ties FROM (SELECT count(*) AS n FROM x GROUP BY v)),
g AS (SELECT sum(r) FILTER (annotator = 'ai') AS w, count(*) FILTER (annotator = 'ai') AS n1, count(*) FILTER (annotator <> 'ai') AS n2 FROM r)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(w - n1 * (n1 + 1) / 2, 6) AS u,
  round((w - n1 * (n1 + 1) / 2 - CAST(n1 AS DOUBLE) * n2 / 2) / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * ((n1 + n2 + 1) - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))), 6) AS z FROM g, t""")
def mann_whitney(spark, sf_dir):
    v = case_accuracy(long(spark, sf_dir), digits=9)
    return I.mann_whitney(v, "accuracy", F.col("annotator") == "ai", [])


@query("wilcoxon_signed",
    f"""{W}, x AS (SELECT case_id, avg(CASE WHEN source IS NULL OR ai IS NULL THEN NULL WHEN {_R.format('ai')} THEN 1.0 ELSE 0.0 END) - avg(CASE
  WHEN source IS NULL OR human IS NULL THEN NULL WHEN {_R.format('human')} THEN 1.0 ELSE 0.0 END) AS d0 FROM wide0 GROUP BY case_id),
y AS (SELECT round(d0, 9) AS d FROM x WHERE round(d0, 9) <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r
  FROM y), t AS (SELECT sum(pow(n, 3) - n) AS ties FROM (SELECT count(*) AS n FROM y GROUP BY abs(d))),
g AS (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, CAST(count(*) AS DOUBLE) AS n FROM r)
SELECT CAST(n AS BIGINT) AS n, round(w, 6) AS w_plus, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM g, t""")
def wilcoxon_signed(spark, sf_dir):
    s = F.col("source")
    x = wide(spark, sf_dir).groupBy("case_id").agg(F.round(F.avg(correct(s, F.col("ai"))) - F.avg(correct(s, F.col("human"))), 9).alias("d"))
    return I.wilcoxon(x, "d", [])


#: Resamples: of metrics and differences, and of the test for fabrication.
REPS, FAB_REPS, SEED = 2000, 5000, 42


def _boot_sql(rows: str, by: tuple[str, ...], counts: tuple[str, ...], reps: int) -> str:
    """bootstrap_counts() in SQL: replicates of patterns of equal counts."""
    u = lambda j: f"CAST('0x' || substr(md5('{SEED}:' || b || ':' || pattern || ':' || {j}), 1, 8) AS BIGINT)"
    key = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in (*by, *COUNTS))
    few = f"CAST(list_sum(list_transform(range(1, least(n, {I.ONE_BY_ONE}) + 1), lambda j: {poisson_weight_sql(u('j'))})) AS BIGINT)"
    z = f"(sqrt(-2 * ln(({u(-1)} + 0.5) / 4294967296.0)) * cos(2 * pi() * (({u(-2)} + 0.5) / 4294967296.0)))"
    sums = ", ".join(f"sum({c} * w) AS {c}" for c in COUNTS)
    return f"""per AS (SELECT case_id, {", ".join(by)}, {", ".join(counts)} FROM {rows} GROUP BY ALL),
  whole AS (SELECT case_id, string_agg({key}, ';' ORDER BY {key}) AS pattern, min(case_id) AS c FROM per GROUP BY case_id),
  pats AS (SELECT pattern, count(*) AS n, min(c) AS c FROM whole GROUP BY pattern),
  drawn AS (SELECT pattern, b, c, CASE WHEN n <= {I.ONE_BY_ONE} THEN {few} ELSE CAST(greatest(round(n + sqrt(n) * {z} + ({z} * {z} - 1) / 6), 0) AS BIGINT) END AS w FROM pats, (SELECT unnest(range(1, {reps + 1})) AS b)),
  boot AS (SELECT b, {", ".join(by)}, {sums} FROM drawn JOIN per ON per.case_id = drawn.c WHERE w > 0 GROUP BY b, {", ".join(by)})"""


_ALL = (counts_sql(),)
BOOT = f"{W}, {_boot_sql('ann', ('annotator',), _ALL, REPS)}"
FAB_BOOT = f"{W}, {_boot_sql('ann', ('annotator',), _ALL, FAB_REPS)}"
_MS = {"accuracy": "(tp + tn) / nullif(tp + fp + fn + tn, 0)", "sensitivity": "tp / nullif(tp + fn, 0)", "specificity": "tn / nullif(tn + fp, 0)",
    "fabrication_rate": "coalesce(fp / nullif(tp + fp, 0), 0.0)"}


@query("bootstrap_ci_metrics",
    BOOT + " SELECT annotator, " + ", ".join(f"round(quantile_cont({m}, 0.025), 6) AS {k}_lo, round(quantile_cont({m}, 0.975), 6) AS {k}_hi" for k,
    m in _MS.items()) + " FROM boot GROUP BY annotator")
def bootstrap_ci_metrics(spark, sf_dir):
    b = I.bootstrap_counts(long(spark, sf_dir), "case_id", ["annotator"], REPS, SEED)
    m = metric_columns(digits=None)
    q = lambda c, p: F.round(F.percentile(c, p), 6)
    return b.groupBy("annotator").agg(*(x for k in _MS for x in (q(m[k], 0.025).alias(f"{k}_lo"), q(m[k], 0.975).alias(f"{k}_hi"))))


_F1 = "2 * tp / nullif(2 * tp + fp + fn, 0)"


@query("bootstrap_f1_diff", f"{BOOT}, p AS (SELECT b, max({_F1}) FILTER (annotator = 'ai') - max({_F1}) FILTER (annotator = 'human') AS d FROM boot GROUP BY b) "
    f"SELECT round(avg(d), 6) AS mean_diff, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(avg(CASE "
    f"WHEN d < 0 THEN 1.0 ELSE 0.0 END), 6) AS p_below FROM p")
def bootstrap_f1_diff(spark, sf_dir):
    b = I.bootstrap_counts(long(spark, sf_dir), "case_id", ["annotator"], REPS, SEED)
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    d = b.groupBy("b").agg((F.max(F.when(F.col("annotator") == "ai", f1)) - F.max(F.when(F.col("annotator") == "human", f1))).alias("d"))
    return d.agg(F.round(F.avg("d"), 6).alias("mean_diff"), F.round(F.percentile("d", 0.025), 6).alias("lo"), F.round(F.percentile("d", 0.975),
        6).alias("hi"), F.round(F.avg((F.col("d") < 0).cast("double")), 6).alias("p_below"))


@query("bootstrap_fab_pvalue", f"{FAB_BOOT}, p AS (SELECT b, max({_MS['fabrication_rate']}) FILTER (annotator = 'human') - max({_MS['fabrication_rate']}) "
    f"FILTER (annotator = 'ai') AS d FROM boot GROUP BY b) SELECT count(*) AS reps, round((count(*) FILTER (d <= 0) + 1) / (count(*) + 1), 6) "
    f"AS p FROM p")
def bootstrap_fab_pvalue(spark, sf_dir):
    b = I.bootstrap_counts(long(spark, sf_dir), "case_id", ["annotator"], FAB_REPS, SEED)
    fab = metric_columns(digits=None)["fabrication_rate"]
    d = b.groupBy("b").agg((F.max(F.when(F.col("annotator") == "human", fab)) - F.max(F.when(F.col("annotator") == "ai", fab))).alias("d"))
    return d.agg(F.count("*").alias("reps"), F.round((F.count_if(F.col("d") <= 0) + 1) / (F.count("*") + 1), 6).alias("p"))


@query("bootstrap_domain", f"""{W}, {_boot_sql('ann JOIN bridge USING (element)', ('domain', 'annotator'), _ALL, REPS)}
SELECT domain, annotator, round(quantile_cont({_MS['accuracy']}, 0.025), 6) AS lo, round(quantile_cont({_MS['accuracy']}, 0.975), 6) AS hi FROM boot GROUP BY ALL""")
def bootstrap_domain(spark, sf_dir):
    rows = long(spark, sf_dir).join(F.broadcast(domain_bridge(spark)), "element")
    b = I.bootstrap_counts(rows, "case_id", ["domain", "annotator"], REPS, SEED)
    acc = metric_columns(digits=None)["accuracy"]
    return b.groupBy("domain", "annotator").agg(F.round(F.percentile(acc, 0.025), 6).alias("lo"), F.round(F.percentile(acc, 0.975), 6).alias("hi"))


@query("bootstrap_mean",
    f"""{BY_ELEMENT}, v AS (SELECT element, annotator, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS v, row_number() OVER (PARTITION BY annotator ORDER BY element) - 1 AS k,
  count(*) OVER (PARTITION BY annotator) AS n FROM c),
draw AS (SELECT v.annotator, b, CAST('0x' || substr(md5('{SEED}:' || b || ':' || v.k), 1, 8) AS BIGINT) % v.n AS k FROM v, (SELECT unnest(range(1, 201)) AS b)),
m AS (SELECT d.annotator, d.b, avg(v.v) AS m FROM draw d JOIN v ON v.annotator = d.annotator AND v.k = d.k GROUP BY ALL)
SELECT annotator, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY annotator""")
def bootstrap_mean(spark, sf_dir):
    """Resamples of the elements' values; as many rows as elements times resamples."""
    from pyspark.sql import Window

    from quillon.functions.numeric import hash_uniform

    w = Window.partitionBy("annotator")
    v = confusion_by_element(spark, sf_dir).select("element", "annotator", metric_columns(digits=None)["accuracy"].alias("v"))
    v = v.withColumn("k", F.row_number().over(w.orderBy("element")) - 1).withColumn("n", F.count("*").over(w))
    draw = v.select("annotator", "n", "k", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("b")).select("annotator", "b",
        F.pmod(hash_uniform(F.lit(SEED), F.col("b"), F.col("k")), F.col("n")).alias("k"))
    m = draw.join(v.select("annotator", F.col("k").cast("long").alias("k"), "v"), ["annotator", "k"]).groupBy("annotator", "b").agg(F.avg("v").alias("m"))
    return m.groupBy("annotator").agg(F.round(F.percentile("m", 0.025), 6).alias("lo"), F.round(F.percentile("m", 0.975), 6).alias("hi"))


def bootstrap_by_element(spark, sf_dir, names: tuple[str, ...]):
    """2.5 and 97.5 % quantiles of metrics over resamples of each element's rows: <name>_lo, <name>_hi.

    An element has one row a case, so its resamples are Poisson weights of its few kinds of rows. An interval needs ten
    resamples in which the metric is defined.
    """
    rows = long(spark, sf_dir).withColumn("row", F.concat_ws("/", "element", F.col("case_id").cast("string")))
    b = I.bootstrap_counts(rows, "row", ["element", "annotator"], REPS, SEED)
    m = metric_columns(digits=None)
    q = lambda c, p: F.when(F.count(c) >= 10, F.round(F.percentile(c, p), 6))
    return b.groupBy("element", "annotator").agg(*(x for k in names for x in (q(m[k], 0.025).alias(f"{k}_lo"), q(m[k], 0.975).alias(f"{k}_hi"))))


def bootstrap_by_element_sql(names: tuple[str, ...]) -> str:
    rows = "(SELECT element || '/' || case_id AS case_id, element, annotator, source, code FROM ann)"
    m = {k: x for k, x in _metric_sql().items() if k in names}
    each = ", ".join(f"CASE WHEN count({x}) >= 10 THEN round(quantile_cont({x}, {p}), 6) END AS {k}_{s}" for k, x in m.items() for p, s in ((0.025, "lo"), (0.975, "hi")))
    return f"{_boot_sql(rows, ('element', 'annotator'), _ALL, REPS)}, ci AS (SELECT element, annotator, {each} FROM boot GROUP BY ALL)"


def _metric_sql() -> dict[str, str]:
    sens, spec, ppv = "(tp / nullif(tp + fn, 0))", "(tn / nullif(tn + fp, 0))", "(tp / nullif(tp + fp, 0))"
    return {**_MS, "ppv": ppv, "npv": "(tn / nullif(tn + fn, 0))", "f1": f"(2 * {ppv} * {sens} / nullif({ppv} + {sens}, 0))", "balanced_accuracy": f"(({sens} + {spec}) / 2)"}
