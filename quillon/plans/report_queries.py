"""Queries for report tables: cleaning, element tables with tests, features against correctness, agreement of many raters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions.numeric import binomial_tail
from quillon.operators import evaluation as E
from quillon.operators import reports as R
from quillon.operators import series as S
from quillon.operators.agreement import stars
from quillon.operators.confusion import metrics_sql
from quillon.operators.inference import discordant, mcnemar
from quillon.operators.ranges import quantiles
from quillon.plans.annotation_queries import BY_ELEMENT, confusion_by_element, metrics_by_element, wide
from quillon.plans.inference_queries import DISC, TAIL, W, bootstrap_by_element, bootstrap_by_element_sql
from quillon.plans.register import query
from quillon.plans.text_queries import docs
from quillon.sources.tables import table

D = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"


@query("placeholders_to_null", "SELECT p_partkey, CASE WHEN p_type NOT IN ('PROMO', 'SMALL') THEN p_type END AS p_type, CASE WHEN p_brand NOT IN ('PROMO', 'SMALL') "
    "THEN p_brand END AS p_brand FROM part")
def placeholders_to_null(spark, sf_dir):
    return R.nulled(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"], ("PROMO", "SMALL"))


@query("find_columns", "SELECT 'orders' AS table_name, 'o_orderdate' AS date_column, 'o_orderstatus' AS status_column, CAST(NULL AS VARCHAR) AS absent FROM (SELECT count(*) FROM orders)")
def find_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    found = [R.find_column(o.columns, c) for c in (["date", "O_ORDERDATE "], ["state", "status"], ["nothing"])]
    return spark.createDataFrame([("orders", *found)], "table_name string, date_column string, status_column string, absent string")


@query("drop_identifiers", "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def drop_identifiers(spark, sf_dir):
    return R.without_identifiers(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_phone"], ["c_nationkey", "c_acctbal", "c_mktsegment", "c_name"])[0]


@query("audit_metadata", """SELECT count(*) AS record_count, 'c_custkey|c_name' AS dropped_columns,
'[{"column":"c_name","n_unique":' || count(DISTINCT c_name) || ',"n_missing":' || count(*) FILTER (c_name IS NULL) || '}]' AS surrogates FROM customer""")
def audit_metadata(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("person", F.sha2("c_name", 256))
    kept, gone = R.without_identifiers(c, ["c_name", "c_custkey"])
    return R.audit(kept, gone, {"c_name": "person"})


@query("quantile_bins",
    """WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS m FROM supplier),
b AS (SELECT *, CAST(greatest(ceil((r - 1) * 4 / greatest(m - 1, 1)) - 1, 0) AS INT) AS bin FROM r)
SELECT s_suppkey, s_nationkey, bin, CASE WHEN bin = 3 THEN 1 ELSE 0 END AS is_high, CASE WHEN bin = 0 THEN 1 ELSE 0 END AS is_low FROM b""")
def quantile_bins(spark, sf_dir):
    b = R.quantile_bins(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_acctbal", ["s_suppkey"], ["s_nationkey"])
    return b.select("s_suppkey", "s_nationkey", "bin", (F.col("bin") == 3).cast("int").alias("is_high"), (F.col("bin") == 0).cast("int").alias("is_low"))


_NAMES = ("red", "blue", "small", "ring", "widget")


@query("list_indicators", "SELECT p_partkey, " + ", ".join(f"CAST(list_contains(string_split(replace(p_name, ' ', ';'), ';'), '{n}') AS INT) AS has_{n}" for n in _NAMES) + " FROM part")
def list_indicators(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(" ; ")).alias("l"))
    return p.select("p_partkey", *(c.alias(f"has_{n}") for n, c in R.indicators(p, "l", list(_NAMES)).items()))


@query("first_known_values", "SELECT user_id, arg_min(CASE WHEN event_type <> 'view' THEN event_type END, event_id) FILTER (event_type <> 'view') AS kind, "
    "arg_min(value, event_id) FILTER (value > 5) AS amount FROM events GROUP BY user_id")
def first_known_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
        F.when(F.col("value") > 5, F.col("value")).alias("amount"))
    return R.first_known(e, ["user_id"], "event_id", ["kind", "amount"])


_MISS = "(CASE WHEN source IS NULL THEN 1 ELSE 0 END + CASE WHEN human IS NULL THEN 1 ELSE 0 END + CASE WHEN ai IS NULL THEN 1 ELSE 0 END)"


@query("missing_per_row_stats", f"{W}, m AS (SELECT case_id, sum({_MISS}) AS n FROM wide0 GROUP BY case_id) SELECT round(avg(n), 6) AS mean, round(median(n), 6) "
    f"AS median, CAST(max(n) AS BIGINT) AS most, count(*) FILTER (n > 0) AS n_with_any FROM m")
def missing_per_row_stats(spark, sf_dir):
    miss = sum((F.col(c).isNull().cast("int") for c in ("source", "human", "ai")), F.lit(0))
    m = wide(spark, sf_dir).groupBy("case_id").agg(F.sum(miss).alias("n"))
    mid = quantiles(m, ["n"], [0.5]).select(F.round(F.col("q")[0], 6).alias("median"))
    return m.agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.count_if(F.col("n") > 0).alias("n_with_any")).join(F.broadcast(mid))  # one row each


@query("cohort_value_shares", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) "
    "AS pct FROM orders WHERE o_totalprice < 50000 GROUP BY o_orderstatus, o_orderpriority")
def cohort_value_shares(spark, sf_dir):
    """Values within a cohort (cheap orders of one status) and their share of it."""
    n = table(spark, sf_dir, "orders").where("o_totalprice < 50000").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    whole = n.groupBy("o_orderstatus").agg(F.sum("n").alias("m"))
    return n.join(whole, "o_orderstatus").select("o_orderstatus", "o_orderpriority", "n", F.round(100.0 * F.col("n") / F.col("m"), 6).alias("pct"))


@query("five_numbers",
    """WITH q AS (SELECT event_type, count(value) AS n, min(value) AS lowest, quantile_cont(value, 0.25) AS q25, median(value) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS highest FROM events GROUP BY event_type)
SELECT q.event_type, any_value(n) AS n, any_value(lowest) AS lowest, round(any_value(q25), 6) AS q25, round(any_value(q50), 6) AS q50,
  round(any_value(q75), 6) AS q75, any_value(highest) AS highest, min(value) AS whisker_lo, max(value) AS whisker_hi
FROM events JOIN q USING (event_type) WHERE value >= q25 - 1.5 * (q75 - q25) AND value <= q75 + 1.5 * (q75 - q25) GROUP BY q.event_type""")
def five_numbers(spark, sf_dir):
    f = R.five_numbers(table(spark, sf_dir, "events").select("event_type", "value"), "value", ["event_type"])
    return f.withColumns({c: F.round(c, 6) for c in ("q25", "q50", "q75")})


_FEATS = ("n_chars", "n_words")


@query("features_vs_correctness",
    f"""{D}, f AS (SELECT doc_id, lang, length(text) AS n_chars, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n_words
  FROM d), x AS (SELECT f.*, quality = 1 AS correct FROM f JOIN labels USING (doc_id)),
u AS ({" UNION ALL ".join(f"SELECT lang, correct, '{c}' AS feature, {c} AS v FROM x UNION ALL SELECT 'all', correct, '{c}', {c} FROM x" for c in _FEATS)})
SELECT lang, correct, feature, count(*) AS n, round(avg(v), 2) AS mean, round(median(v), 2) AS median, round(stddev_samp(v), 2) AS std FROM u GROUP BY ALL""")
def features_vs_correctness(spark, sf_dir):
    """Features of documents judged right against those judged wrong, in each language and in all."""
    from quillon.functions.text import basic_features

    f = basic_features(F.col("text"))
    d = docs(spark, sf_dir).select("doc_id", "lang", *(f[k].alias(k) for k in _FEATS)).join(table(spark, sf_dir, "labels"), "doc_id")
    both = d.withColumn("lang", F.explode(F.array(F.col("lang"), F.lit("all")))).withColumn("correct", F.col("quality") == 1)
    return R.features_by_correctness(both, "correct", list(_FEATS), ["lang"])


@query("before_after_deltas",
    """WITH t AS (SELECT page_id, list_distinct(string_split(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), ' ')) AS truth, list_distinct(string_split(lower(html), ' ')) AS before, list_distinct(string_split(lower(regexp_replace(html, '<[a-z][^>]*>', ' ', 'g')), ' ')) AS after FROM pages),
m AS (SELECT page_id, len(list_intersect(before, truth)) AS b, len(before) AS nb, len(list_intersect(after, truth)) AS a, len(after) AS na, len(truth) AS nt FROM t)
SELECT page_id, round(a / nt - b / nt, 4) AS delta_recall, round(a / na - b / nb, 4) AS delta_precision, round(2.0 * a / (na + nt) - 2.0 * b / (nb + nt), 4) AS delta_f1 FROM m""")
def before_after_deltas(spark, sf_dir):
    """What half of a cleaning step does to the words of a page, measured against the whole step."""
    from quillon.operators.vectors import set_scores

    bag = lambda x: F.array_distinct(F.split(F.lower(x), " "))
    p = table(spark, sf_dir, "pages").select("page_id", bag(F.regexp_replace("html", "<[^>]*>", " ")).alias("t"), bag(F.col("html")).alias("b"),
        bag(F.regexp_replace("html", "<[a-z][^>]*>", " ")).alias("a"))
    before, after = (set_scores(F.col(k), F.col("t")) for k in "ba")
    return p.select("page_id", *(F.round(after[k] - before[k], 4).alias(f"delta_{k}") for k in ("recall", "precision", "f1")))


_TABLE_METRICS = ("accuracy", "sensitivity", "specificity", "ppv", "npv", "fabrication_rate", "f1", "balanced_accuracy")


@query("element_table",
    f"""{BY_ELEMENT}, m AS (SELECT *, {metrics_sql()} FROM c), {bootstrap_by_element_sql(_TABLE_METRICS)}, {DISC.removeprefix(', ')}, p AS (SELECT element, metric, round({TAIL}, 6) AS p FROM d)
SELECT m.element, m.annotator, tp, fp, fn, tn, {", ".join(f"m.{k}, {k}_lo, {k}_hi" for k in _TABLE_METRICS)}, {", ".join(f"max(p) FILTER (metric = '{k}') AS p_{k}" for k in ("accuracy", "sensitivity", "specificity", "ppv", "npv", "fabrication"))}
FROM m JOIN ci USING (element, annotator) JOIN p ON p.element = m.element GROUP BY ALL""")
def element_table(spark, sf_dir):
    """One row for each element and annotator: counts, metrics, bootstrap intervals and the p-values of the paired tests."""
    p = mcnemar(wide(spark, sf_dir), ["element"]).groupBy("element").agg(*(F.max(F.when(F.col("metric") == k,
        F.col("p"))).alias(f"p_{k}") for k in ("accuracy", "sensitivity", "specificity", "ppv", "npv", "fabrication")))
    m = metrics_by_element(spark, sf_dir).select("element", "annotator", "tp", "fp", "fn", "tn", *_TABLE_METRICS)
    ci = bootstrap_by_element(spark, sf_dir, _TABLE_METRICS)
    return m.join(F.broadcast(ci), ["element", "annotator"]).join(F.broadcast(p), "element")  # rows by element


@query("paired_metric_tests")
def paired_metric_tests(spark, sf_dir):
    m = metrics_by_element(spark, sf_dir)
    return R.paired_metric_tests(m, ["accuracy", "balanced_accuracy", "sensitivity", "specificity", "ppv", "npv", "f1", "fabrication_rate"]).withColumn("stars", stars(F.col("p")))


_TWO = "least(1.0, 2 * list_sum(list_transform(range(greatest(b, c), b + c + 1), lambda k: exp(lgamma(b + c + 1.0) - lgamma(k + 1.0) - lgamma(b + c - k + 1.0) - (b + c) * ln(2.0)))))"


@query("mcnemar_two_sided", f"{W}{DISC} SELECT element, metric, b, c, CASE WHEN b + c < 25 THEN 'exact' ELSE 'chi2' END AS method, round(CASE WHEN b + c = 0 THEN 1.0 "
    f"WHEN b + c < 25 THEN {_TWO} ELSE pow(abs(b - c) - 1, 2) / (b + c) END, 6) AS p_or_chi2 FROM d")
def mcnemar_two_sided(spark, sf_dir):
    """Exact below 25 discordant pairs (the p-value), with continuity correction beyond (chi-square with one degree of freedom)."""
    d = two_sided(spark, sf_dir)
    return d.select("element", "metric", "b", "c", "method", F.round(F.when(F.col("method") == "exact", F.col("p")).otherwise(F.col("chi2")), 6).alias("p_or_chi2"))


def two_sided(spark, sf_dir):
    d = discordant(wide(spark, sf_dir), ["element"])
    b, c, n = F.col("b"), F.col("c"), F.col("b") + F.col("c")
    chi2 = F.try_divide(F.pow(F.abs(b - c) - 1.0, F.lit(2)), n)
    exact = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(F.greatest(b, c), n)))
    return d.withColumn("method", F.when(n < 25, "exact").otherwise("chi2")).withColumn("chi2", chi2).withColumn("p", F.when(n < 25, exact).otherwise(R.chi_square_1_sf(chi2)))


@query("estimate_format", f"{BY_ELEMENT} SELECT element, annotator, CASE WHEN tp + fn = 0 THEN 'NA' ELSE printf('%.3f (%.3f, %.3f)', tp / nullif(tp + fn, 0), "
    f"0.5 * tp / nullif(tp + fn, 0), (1 + tp / nullif(tp + fn, 0)) / 2) END AS cell FROM c")
def estimate_format(spark, sf_dir):
    x = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return confusion_by_element(spark, sf_dir).select("element", "annotator", R.with_interval(x, 0.5 * x, (1 + x) / 2).alias("cell"))


@query("stars_of_interval", f"{W}, x AS (SELECT element, avg(CASE WHEN ai = '1' THEN 1.0 ELSE 0 END) - avg(CASE WHEN human = '1' THEN 1.0 ELSE 0 END) AS d FROM wide0 "
    f"GROUP BY element) SELECT element, CASE WHEN d - 0.01 > 0 OR d + 0.01 < 0 THEN '*' ELSE '' END AS star FROM x")
def stars_of_interval(spark, sf_dir):
    rate = lambda c: F.avg((F.col(c) == "1").cast("double"))
    x = wide(spark, sf_dir).fillna("", ["human", "ai"]).groupBy("element").agg((rate("ai") - rate("human")).alias("d"))
    return x.select("element", R.stars_of_interval(F.col("d") - 0.01, F.col("d") + 0.01).alias("star"))


@query("significance_map", f"{W}{DISC}, p AS (SELECT element, metric, {TAIL} AS p FROM d), x AS (SELECT element, metric, p, CAST(NULL AS DOUBLE) AS lo, CAST(NULL "
    f"AS DOUBLE) AS hi FROM p UNION ALL SELECT element, 'F1 ', NULL, 0.01 * (ascii(right(element, 1)) - 50), 0.5 "
    f"FROM (SELECT DISTINCT element FROM d)) SELECT element, lower(trim(metric)) AS metric, CASE WHEN lower(trim(metric)) = 'f1' THEN CASE "
    f"WHEN lo > 0 OR hi < 0 THEN '*' ELSE '' END WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 "
    f"THEN '*' ELSE '' END AS flag FROM x")
def significance_map(spark, sf_dir):
    p = mcnemar(wide(spark, sf_dir), ["element"]).select("element", "metric", "p", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    f1 = p.select("element").distinct().select("element", F.lit("F1 ").alias("metric"), F.lit(None).cast("double").alias("p"),
        (0.01 * (F.ascii(F.substring("element", -1, 1)) - 50)).alias("lo"), F.lit(0.5).alias("hi"))
    x = p.unionByName(f1)
    return x.select("element", F.lower(F.trim("metric")).alias("metric"), R.significance(x, "metric", "p", "lo", "hi").alias("flag"))


@query("one_vs_rest_flags", f"{W} SELECT element, CAST(sum(CASE WHEN ai = '1' THEN 1 ELSE 0 END) AS BIGINT) AS is_correct, CAST(sum(CASE WHEN ai = '2' THEN 1 "
    f"ELSE 0 END) AS BIGINT) AS is_omission, CAST(sum(CASE WHEN ai = '3' THEN 1 ELSE 0 END) AS BIGINT) AS is_fabrication, count(*) "
    f"FILTER (ai IN ('1', '2', '3')) AS n FROM wide0 GROUP BY element")
def one_vs_rest_flags(spark, sf_dir):
    f = R.one_vs_rest(F.col("ai"))
    x = wide(spark, sf_dir).select("element", *(c.alias(k) for k, c in f.items()))
    return x.groupBy("element").agg(*(F.sum(k).alias(k) for k in f), F.count("is_correct").alias("n"))


@query("macro_accuracy", "WITH x AS (SELECT lang AS y, CASE WHEN n_chars % 4 = 0 THEN 'en' ELSE lang END AS p FROM documents) SELECT round(avg(CASE WHEN y = p "
    "THEN 1.0 ELSE 0 END), 6) AS accuracy FROM x")
def macro_accuracy(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.col("lang").alias("y"), F.when(F.col("n_chars") % 4 == 0, "en").otherwise(F.col("lang")).alias("p"))
    return x.agg(F.round(F.avg((F.col("y") == F.col("p")).cast("double")), 6).alias("accuracy"))


@query("rmse_uncensored", "SELECT count(*) AS n, round(sqrt(avg(pow(p_retailprice / 100 - p_size, 2))), 6) AS rmse FROM part WHERE p_partkey % 3 <> 0")
def rmse_uncensored(spark, sf_dir):
    """Error of predicted times over rows whose event was seen."""
    e = F.col("p_retailprice") / 100 - F.col("p_size")
    return table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


_RATERS = ("human", "ai", "source_code")


@query("fleiss_kappa",
    f"""{W}, r AS (SELECT case_id || element AS s, human AS k FROM wide0 UNION ALL SELECT case_id || element, ai FROM wide0 UNION ALL SELECT case_id || element, CASE source
  WHEN 1 THEN '1' WHEN 0 THEN 'N/A' END FROM wide0),
n AS (SELECT s, k, count(*) AS c FROM r WHERE k IS NOT NULL GROUP BY ALL), p AS (SELECT s, sum(c) AS m, sum(c * (c - 1)) AS same FROM n
  GROUP BY s HAVING sum(c) > 1), e AS (SELECT sum(c * c) / pow(sum(c), 2) AS e FROM (SELECT k, sum(c) AS c FROM n SEMI JOIN p USING (s) GROUP BY k))
SELECT count(*) AS subjects, CAST(sum(m) AS BIGINT) AS ratings, round((avg(same / (m * (m - 1))) - any_value(e)) / (1 - any_value(e)), 6) AS kappa FROM p, e""")
def fleiss_kappa(spark, sf_dir):
    w = wide(spark, sf_dir).select(F.concat(F.col("case_id").cast("string"), "element").alias("s"), "human", "ai", F.when(F.col("source") == 1,
        "1").when(F.col("source") == 0, "N/A").alias("source_code"))
    return R.fleiss_kappa(w.unpivot(["s"], list(_RATERS), "rater", "k"), "s", "k")


_SEVERITY = {"click": 3, "view": 1, "error": 5}


@query("redaction_quality",
    f"""WITH s AS (SELECT event_type AS type, event_id % 3 <> 0 AS truth, event_id % 5 <> 0 AS redacted, CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _SEVERITY.items())} ELSE 1 END AS w FROM events),
g AS (SELECT type, count(*) FILTER (truth AND redacted) AS tp, count(*) FILTER (NOT truth AND redacted) AS fp, count(*) FILTER (truth AND NOT redacted) AS fn,
  count(*) FILTER (NOT truth AND NOT redacted) AS tn, sum(w) FILTER (truth) AS a, coalesce(sum(w) FILTER (truth AND NOT redacted), 0) AS m FROM s GROUP BY type)
SELECT type, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision,
  round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fn / nullif(tp + fn, 0), 6) AS fnr, round(fp / nullif(fp + tn, 0), 6) AS fpr,
  round(fp / nullif(tp + fp, 0), 6) AS over_redaction, round(m / a, 6) AS residual_risk FROM g""")
def redaction_quality(spark, sf_dir):
    e = F.col("event_id")
    return R.redaction_quality(table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), (e % 3 != 0).alias("truth"), (e % 5 != 0).alias("redacted")), _SEVERITY)


@query("document_risk", f"{D} SELECT lang, count(*) FILTER (risk > 0.15) AS n_high, round(max(risk), 6) AS max_risk, round(avg(risk), 6) AS avg_risk "
    f"FROM (SELECT lang, least(1.0, 0.1 * len(regexp_extract_all(text, '[0-9]{{3}}'))) AS risk FROM d) GROUP BY lang")
def document_risk(spark, sf_dir):
    risk = F.least(F.lit(1.0), 0.1 * F.size(F.regexp_extract_all("text", F.lit("([0-9]{3})"), F.lit(1))))
    return docs(spark, sf_dir).select("lang", risk.alias("risk")).groupBy("lang").agg(F.count_if(F.col("risk") > 0.15).alias("n_high"),
        F.round(F.max("risk"), 6).alias("max_risk"), F.round(F.avg("risk"), 6).alias("avg_risk"))


_CLASSES = ("en", "de", "fr", "es")
_SCORE = {k: f"((doc_id * {7 + i} + n_chars) % 101 + CASE WHEN lang = '{k}' THEN 20 ELSE 0 END) / 121.0" for i, k in enumerate(_CLASSES)}


@query("multiclass_auc",
    "WITH x AS (" + " UNION ALL ".join(f"SELECT '{k}' AS class, CASE WHEN lang = '{k}' THEN 1 ELSE 0 END AS y, round({s}, 9) AS p FROM documents" for k,
    s in _SCORE.items()) + """), u AS (SELECT class, y, p FROM x UNION ALL SELECT 'micro', y, p FROM x),
r AS (SELECT class, y, rank() OVER (PARTITION BY class ORDER BY p) + (count(*) OVER (PARTITION BY class, p) - 1) / 2 AS r FROM u), a AS (SELECT class, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY class)
SELECT class, round(auc, 6) AS auc FROM a UNION ALL SELECT 'macro', round(avg(auc), 6) FROM a WHERE class <> 'micro'""")
def multiclass_auc(spark, sf_dir):
    """One class against the rest, their mean (macro), and all decisions together (micro)."""
    d = table(spark, sf_dir, "documents")
    each = F.array(*(F.struct(F.lit(k).alias("class"), F.coalesce((F.col("lang") == k).cast("int"), F.lit(0)).alias("y"),
        F.round(F.expr(s.replace("121.0", "121.0D")), 9).alias("p")) for k, s in _SCORE.items()))
    x = d.select(F.explode(each).alias("x")).select("x.*")
    return E.multiclass_auc(x, "class", "y", "p")


@query("trend_p_values", "WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS x FROM events) "
    "SELECT event_type, count(*) AS n, round(regr_slope(value, x) / sqrt(regr_syy(value, x) * (1 - regr_r2(value, "
    "x)) / ((count(*) - 2) * regr_sxx(value, x))), 6) AS t FROM e GROUP BY event_type")
def trend_p_values(spark, sf_dir):
    """t of each type's trend; trends() adds the two-sided p."""
    return trends(spark, sf_dir).select("event_type", "n", "t")


def trends(spark, sf_dir):
    e = S.iterations(table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"], "x")
    return S.trend_test(e, "event_type", "x", "value")


@query("golden_sample", f"{D}, r AS (SELECT doc_id, least(1.0, 0.1 * len(regexp_extract_all(text, '[0-9]{{3}}'))) AS risk FROM d) SELECT doc_id, round(risk, 6) "
    f"AS risk, item_id FROM (SELECT * FROM r WHERE risk <= 0.15 ORDER BY doc_id LIMIT 20) LEFT JOIN benchmark ON item_id = doc_id")
def golden_sample(spark, sf_dir):
    """The first twenty documents that are not of high risk, with their keyed truth: the sample is the feature."""
    risk = F.least(F.lit(1.0), 0.1 * F.size(F.regexp_extract_all("text", F.lit("([0-9]{3})"), F.lit(1))))
    head = docs(spark, sf_dir).select("doc_id", risk.alias("risk")).where("risk <= 0.15").orderBy("doc_id").limit(20)
    b = table(spark, sf_dir, "benchmark").select("item_id")
    return head.join(b, head["doc_id"] == b["item_id"], "left").select("doc_id", F.round("risk", 6).alias("risk"), "item_id")


@query("covariate_frame", "SELECT p_partkey, coalesce(TRY_CAST(p_size AS DOUBLE), 0) AS p_size, 0.0 AS age, 0.0 AS stage, CAST(CASE WHEN p_name LIKE '%red%' "
    "THEN 1 ELSE 0 END + CASE WHEN p_name LIKE '%ring%' THEN 1 ELSE 0 END AS INT) AS mut_count, " + ", ".join(f"CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END AS type_{t.lower()}" for t in ("ECONOMY",
        "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part")
def covariate_frame(spark, sf_dir):
    """Model covariates: absent columns are 0, indicators are summed, categories become dummies."""
    p = table(spark, sf_dir, "part")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in p.columns else F.lit(0.0)
    mutated = sum((F.contains("p_name", F.lit(g)).cast("int") for g in ("red", "ring")), F.lit(0))
    dummies = [(F.col("p_type") == t).cast("int").alias(f"type_{t.lower()}") for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")]
    return p.select("p_partkey", *(number(c).alias(c) for c in ("p_size", "age", "stage")), mutated.alias("mut_count"), *dummies)


@query("method_by_element",
    """WITH t AS (SELECT doc_id, lang, source, lower(coalesce(text, '')) AS t FROM documents), x AS (SELECT lang, e, CASE e WHEN 'email' THEN contains(t, '@')
  WHEN 'number' THEN regexp_matches(t, '[0-9]{3}') ELSE regexp_matches(t, 'idiot|clown|scum') END AS rls,
 regexp_matches(t, '[0-9]') AND CASE e WHEN 'email' THEN contains(t, '@') WHEN 'number' THEN regexp_matches(t, '[0-9]{3}')
  ELSE regexp_matches(t, 'idiot|clown|scum') END AS gated FROM t, (VALUES ('email'), ('number'), ('abuse')) v(e))
SELECT lang, e AS element, count(*) AS n, round(avg(CASE WHEN rls THEN 1.0 ELSE 0 END), 6) AS rls, round(avg(CASE WHEN gated THEN 1.0 ELSE 0 END), 6) AS two_phase FROM x GROUP BY ALL""")
def method_by_element(spark, sf_dir):
    """Share of documents in which each element is found, at once or behind a gate, by language (as domain) and element."""
    t = F.lower("text")
    found = {"email": F.contains(t, F.lit("@")), "number": t.rlike("[0-9]{3}"), "abuse": t.rlike("idiot|clown|scum")}
    gate = t.rlike("[0-9]")
    each = F.array(*(F.struct(F.lit(k).alias("element"), c.alias("rls"), (gate & c).alias("two_phase")) for k, c in found.items()))
    x = docs(spark, sf_dir).select("lang", F.explode(each).alias("x")).select("lang", "x.*")
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return x.groupBy("lang", "element").agg(F.count("*").alias("n"), rate("rls"), rate("two_phase"))


@query("prompt_refinement", "WITH s AS (SELECT p_brand, avg(p_size / 50.0) AS m, min(p_size / 50.0) AS lo FROM part GROUP BY p_brand) SELECT p_brand, "
    "'Find the brand ' || p_brand || '. Answer only what the text says; otherwise say not stated.' AS prompt, true AS dry_run FROM s "
    "WHERE m < 0.52 OR lo < 0.02")
def prompt_refinement(spark, sf_dir):
    """New prompts for flagged elements, as a dry run makes them: without a model."""
    flagged = E.problem_summary(table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") / 50.0).alias("acc")), "p_brand", "acc", 0.52, 0.02).where("needs_refinement")
    return flagged.select("p_brand", F.concat(F.lit("Find the brand "), F.col("p_brand"),
        F.lit(". Answer only what the text says; otherwise say not stated.")).alias("prompt"), F.lit(True).alias("dry_run"))
