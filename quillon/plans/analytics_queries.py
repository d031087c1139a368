"""Queries for vectors, series, ontologies, verdicts, privacy measures and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions.text import word_tokens, words
from quillon.operators import evaluation as E
from quillon.operators import ontology as O
from quillon.operators import series as S
from quillon.operators import vectors as V
from quillon.operators.ranges import settled
from quillon.plans.register import query
from quillon.plans.text_queries import TOKENS, docs
from quillon.sources.tables import table

D = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"
TF = f"{D}, tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM d) GROUP BY ALL)"


@query("count_vector", f"{TF} SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, CAST(max(tf) AS BIGINT) AS max_tf FROM tf GROUP BY doc_id")
def count_vector(spark, sf_dir):
    return V.term_counts(docs(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"))


@query("tfidf_top_terms", f"{TF}, df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), w AS (SELECT doc_id, "
    f"term, tf * idf AS w FROM tf JOIN df USING (term)), n AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) "
    f"AS weight FROM w) SELECT doc_id, term, weight, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, "
    f"term) AS k FROM n) WHERE k <= 3")
def tfidf_top_terms(spark, sf_dir):
    w = V.tfidf(docs(spark, sf_dir), "doc_id").withColumn("weight", F.round("weight", 6))
    return w.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))).where("place <= 3").select("doc_id", "term", "weight", "place")


_H = "CAST('0x' || substr(md5(term), 1, 8) AS BIGINT)"


@query("hashing_tf", f"{TF}, h AS (SELECT doc_id, {_H} % 262144 AS slot, CAST(sum(CASE WHEN CAST('0x' || substr(md5(term), 9, 1) AS INT) >= 8 THEN -tf "
    f"ELSE tf END) AS DOUBLE) AS v FROM tf GROUP BY ALL), n AS (SELECT doc_id, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM h "
    f"WHERE v <> 0) SELECT doc_id, count(v) AS n_entries, coalesce(round(max(v), 6), 0) AS largest, coalesce(round(min(v), 6), 0) AS smallest "
    f"FROM d LEFT JOIN n USING (doc_id) GROUP BY doc_id")
def hashing_tf(spark, sf_dir):
    """Signed hashed term frequencies of unit length, as sparse entries: their number and extremes for each document."""
    d = docs(spark, sf_dir)
    v = V.hashed_terms(d, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_entries"), F.round(F.max("value"), 6).alias("largest"), F.round(F.min("value"), 6).alias("smallest"))
    return d.select("doc_id").join(v, "doc_id", "left").fillna(0, ["n_entries", "largest", "smallest"])


_COS = (
    "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] "
    "AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x "
    "AS DOUBLE)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"
)


@query("cosine_topk", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 "
    f"AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, sim, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
    f"ORDER BY sim DESC, vec_id) AS k FROM s) WHERE k <= 5")
def cosine_topk(spark, sf_dir):
    """Nearest five of every vector whose id is divisible by 20, against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return V.top_k(e, e.where("vec_id % 20 = 0"), 5)


@query("similar_pairs_diff_label", f"SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 "
    f"AND a.vec_id <> b.vec_id AND a.label <> b.label WHERE {_COS} >= 0.3")
def similar_pairs_diff_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    s = V.all_pairs_in_blocks(e, e.where("vec_id % 20 = 0")).where("sim >= 0.3 and vec_id <> query_id")
    a = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la"))
    return s.join(a, "query_id").join(e.select("vec_id", "label"), "vec_id").where("la <> label").select("query_id", "vec_id", F.round("sim", 6).alias("sim"))


@query("embedding_variance", "SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 'var_pop'), 6) AS variance FROM embeddings")
def embedding_variance(spark, sf_dir):
    v = V.doubles(F.col("embedding"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumn("m", mean(F.col("v")))
    return e.select("vec_id", F.round(mean(F.transform("v", lambda x: (x - F.col("m")) * (x - F.col("m")))), 6).alias("variance"))


_SETS = "SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS x FROM d"


@query("word_set_f1", f"{D}, s AS ({_SETS}), b AS (SELECT doc_id, x AS y FROM s) SELECT s.doc_id, round(len(list_intersect(s.x, b.y)) / len(s.x), 6) "
    f"AS precision, round(len(list_intersect(s.x, b.y)) / len(b.y), 6) AS recall, round(2.0 * len(list_intersect(s.x, "
    f"b.y)) / (len(s.x) + len(b.y)), 6) AS f1 FROM s JOIN b ON b.doc_id = s.doc_id + 1")
def word_set_f1(spark, sf_dir):
    """Each document against the next one, as extraction and truth."""
    s = docs(spark, sf_dir).select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("x"))
    b = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    return s.join(b, "doc_id").select("doc_id", *(F.round(c, 6).alias(k) for k, c in V.set_scores(F.col("x"), F.col("y")).items()))


def _grams(t: str, n: int) -> str:
    return f"CASE WHEN len({t}) >= {n} THEN list_distinct(list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))) ELSE [] END"


_ROUGE = "round(coalesce(2.0 * len(list_intersect({0}1, {0}2)) / nullif(len({0}1) + len({0}2), 0), 0), 6)"


@query("ngram_overlap_rouge1_2", f"{D}, t AS (SELECT doc_id, {TOKENS} AS t FROM d), g AS (SELECT doc_id, list_distinct(t) AS u, {_grams('t', 2)} AS b FROM t) "
    f"SELECT a.doc_id, {_ROUGE.replace('{0}1', 'a.u').replace('{0}2', 'c.u')} AS rouge_1, "
    f"{_ROUGE.replace('{0}1', 'a.b').replace('{0}2', 'c.b')} AS rouge_2 FROM g a JOIN g c ON c.doc_id = a.doc_id + 1")
def ngram_overlap_rouge1_2(spark, sf_dir):
    g = docs(spark, sf_dir).select("doc_id", word_tokens(F.col("text")).alias("t")).select("doc_id", V.ngrams(F.col("t"), 1).alias("u"), V.ngrams(F.col("t"), 2).alias("b"))
    c = g.select((F.col("doc_id") - 1).alias("doc_id"), F.col("u").alias("u2"), F.col("b").alias("b2"))
    score = lambda x, y: F.round(V.set_scores(F.col(x), F.col(y))["f1"], 6)
    return g.join(c, "doc_id").select("doc_id", score("u", "u2").alias("rouge_1"), score("b", "b2").alias("rouge_2"))


@query("rouge_l")
def rouge_l(spark, sf_dir):
    """Longest common subsequence of words of consecutive turns of a conversation: recall, precision, F1."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", words(F.coalesce("text", F.lit(""))).alias("w"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return E.with_lcs(c.join(nxt, ["conv_id", "turn"]), "w", "w2").select("conv_id", "turn", "lcs", "rouge_l")


@query("trend_by_type", "WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS x FROM events), g "
    "AS (SELECT event_type, count(value) AS n, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept, regr_r2(value, x) "
    "AS r2, regr_sxx(value, x) AS sxx, regr_syy(value, x) AS syy FROM e GROUP BY event_type) SELECT event_type, n, round(slope, 6) AS slope, "
    "round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(sqrt(syy * (1 - r2) / ((n - 2) * sxx)), 6) AS stderr, CASE WHEN slope > 0 "
    "THEN 'up' WHEN slope < 0 THEN 'down' ELSE 'flat' END AS direction FROM g")
def trend_by_type(spark, sf_dir):
    e = S.iterations(table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"], "x")
    return S.linear_trend(e, "event_type", "x", "value")


DAILY = "WITH s AS (SELECT event_type, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, sum(value) AS y FROM events GROUP BY ALL)"


def daily(spark, sf_dir):
    day = F.unix_date(F.to_date("ts")).cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type", day.alias("day")).agg(F.sum("value").alias("y"))


@query("cusum_change_point", f"{DAILY}, c AS (SELECT *, y - avg(y) OVER (PARTITION BY event_type) AS c FROM s), k AS (SELECT *, sum(c) OVER (PARTITION BY event_type "
    f"ORDER BY day ROWS UNBOUNDED PRECEDING) AS s FROM c), a AS (SELECT event_type, arg_max(day, (round(abs(s), 9), -day)) AS at, max(abs(s)) "
    f"AS peak, stddev_pop(y) AS sd, count(*) AS n FROM k GROUP BY event_type) SELECT a.event_type, any_value(a.at) AS at, round(avg(s.y) "
    f"FILTER (s.day <= a.at), 6) AS before, round(avg(s.y) FILTER (s.day > a.at), 6) AS after, any_value(peak > sd * sqrt(n)) AS significant "
    f"FROM a JOIN s USING (event_type) GROUP BY a.event_type")
def cusum_change_point(spark, sf_dir):
    return S.cusum(daily(spark, sf_dir), "event_type", "day", "y")


@query("iteration_series", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iteration, round(sum(value) "
    "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def iteration_series(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return S.iterations(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "iteration",
        F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@query("holt_forecast")
def holt_forecast(spark, sf_dir):
    return S.holt(daily(spark, sf_dir), "event_type", "day", "y")


@query("arima_forecast")
def arima_forecast(spark, sf_dir):
    return S.arima(daily(spark, sf_dir), "event_type", "day", "y")


@query("feasibility", f"{DAILY} SELECT event_type, count(y) AS n, CASE WHEN count(y) < 3 THEN 'too short' WHEN count(y) < 8 THEN 'trend only' "
    f"ELSE 'feasible' END AS verdict, stddev_samp(y) / nullif(avg(y), 0) > 0.2 AS unsteady FROM s GROUP BY event_type")
def feasibility(spark, sf_dir):
    return S.feasibility(daily(spark, sf_dir), "event_type", "y")


@query("problem_elements", "SELECT p_brand, round(avg(p_size / 50.0), 6) AS mean_acc, round(max(p_size / 50.0), 6) AS max_acc, round(min(p_size / 50.0), 6) "
    "AS min_acc, count(*) AS n, avg(p_size / 50.0) < 0.52 OR min(p_size / 50.0) < 0.02 AS needs_refinement FROM part GROUP BY p_brand")
def problem_elements(spark, sf_dir):
    return E.problem_summary(table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") / 50.0).alias("acc")), "p_brand", "acc", 0.52, 0.02)


@query("approach_pivot",
    "SELECT l_returnflag, " + ", ".join(f"coalesce(round(avg(l_quantity) FILTER (l_linenumber = {k}), 6), 0) AS line_{k}" for k in range(1,
    8)) + " FROM lineitem GROUP BY l_returnflag")
def approach_pivot(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linenumber", list(range(1, 8))).agg(F.round(F.avg("l_quantity"), 6)).fillna(0)
    return p.toDF("l_returnflag", *(f"line_{k}" for k in range(1, 8)))


@query("needle_pivot",
    "SELECT CAST(floor(p_size / 10) AS BIGINT) AS depth, " + ", ".join(f"round(avg(p_retailprice) FILTER (p_brand = 'Brand#{k}'), 6) AS b{k}" for k in range(1,
    26)) + " FROM part GROUP BY 1")
def needle_pivot(spark, sf_dir):
    m = lambda b: F.round(F.avg(F.when(F.col("p_brand") == b, F.col("p_retailprice"))), 6)
    return table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_size") / 10).alias("depth")).agg(*(m(f"Brand#{k}").alias(f"b{k}") for k in range(1, 26)))


@query("best_of_selection", "SELECT event_type, arg_max(event_id, (value, -event_id)) AS best_event, round(max(value), 6) AS best_value FROM events GROUP BY event_type")
def best_of_selection(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best_event"), F.round(F.max("value"), 6).alias("best_value"))


@query("bucket_gap", "WITH b AS (SELECT lang, CAST(floor(n_chars / 1000) AS BIGINT) AS bucket, avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0 END) AS r "
    "FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT lang, round(max(r) - min(r), 6) AS gap FROM b GROUP BY lang "
    "HAVING max(r) - min(r) > 0.05")
def bucket_gap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("n_chars") / 1000).alias("bucket")).join(table(spark, sf_dir, "labels"), "doc_id")
    b = d.groupBy("lang", "bucket").agg(F.avg((F.col("toxic") == 1).cast("double")).alias("r"))
    return b.groupBy("lang").agg((F.max("r") - F.min("r")).alias("g")).where("g > 0.05").select("lang", F.round("g", 6).alias("gap"))


NODES = (
    "WITH nodes AS (SELECT CAST(NULL AS VARCHAR) AS parent, 'WORLD' AS child, 0 AS layer UNION ALL SELECT 'WORLD', r_name, 1 FROM region "
    "UNION ALL SELECT r_name, n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey)"
)


def _nodes(spark, sf_dir):
    return O.from_places(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"))


@query("ontology_leaves", f"{NODES} SELECT child, parent, layer FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.parent = n.child)")
def ontology_leaves(spark, sf_dir):
    return O.leaves(_nodes(spark, sf_dir)).select("child", "parent", "layer")


@query("ontology_prune_bfop", f"{NODES}, f AS (SELECT *, length(child) % 3 <> 0 AS own FROM nodes), a AS (SELECT child, own AS o FROM f WHERE layer = 0), b "
    f"AS (SELECT f.child, f.own AND a.o AS o FROM f JOIN a ON f.parent = a.child WHERE layer = 1), c AS (SELECT f.child, f.own AND b.o AS o "
    f"FROM f JOIN b ON f.parent = b.child WHERE layer = 2) SELECT * FROM (SELECT child, o AS open FROM a UNION ALL SELECT child, o FROM b "
    f"UNION ALL SELECT child, o FROM c)")
def ontology_prune_bfop(spark, sf_dir):
    n = _nodes(spark, sf_dir).withColumn("own", F.length("child") % 3 != 0)
    return O.propagate(n, "own", 2).select("child", "open")


@query("two_phase_extract", "WITH g AS (SELECT doc_id, regexp_matches(lower(coalesce(text, '')), 'idiot|clown|scum') AS gate, regexp_extract(lower(coalesce(text, "
    "'')), '(idiot|clown|scum)', 1) AS v FROM documents) SELECT doc_id, CASE WHEN gate THEN v ELSE 'not stated' END AS value FROM g")
def two_phase_extract(spark, sf_dir):
    t = F.lower("text")
    return docs(spark, sf_dir).select("doc_id", F.when(t.rlike("idiot|clown|scum"), F.regexp_extract(t, "(idiot|clown|scum)", 1)).otherwise("not stated").alias("value"))


@query("method_comparison", "SELECT lang, round(avg(CASE WHEN contains(lower(coalesce(text, '')), 'the') THEN 1.0 ELSE 0 END), 6) AS keyword_rate, round(avg(CASE "
    "WHEN regexp_matches(coalesce(text, ''), '[0-9]{3}') THEN 1.0 ELSE 0 END), 6) AS pattern_rate FROM documents GROUP BY lang")
def method_comparison(spark, sf_dir):
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return docs(spark, sf_dir).groupBy("lang").agg(rate(F.contains(F.lower("text"), F.lit("the"))).alias("keyword_rate"), rate(F.col("text").rlike("[0-9]{3}")).alias("pattern_rate"))


@query("verdict_dag_score", "SELECT doc_id, CASE WHEN n_chars = 0 THEN 0 WHEN n_chars < 200 THEN 5 WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 5 ELSE 10 END "
    "AS score FROM documents JOIN labels USING (doc_id)")
def verdict_dag_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    return d.select("doc_id", F.when(n == 0, 0).when(n < 200, 5).when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 5).otherwise(10).alias("score"))


@query("judge_confusion", "WITH j AS (SELECT toxic = 1 AS y, n_chars % 10 >= 8 AS p FROM documents JOIN labels USING (doc_id)) SELECT count(*) FILTER (y AND p) "
    "AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM j")
def judge_confusion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    y, p = F.col("toxic") == 1, F.col("n_chars") % 10 >= 8
    return d.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


@query("pass_rates", "SELECT lang, count(*) FILTER (quality = 1) AS passed, count(*) AS total, round(avg(quality), 6) AS avg_score FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def pass_rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("passed"), F.count("*").alias("total"), F.round(F.avg("quality"), 6).alias("avg_score"))


_SEV = {"EMAIL": 3, "PHONE": 2, "IP": 1}
_PAT = {"EMAIL": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+", "PHONE": "[+][0-9][0-9 ().-]+[0-9]", "IP": "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"}


@query("phi_risk_score", f"{D}, r AS (SELECT lang, {' + '.join(f'''{s} * len(regexp_extract_all(text, '{_PAT[k]}'))''' for k, s in _SEV.items())} AS risk FROM d) "
    f"SELECT lang, round(avg(risk), 6) AS avg_risk, max(risk) AS max_risk, count(*) FILTER (risk > 0) AS n_at_risk FROM r GROUP BY lang")
def phi_risk_score(spark, sf_dir):
    risk = sum((s * F.size(F.regexp_extract_all("text", F.lit(f"({_PAT[k]})"), F.lit(1))) for k, s in _SEV.items()), F.lit(0))
    return docs(spark, sf_dir).select("lang", risk.alias("r")).groupBy("lang").agg(F.round(F.avg("r"), 6).alias("avg_risk"),
        F.max("r").alias("max_risk"), F.count_if(F.col("r") > 0).alias("n_at_risk"))


@query("k_anonymity", "WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT min(n) AS k, count(*) FILTER (n = 1) AS n_unique, count(*) AS n_groups FROM g")
def k_anonymity(spark, sf_dir):
    return E.k_anonymity(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("l_diversity", "WITH g AS (SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1) SELECT min(n) AS l FROM g")
def l_diversity(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_orderstatus").alias("n")).agg(F.min("n").alias("l"))


@query("kfold_assign", "SELECT doc_id, (row_number() OVER (PARTITION BY toxic ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS fold FROM labels")
def kfold_assign(spark, sf_dir):
    return E.stratified_folds(table(spark, sf_dir, "labels"), "doc_id", "toxic", 5).select("doc_id", "fold")


P = "WITH p AS (SELECT toxic AS y, (n_chars % 101) / 100.0 AS p FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("toxic").alias("y"), ((F.col("n_chars") % 101) / 100.0).alias("p"))


@query("auc_brier", f"{P}, r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM p), g AS (SELECT sum(r) "
    f"FILTER (y = 1) AS w, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, avg((p - y) * (p - y)) AS b, avg(CASE "
    f"WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS a FROM r) SELECT round((w - n1 * (n1 + 1) / 2) / (CAST(n1 AS DOUBLE) * n0), 6) "
    f"AS auc, round(b, 6) AS brier, round(a, 6) AS accuracy FROM g")
def auc_brier(spark, sf_dir):
    return E.auc_brier(_scored(spark, sf_dir), "y", "p")


@query("calibration_bins", f"{P} SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM p GROUP BY ALL")
def calibration_bins(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("observed"))


@query("macro_f1", "WITH x AS (SELECT lang AS y, CASE WHEN n_chars % 4 = 0 THEN 'en' WHEN n_chars % 4 = 1 THEN 'de' WHEN n_chars % 4 = 2 THEN 'fr' "
    "ELSE lang END AS p FROM documents), k AS (SELECT DISTINCT y AS k FROM x UNION SELECT DISTINCT p FROM x), m AS (SELECT k, count(*) "
    "FILTER (y = k AND p = k) AS tp, count(*) FILTER (y <> k AND p = k) AS fp, count(*) FILTER (y = k AND p <> k) AS fn FROM x, k "
    "GROUP BY k) SELECT round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) AS macro_precision, round(avg(coalesce(tp / nullif(tp + fn, 0), "
    "0)), 6) AS macro_recall, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM m")
def macro_f1(spark, sf_dir):
    n = F.col("n_chars") % 4
    x = table(spark, sf_dir, "documents").select(F.col("lang").alias("y"), F.when(n == 0, "en").when(n == 1, "de").when(n == 2, "fr").otherwise(F.col("lang")).alias("p"))
    return E.macro_scores(x, "y", "p")


@query("c_index", "WITH x AS (SELECT s_suppkey AS id, s_acctbal AS t, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS e, CAST((s_suppkey * 37) % 101 "
    "AS DOUBLE) AS r, s_nationkey AS g FROM supplier) SELECT count(*) AS n_pairs, round(avg(CASE WHEN a.r > b.r THEN 1.0 WHEN a.r = b.r "
    "THEN 0.5 ELSE 0 END), 6) AS c_index FROM x a JOIN x b ON a.g = b.g AND a.e = 1 AND a.t < b.t")
def c_index(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("t"), F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(1).alias("e"),
        ((F.col("s_suppkey") * 37) % 101).cast("double").alias("r"), F.col("s_nationkey").alias("g"))
    return E.concordance(x, "t", "e", "r", "g")


@query("linear_contrib_ranking", "WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem), c AS (SELECT 'l_quantity' AS feature, "
    "round(avg(abs(0.5 * (l_quantity - q))), 6) AS contribution FROM lineitem, m UNION ALL SELECT 'l_discount', "
    "round(avg(abs(-20.0 * (l_discount - d))), 6) FROM lineitem, m UNION ALL SELECT 'l_tax', round(avg(abs(10.0 * (l_tax - t))), 6) "
    "FROM lineitem, m) SELECT feature, contribution, row_number() OVER (ORDER BY contribution DESC, feature) AS place FROM c")
def linear_contrib_ranking(spark, sf_dir):
    return E.linear_contributions(table(spark, sf_dir, "lineitem"), {"l_quantity": 0.5, "l_discount": -20.0, "l_tax": 10.0})


_NGRAM = (
    "t AS (SELECT doc_id, list_filter({0}, lambda x: x NOT IN ({1})) AS t FROM d), g AS (SELECT doc_id, unnest(list_concat(t, CASE "
    "WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM t)"
)


@query("tfidf_vocabulary", f"{D}, {_NGRAM.format(TOKENS, ', '.join(repr(w) for w in V.STOP_WORDS))}, f AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df "
    f"FROM g GROUP BY term HAVING count(DISTINCT doc_id) >= 2) SELECT term, n, df, round(ln((1.0 + (SELECT count(*) FROM d)) / (1 + df)) + 1, "
    f"6) AS idf FROM f ORDER BY n DESC, term LIMIT 5000")
def tfidf_vocabulary(spark, sf_dir):
    """The 5,000 most frequent terms of one or two words, without stop words, that two documents have: a vocabulary's size is its feature."""
    return V.vocabulary(docs(spark, sf_dir), "doc_id", most=5000, least_docs=2)


@query("similar_pairs_blocked", f"""WITH e AS (SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, label + 1, list_transform(embedding, lambda x: CAST(x * 1.5 AS FLOAT)) FROM embeddings WHERE vec_id % 3 = 0
UNION ALL SELECT vec_id + 2000000, label, embedding FROM embeddings WHERE vec_id % 4 = 0), n AS (SELECT min(vec_id) AS vec_id, label, embedding, count(*) AS n FROM e GROUP BY label, embedding)
SELECT a.vec_id AS a, b.vec_id AS b, a.n AS n_a, b.n AS n_b, round({_COS}, 6) AS sim FROM n a JOIN n b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE {_COS} >= 0.8""")
def similar_pairs_blocked(spark, sf_dir):
    """All pairs of different labels with a cosine of 0.8 or more, of vectors, scaled copies of some under other labels, and copies."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    copy = e.where("vec_id % 3 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), (F.col("label") + 1).alias("label"), F.transform("embedding",
        lambda x: (x * 1.5).cast("float")).alias("embedding"))
    same = e.where("vec_id % 4 = 0").withColumn("vec_id", F.col("vec_id") + 2000000)
    return V.similar_pairs(e.unionByName(copy).unionByName(same), 0.8, "label")


@query("knn_graph", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 "
    f"AND a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS k FROM s) "
    f"SELECT query_id AS source, vec_id AS target, round(1 - sim, 6) AS distance FROM k WHERE k <= 10")
def knn_graph(spark, sf_dir):
    """Edges from every vector whose id is divisible by 20 to its ten nearest of all vectors."""
    e = table(spark, sf_dir, "embeddings")
    t = V.top_k(e, e.where("vec_id % 20 = 0"), 10)
    return t.select(F.col("query_id").alias("source"), F.col("vec_id").alias("target"), F.round(1 - F.col("sim"), 6).alias("distance"))


def _clipped(n: int) -> str:
    return f"list_sum(list_transform(list_distinct(g{n}), lambda x: least(len(list_filter(g{n}, lambda y: y = x)), len(list_filter(h{n}, lambda y: y = x)))))"


_ALLGRAMS = "CASE WHEN len({0}) >= {1} THEN list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], ' ')) ELSE [] END"


@query("bleu",
    f"""WITH c AS (SELECT conv_id, turn, list_slice({TOKENS.replace('text', "coalesce(text, '')")}, 1, 80) AS t
  FROM conversations), p AS (SELECT a.conv_id, a.turn, a.t AS t, b.t AS r FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
g AS (SELECT conv_id, turn, len(t) AS n, len(r) AS m, {", ".join(f"{_ALLGRAMS.format('t', k)} AS g{k}, {_ALLGRAMS.format('r', k)} AS h{k}" for k in (1, 2))} FROM p),
s AS (SELECT *, (1 + {_clipped(1)}) / (1.0 + len(g1)) AS p1, (1 + coalesce({_clipped(2)}, 0)) / (1.0 + len(g2)) AS p2 FROM g WHERE n > 0 AND m > 0)
SELECT conv_id, turn, round(CASE WHEN n < m THEN exp(1 - m / n) ELSE 1.0 END * exp((ln(p1) + ln(p2)) / 2), 6) AS bleu_2 FROM s""")
def bleu(spark, sf_dir):
    """BLEU of one and two words, smoothed by one, of consecutive turns; the first 80 words of a turn, as a judge reads them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(word_tokens(F.coalesce("text", F.lit(""))), 1, 80).alias("t"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("r"))
    p = c.join(nxt, ["conv_id", "turn"]).where((F.size("t") > 0) & (F.size("r") > 0))
    return p.select("conv_id", "turn", F.round(V.bleu(F.col("t"), F.col("r"), 2), 6).alias("bleu_2"))


@query("gated_extraction", """WITH n AS (SELECT 'WORLD' AS parent, r_name AS child, 1 AS layer FROM region UNION ALL SELECT r_name, n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), leaf AS (SELECT child, parent FROM n WHERE layer = 2),
x AS (SELECT c_custkey % 50 AS grp, leaf.child AS element, count(*) FILTER (c.n_name = leaf.child) AS hits, count(*) FILTER (c.r_name = leaf.parent) AS gate FROM c, leaf GROUP BY ALL)
SELECT grp, element, CASE WHEN hits > 0 THEN CAST(hits AS VARCHAR) ELSE 'not stated' END AS one_pass, CASE WHEN gate > 0 AND hits > 0 THEN CAST(hits AS VARCHAR)
  ELSE 'not stated' END AS gated, gate > 0 AS open FROM x""")
def gated_extraction(spark, sf_dir):
    """Every leaf of an ontology for every group: extracted in one pass, and only behind its parent's gate; else "not stated"."""
    names = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    said = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("grp"), F.col("c_nationkey").alias("n_nationkey")).join(F.broadcast(names), "n_nationkey")
    leaf = O.leaves(_nodes(spark, sf_dir)).where("layer = 2").select("child", "parent")
    return O.gated(said, leaf, "grp", "n_name", "r_name")


_AGENT = "Use the retrieved context to answer the question. Context: {context} Question: {question} If it is not in the context, say so."


@query("agent_graph_dry_run", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS k FROM s), c AS (SELECT query_id, string_agg('document ' || vec_id, '; ' ORDER BY k) AS context FROM k WHERE k <= 3 GROUP BY query_id)
SELECT query_id, 'agent>retrieve>generate' AS path, md5(replace(replace('{_AGENT}', '{{context}}', context), '{{question}}', 'What is ' || query_id || '?')) AS prompt_md5, 'not stated' AS answer FROM c""")
def agent_graph_dry_run(spark, sf_dir):
    """Agent, retrieval and generation as steps over a table of questions; the provider answers without a model."""
    from quillon.sources.files import dry_run, provider_map

    e = table(spark, sf_dir, "embeddings")
    top = V.top_k(e, e.where("vec_id % 20 = 0"), 3)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda s: F.concat(F.lit("document "), s["vec_id"].cast("string")))
    retrieved = settled(top.groupBy("query_id").agg(F.array_join(parts, "; ").alias("context")))  # read for the prompts and beside the answers
    question = F.concat(F.lit("What is "), F.col("query_id").cast("string"), F.lit("?"))
    prompt = F.replace(F.replace(F.lit(_AGENT), F.lit("{context}"), F.col("context")), F.lit("{question}"), question)
    asked = retrieved.select(F.col("query_id").cast("string").alias("case_id"), F.lit("answer").alias("element"), prompt.alias("prompt"))
    said = provider_map(asked, dry_run).select("case_id", F.get_json_object("raw_response", "$.value").alias("answer"))
    return asked.join(said, "case_id").select(F.col("case_id").cast("long").alias("query_id"), F.lit("agent>retrieve>generate").alias("path"), F.md5("prompt").alias("prompt_md5"), "answer")
