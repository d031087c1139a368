"""Queries for joins, sets, deduplication, surrogate keys and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import relational as R
from quillon.operators.ranges import numbered, quantiles
from quillon.plans.register import query
from quillon.sources.tables import table


@query("join_left_enrich", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON CAST(d.doc_id AS VARCHAR) = CAST(l.doc_id AS VARCHAR)")
def join_left_enrich(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab.select(F.col("doc_id").alias("k"), "quality", "toxic"), d["doc_id"].cast("string") == F.col("k").cast("string"), "left").select("doc_id", "lang", "quality", "toxic")


@query("join_left_unmatched", "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders, count(o.o_orderkey) = 0 AS unmatched FROM customer c LEFT "
    "JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
def join_left_unmatched(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer")
    return c.join(n, c["c_custkey"] == n["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.col("n").isNull().alias("unmatched"))


@query("join_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer "
    "WHERE c_nationkey < 20 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 "
    "GROUP BY 1) b ON a.k = b.k")
def join_full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    b = table(spark, sf_dir, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "k", "full")


@query("semi_filter", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_filter(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select("doc_id", "source", "n_chars")


@query("anti_unmatched", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unmatched(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("n_way_feature_join", "SELECT c.c_custkey, n.n_name, r.r_name, o.n_orders, round(o.total, 2) AS total FROM customer c LEFT "
    "JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN (SELECT o_custkey, "
    "count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def n_way_feature_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return R.fold_left(c, [(n, ["c_nationkey"]), (r, ["r_regionkey"]), (o, ["c_custkey"])]).select("c_custkey", "n_name", "r_name", "n_orders", F.round("total", 2).alias("total"))


@query("composite_key_join", "WITH f AS (SELECT DISTINCT upper(trim(n_name)) AS a, n_regionkey AS b, length(n_name) AS c, n_nationkey FROM nation) "
    "SELECT s.s_suppkey, f.a AS nation_key FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN f ON f.a = upper(n.n_name) "
    "AND f.b = n.n_regionkey AND f.c = length(n.n_name)")
def composite_key_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    f = n.select(F.upper(F.trim("n_name")).alias("a"), F.col("n_regionkey").alias("b"), F.length("n_name").alias("c")).distinct()
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.upper("n_name").alias("a"),
        F.col("n_regionkey").alias("b"), F.length("n_name").alias("c"))
    return s.join(f, ["a", "b", "c"]).select("s_suppkey", F.col("a").alias("nation_key"))


@query("join_deduped_dimension", "WITH d AS (SELECT DISTINCT o_custkey, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) "
    "SELECT c.c_custkey, d.p AS first_priority FROM customer c JOIN d ON d.o_custkey = c.c_custkey")
def join_deduped_dimension(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(d, "c_custkey")


@query("scalar_threshold", "SELECT p_partkey, p_retailprice < (SELECT quantile_cont(p_retailprice, 0.1) FROM part) AS cheap FROM part")
def scalar_threshold(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = quantiles(p, ["p_retailprice"], [0.1]).select(F.col("q")[0].alias("t"))  # one row
    return p.join(F.broadcast(t)).select("p_partkey", (F.col("p_retailprice") < F.col("t")).alias("cheap"))


@query("union_stats", "SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n, round(avg(c_acctbal), 6) AS mean_bal FROM customer GROUP BY 2 "
    "UNION ALL SELECT 'supplier', s_nationkey, count(*), round(avg(s_acctbal), 6) FROM supplier GROUP BY 2")
def union_stats(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(b).groupBy("kind", "nation").agg(F.count("*").alias("n"), F.round(F.avg("bal"), 6).alias("mean_bal"))


@query("dedupe_keep_first", "SELECT text_md5, doc_id FROM (SELECT md5(coalesce(text, '')) AS text_md5, doc_id, row_number() OVER (PARTITION BY coalesce(text, '') "
    "ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    return R.keep_first(d, ["text_md5"], ["doc_id"]).select("text_md5", "doc_id")


@query("surrogate_ids", "WITH f AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1) SELECT o_custkey, 'P' || lpad(CAST(row_number() "
    "OVER (ORDER BY first, o_custkey) AS VARCHAR), 6, '0') AS surrogate FROM f")
def surrogate_ids(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    return numbered(first, ["first", "o_custkey"], "k").select("o_custkey", F.concat(F.lit("P"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("surrogate"))


@query("melt_long", "SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def melt_long(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "variable", "value")


@query("set_ops", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL "
    "SELECT 'customers_only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_ops(spark, sf_dir):
    c, s, o = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    both = c.select("c_nationkey").intersect(s.select("s_nationkey")).agg(F.count("*").alias("n"))
    only = c.select("c_custkey").subtract(o.select("o_custkey")).agg(F.count("*").alias("n"))
    return both.select(F.lit("both").alias("kind"), "n").unionByName(only.select(F.lit("customers_only").alias("kind"), "n"))


@query("dedupe_records", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)")
def dedupe_records(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount"]
    return table(spark, sf_dir, "lineitem").select(*keys).distinct().agg(F.count("*").alias("n"))


@query("set_concat", "SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), '|') AS segments FROM customer GROUP BY c_nationkey")
def set_concat(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("segments"))


@query("unmatched_resume", "SELECT e.event_id FROM events e ANTI JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 20) p ON e.user_id = p.user_id")
def unmatched_resume(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id").join(e.where("event_type = 'purchase' and value > 20").select("user_id").distinct(), "user_id", "left_anti").select("event_id")


_TS = "epoch_us(ts)"


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    from quillon.streaming.events import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("events_sliding", "WITH s AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, "
    "ts) - INTERVAL 30 MINUTE]) AS window_start FROM events) SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total "
    "FROM s GROUP BY ALL")
def events_sliding(spark, sf_dir):
    from quillon.streaming.events import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour", "30 minutes")


@query("events_session", "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END "
    "AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id "
    "ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 4) "
    "AS total FROM s GROUP BY user_id, k")
def events_session(spark, sf_dir):
    from quillon.streaming.events import sessions

    return sessions(table(spark, sf_dir, "events"), "30 minutes")
