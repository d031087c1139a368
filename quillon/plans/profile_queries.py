"""Queries that profile tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import profile as P
from quillon.operators.ranges import numbered
from quillon.operators.annotations import CTE, domain_bridge
from quillon.plans.annotation_queries import wide
from quillon.plans.register import query
from quillon.sources.tables import table

W = f"WITH {CTE}"
ROLES = ("source", "human", "ai")


@query("missing_by_column", f"{W} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({v}) AS n_missing, count({v}) AS n_present, "
    f"round((count(*) - count({v})) * 100.0 / count(*), 6) AS pct_missing FROM wide0" for c, v in (("source", "source"), ("human", "human"), ("ai", "ai"), ("second_reader", "CAST(NULL AS VARCHAR)"))))
def missing_by_column(spark, sf_dir):
    return P.missing_by_column(wide(spark, sf_dir), ["source", "human", "ai", "second_reader"])


_MISS = f"{W}, m AS (SELECT element, (CASE WHEN source IS NULL THEN 1 ELSE 0 END) + (CASE WHEN human IS NULL THEN 1 ELSE 0 END) + (CASE WHEN ai IS NULL THEN 1 ELSE 0 END) AS k FROM wide0)"


def _missing(spark, sf_dir):
    k = sum((F.col(c).isNull().cast("int") for c in ROLES), F.lit(0))
    return wide(spark, sf_dir).select("case_id", "element", k.alias("k"))


@query("missing_by_element", f"{_MISS} SELECT element, CAST(sum(k) AS BIGINT) AS total_missing, count(*) * 3 AS n_cells, round(100.0 * sum(k) / (count(*) * 3), 6) AS pct FROM m GROUP BY element")
def missing_by_element(spark, sf_dir):
    return _missing(spark, sf_dir).groupBy("element").agg(F.sum("k").alias("total_missing"), (F.count("*") * 3).alias("n_cells"), F.round(100.0 * F.sum("k") / (F.count("*") * 3), 6).alias("pct"))


@query("missing_by_domain", f"{_MISS}, e AS (SELECT element, sum(k) AS t, 100.0 * sum(k) / (count(*) * 3) AS p FROM m GROUP BY element) SELECT domain, count(*) "
    f"AS n_elements, round(avg(p), 6) AS avg_pct, round(max(p), 6) AS max_pct, round(min(p), 6) AS min_pct, CAST(sum(t) AS BIGINT) AS total "
    f"FROM e JOIN bridge USING (element) GROUP BY domain")
def missing_by_domain(spark, sf_dir):
    e = _missing(spark, sf_dir).groupBy("element").agg(F.sum("k").alias("t"), (100.0 * F.sum("k") / (F.count("*") * 3)).alias("p"))
    return e.join(F.broadcast(domain_bridge(spark)), "element").groupBy("domain").agg(F.count("*").alias("n_elements"), F.round(F.avg("p"),
        6).alias("avg_pct"), F.round(F.max("p"), 6).alias("max_pct"), F.round(F.min("p"), 6).alias("min_pct"), F.sum("t").alias("total"))


@query("missing_per_row", f"{_MISS} SELECT k AS n_missing, count(*) AS n_rows FROM m GROUP BY k")
def missing_per_row(spark, sf_dir):
    return _missing(spark, sf_dir).groupBy(F.col("k").alias("n_missing")).agg(F.count("*").alias("n_rows"))


ORDER_COLS = (("o_orderkey", "integer", "identifier"), ("o_custkey", "integer", "identifier"), ("o_orderstatus", "text", "category"), ("o_totalprice",
    "number", "measure"), ("o_orderdate", "other", "time"), ("o_orderpriority", "text", "category"))


@query("variable_catalogue", " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i + 1} AS position, '{t}' AS data_type, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) "
    f"AS n_missing, round((count(*) - count({c})) * 100.0 / count(*), 6) AS pct_missing FROM orders" for i, (c, t, _) in enumerate(ORDER_COLS)))
def variable_catalogue(spark, sf_dir):
    return P.catalogue(table(spark, sf_dir, "orders"))


@query("data_dictionary", " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{r}' AS role, '{t}' AS data_type, CASE WHEN count(DISTINCT {c}) <= 10 THEN string_agg(DISTINCT CAST({c} "
    f"AS VARCHAR), '|' ORDER BY CAST({c} AS VARCHAR)) ELSE '' END AS valid_values, "
    f"'{P.label_of(c)}' AS label, 'The {r} {P.label_of(c)} of an order.' AS description, CASE WHEN count(*) > count({c}) THEN 'NULL' ELSE '' END AS missing_code, "
    f"CASE WHEN count(DISTINCT {c}) = count(*) THEN 'unique' WHEN count(DISTINCT {c}) = 1 THEN 'constant' ELSE '' END AS notes FROM orders" for c, t, r in ORDER_COLS))
def data_dictionary(spark, sf_dir):
    """Values are listed where a column has few; how many is known before any are gathered."""
    orders = table(spark, sf_dir, "orders")
    few = [r.column_name for r in P.per_column(orders, orders.columns, lambda c: {"n": F.approx_count_distinct(c, 0.05)}).where("n <= 12").collect()]
    text = lambda c: F.col(c).cast("string")
    listed = {c: F.array_sort(F.collect_set(text(c))) for c in few}
    valid = lambda c: F.when(F.size(listed[c]) <= 10, F.array_join(listed[c], "|")).otherwise("") if c in few else F.max(F.lit(""))
    n = F.count("*")

    def described(c: str) -> dict:
        role, label = P.role_of(c), P.label_of(c)
        notes = F.when(F.count_distinct(c) == n, "unique").when(F.count_distinct(c) == 1, "constant").otherwise("")
        text = {"label": label, "description": f"The {role} {label} of an order."}
        return {**{k: F.max(F.lit(v)) for k, v in text.items()}, "missing_code": F.when(n > F.count(c), "NULL").otherwise(""), "notes": notes}

    return P.per_column(orders, orders.columns, lambda c: {"role": F.max(F.lit(P.role_of(c))), "data_type": F.max(F.lit(P.kind_of(orders.schema[c].dataType))), "valid_values": valid(c), **described(c)})


@query("dataset_metadata", "SELECT 'n_rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'n_columns', '6' UNION ALL "
    "SELECT 'missing_pct', "
    "CAST(CAST(round(100.0 * ((count(*) - count(o_orderkey)) + (count(*) - count(o_custkey)) + (count(*) - count(o_orderstatus)) + (count(*) - count(o_totalprice)) + (count(*) - count(o_orderdate)) + (count(*) - count(o_orderpriority))) / (6 * count(*)), "
    "0) AS BIGINT) AS VARCHAR) FROM orders")
def dataset_metadata(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    missing = sum((F.count("*") - F.count(c) for c in o.columns), F.lit(0))
    one = o.agg(F.count("*").cast("string").alias("n_rows"), F.max(F.lit(str(len(o.columns)))).alias("n_columns"),
        F.round(100.0 * missing / (len(o.columns) * F.count("*")), 0).cast("long").cast("string").alias("missing_pct"))
    return one.unpivot([], one.columns, "item", "value")


NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("describe_numeric", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, "
    f"round(max({c}), 6) AS max FROM lineitem" for c in NUM))
def describe_numeric(spark, sf_dir):
    return P.describe_numeric(table(spark, sf_dir, "lineitem"), list(NUM))


@query("describe_categorical",
    "WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v, count(*) AS k FROM lineitem WHERE {c} IS NOT NULL GROUP BY ALL" for c in ("l_returnflag",
    "l_linestatus",
    "l_linenumber")) + ") SELECT column_name, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_unique, arg_min(v, (-k, v)) AS top, max(k) AS freq FROM x GROUP BY column_name")
def describe_categorical(spark, sf_dir):
    return P.describe_categorical(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("value_counts_norm", "SELECT c_mktsegment AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY c_mktsegment")
def value_counts_norm(spark, sf_dir):
    return P.value_counts(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in NUM for b in NUM if a < b))
def corr_matrix(spark, sf_dir):
    pairs = [(a, b) for a in NUM for b in NUM if a < b]
    one = table(spark, sf_dir, "lineitem").agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r")).alias(f"{a}{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*one.columns)).alias("x")).select("x.*")


_Q = "WITH q AS (SELECT quantile_cont({0}, 0.25) AS a, quantile_cont({0}, 0.75) AS b FROM {1}), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)"


@query("iqr_outliers", _Q.format("p_retailprice", "part") + " SELECT 'p_retailprice' AS column_name, count(p_retailprice) AS n, count(*) FILTER (p_retailprice < lo OR p_retailprice > hi) "
    "AS n_outliers, round(100.0 * count(*) FILTER (p_retailprice < lo OR p_retailprice > hi) / count(p_retailprice), 6) AS pct_outliers FROM part, f")
def iqr_outliers(spark, sf_dir):
    return P.outlier_share(table(spark, sf_dir, "part"), "p_retailprice")


@query("clip_outliers", _Q.format("value", "events") + " SELECT event_type, round(sum(least(greatest(value, lo), hi)), 4) AS clipped_sum, round(max(least(greatest(value, lo), hi)), 6) "
    "AS clipped_max FROM events, f GROUP BY event_type")
def clip_outliers(spark, sf_dir):
    return P.clipped(table(spark, sf_dir, "events"), "value").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("clipped_sum"), F.round(F.max("value"), 6).alias("clipped_max"))


@query("binning_cut", "SELECT CASE WHEN p_size >= 0 AND p_size < 10 THEN 'small' WHEN p_size >= 10 AND p_size < 25 THEN 'medium' WHEN p_size >= 25 "
    "AND p_size < 60 THEN 'large' END AS size_class, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY ALL")
def binning_cut(spark, sf_dir):
    c = P.cut(F.col("p_size"), [0, 10, 25, 60], ["small", "medium", "large"])
    return table(spark, sf_dir, "part").groupBy(c.alias("size_class")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"))


@query("quartile_high_low", "WITH q AS (SELECT s_suppkey, s_nationkey, s_acctbal, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q "
    "FROM supplier) SELECT s_suppkey, s_nationkey, q AS quartile, CASE q WHEN 4 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MID' END AS band FROM q")
def quartile_high_low(spark, sf_dir):
    q = F.ntile(4).over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey"))
    band = F.when(F.col("quartile") == 4, "HIGH").when(F.col("quartile") == 1, "LOW").otherwise("MID")
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", q.alias("quartile")).withColumn("band", band)


_HOLES = "WITH h AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)"


def _holes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"))


@query("group_impute_mean", f"{_HOLES} SELECT c_custkey, round(coalesce(bal, avg(bal) OVER (PARTITION BY c_mktsegment)), 6) AS filled FROM h")
def group_impute_mean(spark, sf_dir):
    return P.impute(_holes(spark, sf_dir), "bal", ["c_mktsegment"]).select("c_custkey", F.round("filled", 6).alias("filled"))


@query("group_impute_median", f"{_HOLES}, m AS (SELECT c_mktsegment, median(bal) AS m FROM h GROUP BY ALL) SELECT c_custkey, round(coalesce(bal, m), 6) AS filled FROM h JOIN m USING (c_mktsegment)")
def group_impute_median(spark, sf_dir):
    return P.impute(_holes(spark, sf_dir), "bal", ["c_mktsegment"], "median").select("c_custkey", F.round("filled", 6).alias("filled"))


#: All values of the column, so that a table has the same columns whatever rows it is of.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
BRANDS = tuple(f"Brand#{k}" for k in range(1, 26))


@query("crosstab",
    "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{v}') AS \"n_{v}\", round(100.0 * count(*) FILTER (o_orderpriority = '{v}') / count(*), 6) AS \"pct_{v}\"" for v in PRIORITIES) + " FROM orders GROUP BY o_orderstatus")
def crosstab(spark, sf_dir):
    return P.cross_table(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", list(PRIORITIES))


@query("row_normalised_props", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS pct "
    "FROM lineitem GROUP BY l_returnflag, l_linestatus")
def row_normalised_props(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag")), 6))


@query("table1", """WITH x AS (SELECT o_totalprice, o_orderpriority, o_orderstatus AS grp FROM orders UNION ALL SELECT o_totalprice, o_orderpriority, 'Total' FROM orders),
n AS (SELECT 'o_totalprice' AS variable, '' AS level, grp,
  count(o_totalprice) AS n, printf('%.4f (%.4f, %.4f)', quantile_cont(o_totalprice, 0.5), quantile_cont(o_totalprice, 0.25), quantile_cont(o_totalprice, 0.75)) AS value FROM x GROUP BY grp),
c AS (SELECT 'o_orderpriority' AS variable, o_orderpriority AS level, grp, count(*) AS n FROM x WHERE o_orderpriority IS NOT NULL GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT variable, level, grp, n, n || ' (' || printf('%.1f', 100.0 * n / sum(n) OVER (PARTITION BY grp)) || ')' FROM c""")
def table1(spark, sf_dir):
    return P.table_one(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_totalprice"], ["o_orderpriority"])


@query("dropped_counts", "SELECT 'lang' AS variable, count(*) FILTER (lang IS NULL OR lower(trim(lang)) IN ('', 'unknown', 'na', 'n/a', 'none', 'nan')) "
    "AS n_dropped, count(*) AS n FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL OR lower(trim(source)) IN ('', "
    "'unknown', 'na', 'n/a', 'none', 'nan')), count(*) FROM documents")
def dropped_counts(spark, sf_dir):
    blank = lambda c: F.col(c).isNull() | F.lower(F.trim(c)).isin("", "unknown", "na", "n/a", "none", "nan")
    return P.per_column(table(spark, sf_dir, "documents"), ["lang", "source"], lambda c: {"n_dropped": F.count_if(blank(c)), "n": F.count("*")}).withColumnRenamed("column_name", "variable")


_ITEMS = "WITH i AS (SELECT p_partkey, p_brand, unnest(list_distinct(string_split(p_name, ' '))) AS item FROM part), g AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.explode(F.array_distinct(F.split("p_name", " "))).alias("item"))


@query("prevalence_by_group", f"{_ITEMS} SELECT p_brand, item, count(DISTINCT p_partkey) AS k, round(count(DISTINCT p_partkey) / any_value(g.n), 6) AS prevalence "
    f"FROM i JOIN g USING (p_brand) GROUP BY p_brand, item HAVING count(DISTINCT p_partkey) >= 5")
def prevalence_by_group(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    k = _items(spark, sf_dir).groupBy("p_brand", "item").agg(F.count("*").alias("k")).where("k >= 5")
    return k.join(g, "p_brand").select("p_brand", "item", "k", F.round(F.col("k") / F.col("n"), 6).alias("prevalence"))


_SUBTYPE = "CASE WHEN p_partkey % 9 = 0 THEN '<missing>' ELSE p_brand END"


@query("top_items_by_subtype", f"""WITH p AS (SELECT p_partkey, {_SUBTYPE} AS subtype, p_name FROM part), i AS (SELECT DISTINCT p_partkey, subtype, unnest(string_split(p_name, ' ')) AS item FROM p),
g AS (SELECT subtype, count(*) AS n FROM p GROUP BY subtype), t AS (SELECT item FROM i GROUP BY item ORDER BY count(*) DESC, item LIMIT 5)
SELECT g.subtype, t.item, count(i.item) AS k, round(count(i.item) / any_value(g.n), 6) AS prevalence
FROM g CROSS JOIN t LEFT JOIN i ON i.subtype = g.subtype AND i.item = t.item GROUP BY g.subtype, t.item""")
def top_items_by_subtype(spark, sf_dir):
    """The five most common items in every group, 0 where a group has none; rows without a group are <missing>: a top-k report."""
    brand = F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.coalesce(brand, F.lit("<missing>")).alias("subtype"), "p_name")
    i = p.select("subtype", F.explode(F.array_distinct(F.split("p_name", " "))).alias("item"))
    top = i.groupBy("item").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "item").limit(5).select("item")
    g = p.groupBy("subtype").agg(F.count("*").alias("n"))
    grid = g.join(F.broadcast(top.agg(F.collect_list("item").alias("items")))).select("subtype", "n", F.explode("items").alias("item"))  # one row of five
    k = i.join(F.broadcast(top), "item", "left_semi").groupBy("subtype", "item").agg(F.count("*").alias("k"))
    n = F.coalesce("k", F.lit(0))
    return grid.join(k, ["subtype", "item"], "left").select("subtype", "item", n.alias("k"), F.round(n / F.col("n"), 6).alias("prevalence"))


@query("top_k_per_group", "SELECT c_nationkey, c_custkey, round(c_acctbal, 2) AS c_acctbal, rn AS place FROM (SELECT *, row_number() "
    "OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("place", F.row_number().over(w)).where("place <= 3").select("c_nationkey", "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), "place")


@query("mean_sd_format", "SELECT event_type, printf('%.3f ± %.3f', avg(value), stddev_samp(value)) AS value FROM events GROUP BY event_type")
def mean_sd_format(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.format_string("%.3f ± %.3f", F.avg("value"), F.stddev_samp("value")).alias("value"))


@query("mode_per_group", "WITH c AS (SELECT o_orderpriority AS g, extract(month FROM o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL) SELECT g, "
    "arg_min(m, (-n, m)) AS mode, max(n) AS freq, round(100.0 * max(n) / sum(n), 6) AS pct FROM c GROUP BY g")
def mode_per_group(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.month("o_orderdate").cast("long").alias("m")).agg(F.count("*").alias("n"))
    return c.groupBy("g").agg(F.min_by("m", F.struct(-F.col("n"), F.col("m"))).alias("mode"), F.max("n").alias("freq"), F.round(100.0 * F.max("n") / F.sum("n"), 6).alias("pct"))


@query("histogram", "SELECT CAST(floor(o_totalprice / 50000) AS BIGINT) AS bin, count(*) AS n, round(min(o_totalprice), 6) AS lo, round(max(o_totalprice), 6) AS hi FROM orders GROUP BY ALL")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_totalprice") / 50000).alias("bin")).agg(F.count("*").alias("n"),
        F.round(F.min("o_totalprice"), 6).alias("lo"), F.round(F.max("o_totalprice"), 6).alias("hi"))


@query("cohort_rate_gap", "SELECT l_shipmonth, round(100.0 * avg(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1.0 ELSE 0 END), 6) AS rate_o "
    "FROM (SELECT *, extract(month FROM l_shipdate) AS l_shipmonth FROM lineitem) GROUP BY l_shipmonth HAVING abs(avg(CASE "
    "WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END) - avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END)) > 0.01")
def cohort_rate_gap(spark, sf_dir):
    rate = lambda c: F.avg(c.cast("double"))
    s = F.col("l_linestatus")
    return (
        table(spark, sf_dir, "lineitem").groupBy(F.month("l_shipdate").cast("long").alias("l_shipmonth"))
        .agg(F.round(100.0 * rate((F.col("l_returnflag") == "R") & (s == "O")), 6).alias("rate_o"), F.abs(rate(s == "O") - rate(s == "F")).alias("gap")).where("gap > 0.01").drop("gap")
    )


@query("label_encode_one_hot",
    "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS code, " + ", ".join(f"CASE WHEN p_brand = '{b}' THEN 1 ELSE 0 END AS brand_{b[6:]}" for b in BRANDS) + " FROM part")
def label_encode_one_hot(spark, sf_dir):
    """Codes by sorted value come from the distinct values, so no global window runs over the rows."""
    p = table(spark, sf_dir, "part")
    codes = p.select("p_type").distinct().transform(lambda d: numbered(d, ["p_type"], "code")).withColumn("code", F.col("code") - 1)
    hot = [F.when(F.col("p_brand") == b, 1).otherwise(0).alias(f"brand_{b[6:]}") for b in BRANDS]
    return p.join(codes, "p_type").select("p_partkey", "code", *hot)
