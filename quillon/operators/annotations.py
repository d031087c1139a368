"""The canonical model of coded annotations.

A wide row has a case, an element, whether the element is present in the source (0, 1, NULL) and one code for each
annotator: 1 correct, 2 omitted, 3 fabricated, 'N/A' rightly left out, NULL missing. The long form has one row for each
annotator. Domains are a bridge (element, domain): an element may be in several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATORS = ("human", "ai")
#: Spellings of the code for "not applicable" once trimmed and upper-cased.
NOT_APPLICABLE = ("NA", "N/A")


def normal_code(code: Column) -> Column:
    """Trimmed code; every spelling of "not applicable" becomes N/A."""
    c = F.trim(code)
    return F.when(F.upper(c).isin(*NOT_APPLICABLE), F.lit("N/A")).otherwise(c)


def numeric_code(code: Column) -> Column:
    """Code as a number, NULL where it isn't one."""
    return code.try_cast("double")


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """A wide annotation table derived from order lines by integer arithmetic."""
    absent = (F.col("l_partkey") + F.col("l_linenumber")) % 5 == 0
    source = F.when(F.col("l_suppkey") % 19 == 0, None).when(absent, 0).otherwise(1)
    mixed = (F.col("l_orderkey") + F.col("l_partkey")) % 20
    human = F.when(F.col("l_orderkey") % 23 == 0, None).when(absent & (F.col("l_suppkey") % 10 == 0), "3").when(absent, " n/a").when(mixed == 19, "3").when(mixed >= 17, "2").otherwise("1")
    rest = F.col("l_suppkey") % 25
    ai = F.when(F.col("l_orderkey") % 29 == 0, None).when(absent & (F.col("l_partkey") % 7 == 0), "3").when(absent, "NA").when(rest == 24, "3").when(rest >= 23, "2").otherwise("1")
    return lineitem.select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("element"), source.alias("source"),
            normal_code(human).alias("human"), normal_code(ai).alias("ai")
    )


def long_form(wide: DataFrame, annotators: tuple[str, ...] = ANNOTATORS) -> DataFrame:
    """One row for each annotator of each wide row, in one pass."""
    keep = [c for c in wide.columns if c not in annotators]
    return wide.unpivot(keep, list(annotators), "annotator", "code")


def domain_bridge(spark: SparkSession) -> DataFrame:
    rows = [(f"E{i}", "A") for i in range(1, 6)] + [(f"E{i}", "B") for i in range(5, 8)]
    return spark.createDataFrame(rows, "element string, domain string")


#: The same tables in DuckDB SQL.
CTE = """
wide0 AS (
  SELECT l_orderkey AS case_id, 'E' || CAST(l_linenumber AS VARCHAR) AS element,
    CASE WHEN l_suppkey % 19 = 0 THEN NULL WHEN (l_partkey + l_linenumber) % 5 = 0 THEN 0 ELSE 1 END AS source,
    CASE WHEN l_orderkey % 23 = 0 THEN NULL
         WHEN (l_partkey + l_linenumber) % 5 = 0 THEN CASE WHEN l_suppkey % 10 = 0 THEN '3' ELSE 'N/A' END
         WHEN (l_orderkey + l_partkey) % 20 = 19 THEN '3' WHEN (l_orderkey + l_partkey) % 20 >= 17 THEN '2' ELSE '1' END AS human,
    CASE WHEN l_orderkey % 29 = 0 THEN NULL
         WHEN (l_partkey + l_linenumber) % 5 = 0 THEN CASE WHEN l_partkey % 7 = 0 THEN '3' ELSE 'N/A' END
         WHEN l_suppkey % 25 = 24 THEN '3' WHEN l_suppkey % 25 >= 23 THEN '2' ELSE '1' END AS ai
  FROM lineitem),
ann AS (
  SELECT case_id, element, source, 'human' AS annotator, human AS code FROM wide0
  UNION ALL SELECT case_id, element, source, 'ai' AS annotator, ai AS code FROM wide0),
bridge AS (SELECT * FROM (VALUES ('E1','A'),('E2','A'),('E3','A'),('E4','A'),('E5','A'),('E5','B'),('E6','B'),('E7','B')) t(element, domain))
"""
