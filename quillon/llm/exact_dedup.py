"""Exact deduplication by deterministic block naming (operator 4), in DataFrame operations only.

A text, without its white space, is cut into blocks of fixed size. The distinct blocks are sorted and get integer names;
then adjacent names are paired, the distinct pairs are sorted and named, and so on until each document has one name. Two
documents have equal names exactly if they have equal texts, as blocks and pairs are compared themselves, never only
their digests. Copies of a block or pair meet in partial aggregation before they are shuffled, and rows that pick up
names are joined in plain equi-joins whose hot keys adaptive execution splits.

Documents fetch the names of their blocks by a 128-bit fingerprint so that text is shuffled once; that no two distinct
blocks share one is checked, and the fingerprints are drawn anew with another seed otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table

#: Characters of a block.
BLOCK = 16_384
_SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def without_space(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in _SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows with integer names in sorted order within each partition; the same again when a task is repeated."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def exact_groups(docs: DataFrame, *, block: int = BLOCK, fingerprint_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep id, group_size, kept, text_sha256 of the text without white space.

    Of equal texts the row with the most characters, then the smallest id, then the first row stays, so one row of each
    group is kept even where ids repeat. Null text counts as empty; all empty texts are one group. A null id orders last.
    Columns other than the id and the text are not read. An empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("_chars"), without_space(F.col(text_col)).alias("_t"))
    cut = F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    most = F.lit((1 << (fingerprint_bits - 1)) - 1)
    seed = 0
    while True:
        print_of = lambda b: F.struct(F.xxhash64(F.lit(seed), b).bitwiseAND(most).alias("x"), F.xxhash64(b, F.lit(~seed)).bitwiseAND(most).alias("y"))  # noqa: B023, E731
        base = materialize(rows.select("_row", "_id", "_chars", F.sha2("_t", 256).alias("_sha"), F.transform(cut, print_of).alias("_prints")), "blocks")
        blocks = rows.select(F.explode(cut).alias("b")).select(print_of(F.col("b")).alias("p"), "b").distinct()
        names = materialize(_named(blocks, ["b"]).select("p.x", "p.y", "name"), "names")
        if not names.groupBy("x", "y").count().where("count > 1").take(1):
            break
        seed, most = seed + 1, F.lit((1 << 63) - 1)
    # Documents of one block have their name; others go through pairing.
    each = base.select("_row", F.posexplode("_prints").alias("i", "p")).select("_row", "i", "p.x", "p.y").join(names, ["x", "y"]).select("_row", "i", "name")
    each = materialize(each, "level0")
    ready = each.join(base.where(F.size("_prints") <= 1).select("_row"), "_row", "left_semi").select("_row", F.lit(0).alias("level"), "name")
    level, longest = 0, base.agg(F.max(F.size("_prints"))).first()[0] or 0
    if longest > 1:
        many = each.join(base.where(F.size("_prints") > 1).select("_row"), "_row", "left_semi")
        now = materialize(many.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda s: s["name"]).alias("n")), "names-of-rows")
        while longest > 1:
            level, longest = level + 1, (longest + 1) // 2
            half = F.sequence(F.lit(0), F.floor((F.size("n") - 1) / 2).cast("int"))
            pair = F.transform(half, lambda k: F.struct(k.alias("i"), F.element_at("n", 2 * k + 1).alias("a"), F.coalesce(F.try_element_at("n", 2 * k + 2), F.lit(-1)).alias("b")))
            pairs = now.select("_row", F.explode(pair).alias("p")).select("_row", "p.i", "p.a", "p.b")
            named = materialize(_named(pairs.select("a", "b").distinct(), ["a", "b"]), "pairs")
            up = pairs.join(named, ["a", "b"]).groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda s: s["name"]).alias("n"))
            now = materialize(up, "names-of-rows")
            ready = ready.unionByName(now.where(F.size("n") == 1).select("_row", F.lit(level).alias("level"), F.element_at("n", 1).alias("name")))
            now = now.where(F.size("n") > 1)
    key = F.coalesce(F.col("name") * 64 + F.col("level"), F.lit(-1)).alias("_key")  # -1: the empty text
    keyed = materialize(base.select("_row", "_id", "_chars", "_sha").join(ready, "_row", "left").select("_row", "_id", "_chars", "_sha", key), "keys")
    best = F.min_by(F.struct(F.col("_id").alias("id"), F.col("_row").alias("row")), F.struct(-F.col("_chars"), F.col("_id").isNull(), F.col("_id"), F.col("_row")))
    groups = materialize(keyed.groupBy("_key").agg(F.count("*").alias("size"), best.alias("best")).where("size > 1"), "groups")
    return (
        keyed.join(groups, "_key", "left")
        .select(
            F.col("_id").alias(id_col),
            F.when(F.col("size").isNull(), F.col("_id")).otherwise(F.col("best.id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("size").isNull() | (F.col("best.row") == F.col("_row"))).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  first_value(doc_id) OVER w = doc_id AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""
