"""Documents to training tokens: language ID, exact and near deduplication, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet, reads it again
as the next one's docs, and drops what the stage was computed from. All but the last return the columns of documents. A
stage that judges rows one by one carries the whole row through its operator, so nothing is joined back; the two
deduplications join on doc_id, null-safely. Every stage takes empty tables, null ids and texts and texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import encode_documents
from quillon.llm.common import mark, settle, table
from quillon.llm.decontaminate import contamination
from quillon.llm.exact_dedup import exact_groups, without_space
from quillon.llm.language_id import UNDETERMINED, fit, held_out, identify
from quillon.llm.near_dedup import near_classes


def _carried(docs: DataFrame) -> DataFrame:
    """The whole row in one column, which an operator takes the text out of: sent once, and no other column can clash."""
    return docs.select(F.struct("*").alias("_doc"))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids."""
    keys = ids.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_kept"]), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones among them), and those between two languages, go.

    Two languages with the same loss are such a tie. Rows that repeat an id are judged one by one.
    """
    model = fit(docs.where(~held_out()))
    judged = identify(_carried(docs), model, id_col="_doc", text_col="_doc.text")
    return judged.where((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous")).select("_doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts but for white space one stays: with the most characters, then the smallest id.

    Null and empty texts are equal; a null id orders last. Rows that repeat an id are told apart by their texts; of rows
    that repeat both, the one whose other columns are smallest stays.
    """
    kept = exact_groups(docs).where("kept")
    if not docs.groupBy("doc_id").count().where("count > 1").take(1):
        return _only(docs, kept)
    keys = kept.select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_sha")).distinct()
    text = F.sha2(without_space(F.col("text")), 256)
    rows = docs.join(keys, docs["doc_id"].eqNullSafe(keys["_kept"]) & (text == keys["_sha"]), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Of an id's rows in one group the longest text is the one that stays, then the first in order.
    first = F.min_by(F.struct("text", *rest), F.struct(-F.coalesce(F.length("text"), F.lit(0)), "text", *rest)).alias("_row")
    return rows.groupBy("doc_id", text.alias("_sha")).agg(first).select("doc_id", "_row.*").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays; rows that repeat its id stay with it.

    Texts without words are classes of their own; a row without an id goes if another has its words.
    """
    return _only(docs, near_classes(docs).where("doc_id <=> class_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark's passages make up a twentieth of, or more, go; those without words stay.

    Rows that repeat an id are judged one by one; an empty benchmark leaves all.
    """
    judged = contamination(_carried(docs), table(spark, sf_dir, "benchmark"), id_col="_doc", text_col="_doc.text")
    return judged.where(~F.col("contaminated")).select("_doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of them and of the decoded text; null and empty texts have none."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("bpe", tokens),
]

#: No SQL expresses the first stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}", since)
    return docs
