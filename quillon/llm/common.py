"""Helpers shared by the corpus operators: table access, shared scratch space and Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text characters that one step of a Python worker handles at once; bounds its memory whatever a batch holds.
CHUNK_CHARS = 1_000_000
#: Bytes of an Arrow batch on its way to a Python worker (a row at least).
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where that is unset, a session in one process (tests) gets a temporary folder; on a cluster it is an error, as executors
    would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quillon-{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it again: cuts lineage, survives lost executors, computes once."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = (spark, path)
    return out


def release(*tables: DataFrame) -> None:
    """Drop what materialize() wrote for these tables: nothing reads them any more."""
    for t in tables:
        _drop(*t._scratch)
        _scratch.remove(t._scratch)


def _drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    return len(_scratch)


def settle(df: DataFrame, label: str, since: int) -> DataFrame:
    """df written, and all scratch folders dropped that were made since mark(): those that it was computed from."""
    written = materialize(df, label)
    for owner, path in _scratch[since:-1]:
        _drop(owner, path)
    del _scratch[since:-1]
    return written


def drop_since(since: int) -> None:
    """Drop all scratch folders that were made since mark()."""
    for owner, path in _scratch[since:]:
        _drop(owner, path)
    del _scratch[since:]


@atexit.register
def _drop_scratch() -> None:
    for spark, path in _scratch:
        try:
            _drop(spark, path)
        except Exception:  # the session may be gone at exit; the folder is scratch space
            return


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches for Python workers at BATCH_BYTES; a smaller setting stays."""
    if (now := int(spark.conf.get(_BATCH).rstrip("b"))) > BATCH_BYTES or now <= 0:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Memory that a finished task has freed goes back to the system: idle workers hold on to little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def text_chunks(batch: pa.RecordBatch, text_col: str, most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with at most `most` characters of text (one row at least); null text becomes empty.

    text_col may name a field of a struct column: "column.field".
    """
    start, held, texts = 0, 0, []
    name, _, field = text_col.partition(".")
    column = batch.column(batch.schema.get_field_index(name))
    if field:
        column = column.field(field)
    for i in range(batch.num_rows):
        t = column[i].as_py() or ""
        if texts and held + len(t) > most:
            yield batch.slice(start, i - start), texts
            start, held, texts = i, 0, []
        texts.append(t)
        held += len(t)
    if texts:
        yield batch.slice(start), texts


def map_text(
    docs: DataFrame,
    schema: T.StructType,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    *,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    chunk: int = CHUNK_CHARS,
) -> DataFrame:
    """Rows of docs with the columns `keep` and those that a worker-side function makes of whole texts.

    make() runs once per task and returns f(texts) -> {column: values}; what it holds goes when the task ends. schema lists
    the added columns only. text_col may be a field of a kept struct column ("column.field"): the text is then sent once.
    """
    name = text_col.partition(".")[0]
    kept = docs.select(*keep, *([] if name in keep else [text_col]))
    fields = [kept.schema[k] for k in keep] + list(schema.fields)
    out = T.StructType(fields)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        f = make()
        try:
            for batch in batches:
                for rows, texts in text_chunks(batch, text_col, chunk):
                    got = f(texts)
                    cols = [rows.column(rows.schema.get_field_index(k)) for k in keep]
                    arrays = [c if c.type == a.type else c.cast(a.type) for c, a in zip(cols, arrow)]
                    arrays += [pa.array(got[a.name], a.type) for a in list(arrow)[len(keep) :]]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            f = None
            give_back()

    return kept.mapInArrow(run, out)


def doc_bucket(doc_id: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))
