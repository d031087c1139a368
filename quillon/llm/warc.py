"""WARC archives with revisit records and a merged capture index (operator 6).

*Writing.* Pages get a payload digest; of equal payloads the one with the smallest id is written as a response, others as
revisits that refer to it. Records are WARC/1.1 in gzip files, written by Spark's own writer into the shared folder (a
record ends with two line ends, which are the writer's separator), so tasks may be repeated and any file system will do.

*Reading.* Files are read whole and parsed by Content-Length, so payloads may hold anything, WARC headers included. Records
of one class of sizes share files, as many as `CLASSES` allows, so a file is of bounded size unless one record is larger.

*Index.* Each file is a locally sorted run of captures: by URL key, timestamp and id. The shuffle deals the runs' entries
into ranges of about `RANGE` entries, cut on key, timestamp and id, so a key with very many captures spreads over several.
A task merges what the runs have in its range by a loser tree; ranges follow each other, so the result is one globally
ordered history of captures.

Null html is an empty payload, a null url an empty one. Rows that repeat an id are separate records; a payload's smallest
id is then a response in each of them. A null id is written as such and orders last. An empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, scratch_path, table

END = "\r\n\r\n"
#: Payload bytes of a record below which it shares a file with so many others; files are read whole.
CLASSES = ((16 << 10, 5_000), (256 << 10, 300), (4 << 20, 20), (1 << 62, 1))
#: Index entries of one range, which a task holds.
RANGE = 200_000
#: Entries of a run that are Python objects at once.
_LAZY = 500
_LINE = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: five hex digits give four base32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels from right to left, then path and query in lower case: pages of a site sort together."""
    bare = F.regexp_replace(F.lower(url), "^[a-z]+://(www\\.)?", "")
    host = F.regexp_replace(F.regexp_extract(bare, "^[^/?#]*", 0), ":[0-9]+$", "")
    rest = F.regexp_replace(F.regexp_extract(bare, "^[^/?#]*([^#]*)", 1), "^$", "/")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)


def captures(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", start: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages with digest, type and the id referred to. A page's timestamp is `start` plus its id in seconds."""
    p = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    marks = materialize(p.select("id", F.sha2("html", 256).alias("h")), "payloads")
    of = materialize(marks.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first"), "responses")
    p = p.withColumn("h", F.sha2("html", 256)).join(of, "h", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    stamp = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(start))) + F.pmod(F.coalesce(F.col("id"), F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return p.select("id", "url", url_key(F.col("url")).alias("key"), stamp.alias("stamp"), "html", F.octet_length("html").alias("bytes"),
        base32_sha1(F.col("html")).alias("digest"), F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again,
        F.col("first")).alias("refers_to"))


def _record(c: DataFrame) -> Column:
    """The text of a record without its last two line ends."""
    id_ = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    revisit = F.col("kind") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    safe = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("kind")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), id_, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Date: "), F.col("stamp")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(_LINE, *lines), F.lit(END), block)


def size_class(payload_bytes: Column) -> Column:
    out = F.lit(len(CLASSES) - 1)
    for k in range(len(CLASSES) - 2, -1, -1):
        out = F.when(payload_bytes < CLASSES[k][0], k).otherwise(out)
    return out


def size_classes(pages: DataFrame, payload_col: str = "html") -> list[int]:
    """The classes of sizes that occur."""
    return sorted(r.k for r in pages.select(size_class(F.octet_length(F.coalesce(F.col(payload_col), F.lit("")))).alias("k")).distinct().collect())


def write_warc(c: DataFrame, path: str, classes: list[int] | None = None) -> None:
    """captures() as gzip WARC files in a folder of path for each class of sizes, each file a run sorted by key, timestamp and id."""
    for k in range(len(CLASSES)) if classes is None else classes:
        sized = c.where(size_class(F.col("bytes")) == k).sortWithinPartitions("key", "stamp", "id").select(_record(c).alias("value"))
        sized.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", CLASSES[k][1]).text(f"{path}/size-{k}")


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record of a WARC file."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = data[at:stop].decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in head[1:])
        n = int(fields["Content-Length"])
        yield at, fields, data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n + 4


def _page(urn: str) -> int | None:
    v = urn.rsplit(":", 1)[-1].rstrip(">")
    return None if v == "null" else int(v)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at path: file, pos, id, url, stamp, kind, digest, bytes, refers_to, and whether a response's block has its digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup",
        "true").load(path).select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("file"), "content")
    names = ["file", "pos", "id", "url", "stamp", "kind", "digest", "bytes", "refers_to", "sound"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                name = batch.column(0)[i].as_py()
                for at, f, block in parse(batch.column(1)[i].as_py()):
                    digest, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"]
                    sound = kind == "revisit" or base64.b32encode(hashlib.sha1(block).digest()).decode() == digest and len(block) == int(f["WARC-Payload-Length"])
                    ref = f.get("WARC-Refers-To")
                    rows.append((name, at, _page(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Date"], kind, digest, int(f["WARC-Payload-Length"]), _page(ref) if ref else None, sound))
                if rows:
                    cols = [list(x) for x in zip(*rows)]
                    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return files.mapInArrow(run, "file string, pos bigint, id bigint, url string, stamp string, kind string, digest string, bytes bigint, refers_to bigint, sound boolean")


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, the root's winner comes out next."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a, i) < (b, j)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = i
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head
            i = self.winner
            self.heads[i] = next(self.runs[i], None)
            self._replay(i)


def merged_index(records: DataFrame, *, entries_of_range: int = RANGE) -> DataFrame:
    """All captures in one global order of key, timestamp and id: key, stamp, id, file, pos and position (0 for the first).

    records is counted, and read twice: give a written table.
    """
    entries = records.select(url_key(F.col("url")).alias("key"), "stamp", "id", "file", "pos")
    n = max(1, -(-entries.count() // entries_of_range))
    ranged = entries.repartitionByRange(n, F.col("key"), F.col("stamp"), F.col("id").asc_nulls_last())
    sorted_runs = ranged.sortWithinPartitions("file", "key", "stamp", F.col("id").asc_nulls_last(), "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            files = batch.column(3)
            at = 0
            while at < batch.num_rows:  # files follow each other
                name = files[at].as_py()
                size = int(pc.sum(pc.cast(pc.equal(files.slice(at), name), pa.int64())).as_py())
                runs.setdefault(name, []).append(batch.slice(at, size))
                at += size
        part, seq = TaskContext.get().partitionId(), 0

        def entries_of(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
            for p in parts:
                for a in range(0, p.num_rows, _LAZY):
                    for key, stamp, id_, file, pos in zip(*(c.to_pylist() for c in p.slice(a, _LAZY).columns)):
                        yield key, stamp, id_ is None, id_ or 0, file, pos

        def written(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part", "seq", "key", "stamp", "id", "file", "pos"])

        out = []
        for key, stamp, none, id_, file, pos in LoserTree([entries_of(r) for r in runs.values()]):
            out.append((part, seq, key, stamp, None if none else id_, file, pos))
            seq += 1
            if len(out) == _LAZY * 8:
                yield written(out)
                out = []
        if out:
            yield written(out)

    schema = "part int, seq bigint, key string, stamp string, id bigint, file string, pos bigint"
    merged = materialize(sorted_runs.mapInArrow(run, schema), "history")
    # One row a range: where its entries begin.
    before = merged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return merged.join(F.broadcast(before), "part").select("key", "stamp", "id", "file", "pos", (F.col("before") + F.col("seq")).alias("position"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = scratch_path(spark, "warc"), table(spark, sf_dir, "pages")
    write_warc(captures(pages), path, size_classes(pages))
    records = materialize(read_warc(spark, path), "records")
    history = merged_index(records).select("file", "pos", F.col("key").alias("url_key"), "position")
    return records.join(history, ["file", "pos"]).select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
            F.col("kind").alias("record_type"), "refers_to", "sound", "url_key", "stamp", "position"
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, regexp_replace(lower(regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7F]', '%20', 'g')), '^[a-z]+://(www\\.)?', '') AS u FROM pages),
x AS (SELECT page_id, u, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p),
d AS (SELECT *, list_reduce([''] || list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST((CAST('0x' || substr(s, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INT), 1)), lambda a, b: a || b) AS b,
  array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(u, '^[^/?#]*'), ':[0-9]+$', ''), '.')), ',') || ')'
    || CASE regexp_extract(u, '^[^/?#]*([^#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(u, '^[^/?#]*([^#]*)', 1) END AS url_key,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to, true AS sound, url_key, stamp, row_number() OVER (ORDER BY url_key, stamp, page_id) - 1 AS position FROM d
"""
