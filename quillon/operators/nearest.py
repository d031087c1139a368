"""Nearest rows and close pairs of vectors, by products of matrices.

Vectors are packed into blocks of rows, every block of one side meets every block of the other, and one product of matrices
gives a block's scores. Products only select: what comes near enough to count is computed again term by term in order, as
SQL sums, and only that leaves a task. So rows between tasks grow with blocks and results, never with pairs of vectors.

Elements that are null count as 0 and shorter vectors as if filled up with 0; a null or empty vector has no score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.ranges import settled

#: Rows of a block, of the side that is looked through and of the side that looks.
ROWS, QUERIES = 4096, 1024
#: Bytes of an Arrow batch on its way to a Python worker (a row at least).
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
#: What rounding to 6 digits can hide, and a bound on the relative error of a product's terms in single and double precision.
_ROUNDED, _SINGLE, _DOUBLE = 1.1e-6, 1.2e-7, 4e-16


def _small_batches(df: DataFrame) -> None:
    conf = df.sparkSession.conf
    if (now := int(conf.get(_BATCH).rstrip("b"))) > _BATCH_BYTES or now <= 0:
        conf.set(_BATCH, str(_BATCH_BYTES))


def packed(vectors: DataFrame, rows: int, parts: int, prefix: str) -> DataFrame:
    """Blocks of at most `rows` rows of (id long, y, v array<double>): a number, ids, ys, whether there is a vector, and the vectors."""
    kind = vectors.schema["y"].dataType
    out = T.StructType([T.StructField(f"{prefix}{n}", t) for n, t in (("block", T.LongType()), ("ids", T.ArrayType(T.LongType())), ("ys", T.ArrayType(kind)), ("has", T.BinaryType()), ("size", T.IntegerType()), ("data", T.BinaryType()))])

    def block(held: list[pa.RecordBatch], number: int, arrow: pa.Schema) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        v = t.column("v").combine_chunks()
        n = np.where(v.is_valid().to_numpy(zero_copy_only=False), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        flat = v.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
        wide = np.zeros((len(n), int(n.max(initial=0))))
        wide[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        whole = lambda c, t_: pa.array([t.column(c).to_pylist()], t_)
        values = [pa.array([number], pa.int64()), whole("id", arrow.field(1).type), whole("y", arrow.field(2).type), pa.array([(n > 0).tobytes()], pa.binary()), pa.array([wide.shape[1]], pa.int32()), pa.array([wide.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(values, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, number = to_arrow_schema(out), TaskContext.get().partitionId() << 32
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, rows - n)
                held, n, batch = [*held, some], n + some.num_rows, batch.slice(some.num_rows)
                if n == rows:
                    yield block(held, number, arrow)
                    held, n, number = [], 0, number + 1
        if held:
            yield block(held, number, arrow)

    dealt = vectors.select("id", "y", F.col("v").cast("array<double>").alias("v")).repartition(parts)
    return settled(dealt.mapInArrow(run, out))


class _Block:
    """A packed block as arrays; columns holds the vectors by element."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str):
        get = lambda c: batch.column(batch.schema.get_field_index(f"{prefix}{c}"))[i]
        self.number = get("block").as_py()
        self.ids = get("ids").values.to_numpy(zero_copy_only=False)
        self.ys = np.empty(len(self.ids), object)
        self.ys[:] = get("ys").as_py()
        self.has = np.frombuffer(get("has").as_py(), bool)
        self.data = np.frombuffer(get("data").as_py(), np.float64).reshape(len(self.ids), get("size").as_py())
        self.columns = np.ascontiguousarray(self.data.T)
        self.squares = np.zeros(len(self.ids))
        for c in self.columns:
            self.squares += c * c
        self.norms = np.sqrt(self.squares)

    def unit(self) -> np.ndarray:
        with np.errstate(all="ignore"):
            u = self.data / self.norms[:, None]
        u[~(self.has & (self.norms > 0))] = 0
        return u.astype(np.float32)


def _narrowed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(a.shape[1], b.shape[1])
    return a[:, :n], b[:, :n]


def _cosines(q: _Block, v: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows i of q and j of v, summed in order; -inf where there is none."""
    total = np.zeros(len(i))
    for a, b in zip(q.columns, v.columns):
        total += a[i] * b[j]
    with np.errstate(all="ignore"):
        total = total / (q.norms[i] * v.norms[j])
    total[~(q.has[i] & v.has[j] & (q.norms[i] > 0) & (v.norms[j] > 0))] = -np.inf
    return total


def _nearness(q: _Block, v: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances below 0, summed in order; -inf where there is none."""
    total = np.zeros(len(i))
    none = np.zeros(1)
    for k in range(max(len(q.columns), len(v.columns))):
        a = q.columns[k][i] if k < len(q.columns) else none
        b = v.columns[k][j] if k < len(v.columns) else none
        total += (a - b) * (a - b)
    return np.where(q.has[i] & v.has[j], -total, -np.inf)


def _scores(q: _Block, v: _Block, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """All scores of a block's rows with another's, about right, and by how much each row's may be wrong, both ways together."""
    if cosine:
        a, b = _narrowed(q.unit(), v.unit())
        s, off = a @ b.T, np.full(len(q.ids), 2 * (a.shape[1] + 8) * _SINGLE)
        s[~(q.has & (q.norms > 0))] = -np.inf
        s[:, ~(v.has & (v.norms > 0))] = -np.inf
        return s, off
    a, b = _narrowed(q.data, v.data)
    s = 2 * (a @ b.T) - q.squares[:, None] - v.squares
    s[~q.has] = -np.inf
    s[:, ~v.has] = -np.inf
    return s, (q.squares + v.squares.max(initial=0)) * 4 * (a.shape[1] + 8) * _DOUBLE


def _below(least: np.ndarray, s: np.ndarray) -> np.ndarray:
    """No more than `least`, as precise as s."""
    return np.nextafter(least.astype(s.dtype), s.dtype.type(-np.inf))


class _Best:
    """The best rows so far for a block of queries: k of each, all that rounding may rank among them, of equal ones those of smallest id."""

    def __init__(self, queries: int, k: int, hidden: float):
        self.k, self.hidden = k, hidden
        self.least = np.full(queries, -np.inf)
        self.i, self.id, self.y, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object), np.empty(0)

    def take(self, q: _Block, v: _Block, cosine: bool, but_itself: bool) -> None:
        s, off = _scores(q, v, cosine)
        if but_itself:
            by = np.argsort(v.ids, kind="stable")
            low, high = (np.searchsorted(v.ids[by], q.ids, side) for side in ("left", "right"))
            for i in np.flatnonzero(high > low).tolist():
                s[i, by[low[i] : high[i]]] = -np.inf
        least = self.least - off
        new = np.isneginf(self.least)
        if new.any() and s.shape[1] > self.k:
            least[new] = np.partition(s[new], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - off[new]
        i, j = np.nonzero(s >= _below(least - self.hidden, s)[:, None])
        if but_itself:
            other = q.ids[i] != v.ids[j]
            i, j = i[other], j[other]
        if not len(i):
            return
        score = (_cosines if cosine else _nearness)(q, v, i, j)
        i, y = np.append(self.i, i), np.append(self.y, v.ys[j])
        ids, score = np.append(self.id, v.ids[j]), np.append(self.score, score)
        by = np.lexsort((ids, -score, i))
        i, ids, y, score = i[by], ids[by], y[by], score[by]
        place = np.arange(len(i))
        first = lambda new: np.maximum.accumulate(np.where(np.append(True, new), place, 0))
        in_query = place - first(i[1:] != i[:-1])
        in_tie = place - first((i[1:] != i[:-1]) | (score[1:] != score[:-1]))
        last = in_query == self.k - 1
        self.least[i[last]] = score[last]
        keep = (score >= self.least[i] - self.hidden) & (in_tie < self.k)
        self.i, self.id, self.y, self.score = i[keep], ids[keep], y[keep], score[keep]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, _Block]]:
    """The two blocks of each row; what the last row had too is not unpacked again."""
    a = b = None
    for batch in batches:
        numbers = [batch.column(batch.schema.get_field_index(f"{p}_block")) for p in "qv"]
        for r in range(batch.num_rows):
            if a is None or a.number != numbers[0][r].as_py():
                a = _Block(batch, r, "q_")
            if b is None or b.number != numbers[1][r].as_py():
                b = _Block(batch, r, "v_")
            yield a, b


def _parts(df: DataFrame) -> int:
    return max(8, df.sparkSession.sparkContext.defaultParallelism)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, cosine: bool, but_itself: bool) -> DataFrame:
    """For every query the k best of vectors and all that may tie with them: (q, id, y, score). Exact; rank them by score, then id.

    vectors (id, y, v), queries (id, v). The score is the cosine, of which rounding to 6 digits may make ties, or the squared
    distance below 0; it is null where there is none. With but_itself, rows of the query's own id don't count.
    """
    _small_batches(vectors)
    v = packed(vectors, ROWS, 2 * _parts(vectors), "v_")
    q = packed(queries.withColumn("y", F.lit(None).cast("int")), QUERIES, _parts(queries), "q_")
    out = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", T.LongType()), T.StructField("y", vectors.schema["y"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        best: dict[int, tuple[np.ndarray, _Best]] = {}
        for a, b in _met(batches):
            if a.number not in best:
                best[a.number] = a.ids.copy(), _Best(len(a.ids), k, _ROUNDED if cosine else 0.0)
            best[a.number][1].take(a, b, cosine, but_itself)
        for ids, x in best.values():
            values = ids[x.i], x.id, x.y.tolist(), np.where(np.isneginf(x.score), np.nan, x.score)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=f.name == "score") for c, f in zip(values, arrow)], schema=arrow)

    return v.join(q).mapInArrow(run, out)  # blocks of rows meet, not rows


def pairs_within(rows: DataFrame, least: float) -> DataFrame:
    """All pairs a < b of rows (id, y, v) of different y with a cosine of `least` or more: (a, b, sim). Exact."""
    _small_batches(rows)
    one = packed(rows, ROWS, 2 * _parts(rows), "v_")
    two = one.select(*(F.col(c).alias(f"q_{c[2:]}") for c in one.columns))
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for a, b in _met(batches):
            s, off = _scores(a, b, True)
            i, j = np.nonzero(s >= _below(least - off, s)[:, None])
            told = (a.ids[i] != b.ids[j]) & (a.ys[i] != b.ys[j]) & np.array([x is not None for x in a.ys], bool)[i] & np.array([x is not None for x in b.ys], bool)[j]
            if a.number == b.number:
                told &= a.ids[i] < b.ids[j]
            i, j = i[told], j[told]
            sim = _cosines(a, b, i, j)
            far = sim >= least
            x, y, sim = a.ids[i][far], b.ids[j][far], sim[far]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(sim)], schema=arrow)

    met = two.join(one, F.col("q_block") <= F.col("v_block"))  # blocks of rows meet, not rows
    return met.mapInArrow(run, out)
