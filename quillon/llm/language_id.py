"""Language identification with error-correcting output codes (operator 10).

Every language has a codeword; for each of its bits one binary classifier over hashed letter n-grams tells the languages
with a 1 from those with a 0. A document's bits are decoded by loss: the codeword with the least weighted logistic loss
against the classifiers' margins wins, weights being the classifiers' accuracies. A document whose two best codewords
are nearly as good is flagged as ambiguous. Codes are exhaustive up to seven languages, otherwise drawn at random.

Fitting reads a sample of the labelled rows: about `per_language` of each language, chosen by a hash of the id. Only
n-gram counts by language and sums by bit come to the driver (at most languages * `FEATURES` numbers).

Null texts and texts without a letter are `und` with score 0. Without labelled rows every text is `und`. Of languages
whose codewords have the same loss the first in alphabetical order wins, and the document is ambiguous. Repeated rows are
judged, and learned from, one by one; an empty table gives no rows; columns other than id, text and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import doc_bucket, map_text, materialize, small_batches, table, text_chunks

FEATURES = 1 << 15
PER_LANGUAGE = 400
UNDETERMINED = "und"
#: A lead of the best codeword's loss below this is ambiguous.
AMBIGUOUS = 0.02
_STEP = 400_000


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    every = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    for m in regex.finditer(r"\p{L}+", every):
        out[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = True
    out[0xD800:0xE000] = False
    return out


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of n-grams: the text that each is from, and its feature. No n-gram joins two texts."""
    texts = [t.lower() for t in texts]
    points = np.frombuffer(("  ".join(texts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[points]
    points = np.where(letter, points, 32).astype(np.uint64)
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 15)
    for a in range(0, len(points) - 2, _STEP):
        b = min(a + _STEP, len(points) - 2)
        x, y, z = points[a:b], points[a + 1 : b + 1], points[a + 2 : b + 2]
        own = np.searchsorted(ends, np.arange(a, b), side="right")
        with np.errstate(over="ignore"):
            one = x + np.uint64(1 << 60)
            two = (x << np.uint64(21)) + y + np.uint64(2 << 60)
            three = (((x << np.uint64(21)) + y) << np.uint64(21)) + z
            h = [(v * mix ^ (v >> np.uint64(29))) * mix >> shift for v in (one, two, three)]
        here = letter[a:b] & (np.arange(a, b) < ends[own] - 2)
        near = (letter[a:b] | letter[a + 1 : b + 1]) & (np.arange(a, b) < ends[own] - 2)
        own3 = np.concatenate([own[here], own[near], own[near]])
        yield own3, np.concatenate([h[0][here], h[1][near], h[2][near]]).astype(np.int64)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1, no two equal."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = [[(c >> i) & 1 for i in range(n)] for c in range(1, 1 << (n - 1))]
        return np.where(np.array(bits).T > 0, 1.0, -1.0)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, 10 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    scale: np.ndarray  # of the margins, by bit
    trust: np.ndarray  # in the bit's classifier

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for own, feature in features(texts):
            counts += np.bincount(own, minlength=len(texts))
            by = np.argsort(own, kind="stable")
            own, feature = own[by], feature[by]
            if len(own):
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                sums[own[first]] += np.add.reduceat(self.weights[feature], first, axis=0)
        return sums / np.maximum(counts, 1)[:, None], counts

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
        margins, counts = self.margins(texts)
        z = (margins / self.scale)[:, None, :] * self.code[None, :, :]
        loss = (np.logaddexp(0, -2 * z) * self.trust).sum(axis=2) / self.trust.sum()
        best = loss.argmin(axis=1)
        ordered = np.sort(loss, axis=1)
        lead = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(texts), 1.0)
        p = np.exp(-8 * (loss - ordered[:, :1]))
        score = 1 / p.sum(axis=1)
        known = counts > 0
        return (
            [self.languages[i] if k else UNDETERMINED for i, k in zip(best.tolist(), known.tolist())],
            np.where(known, score, 0.0).tolist(),
            (known & (lead < AMBIGUOUS)).tolist(),
        )


def fit(rows: DataFrame, *, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from labelled rows. Reads about per_language texts of each language; null labels and texts are left out."""
    rows = rows.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("l is not null and t is not null")
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((FEATURES, 1)), np.ones(1), np.ones(1))
    chance = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))))
    drawn = (F.pmod(F.xxhash64("i", F.lit("language-id")), F.lit(1_000_000)) / 1_000_000) < F.element_at(chance, F.col("l"))
    sample = materialize(rows.where(drawn).select("l", "t"), "language-sample")  # written once, read twice
    code = codewords(len(languages))
    index = {k: i for i, k in enumerate(languages)}

    small_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), FEATURES), np.int64)
        for batch in batches:
            for part, texts in text_chunks(batch, "t"):
                langs = np.array([index[x] for x in part.column(0).to_pylist()])
                for own, feature in features(texts):
                    np.add.at(total, (langs[own], feature), 1)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], names=["l", "f", "n"])

    total = np.zeros((len(languages), FEATURES))
    for r in sample.mapInArrow(count, "l int, f int, n bigint").groupBy("l", "f").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        total[r["l"], r["f"]] = r["n"]
    p = (total + 0.5) / (total.sum(axis=1, keepdims=True) + 0.5 * FEATURES)
    positive, negative = (code > 0).astype(float), (code < 0).astype(float)
    mean = lambda side: (p.T @ side) / np.maximum(side.sum(axis=0), 1)
    weights = np.log(mean(positive) + 1e-12) - np.log(mean(negative) + 1e-12) if len(languages) > 1 else np.zeros((FEATURES, 1))
    model = Model(languages, code, weights.astype(np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch, "t"):
                langs = np.array([index[x] for x in part.column(0).to_pylist()])
                margins, counts = model.margins(texts)
                m = margins[counts > 0]
                right = (m * code[langs[counts > 0]] > 0).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([m.shape[0]]), pa.array([right.astype(float).tolist()]), pa.array([np.abs(m).sum(axis=0).tolist()])], names=["n", "r", "s"])

    bits = range(code.shape[1])
    sums = sample.mapInArrow(judge, "n bigint, r array<double>, s array<double>").agg(F.sum("n").alias("n"), *(F.sum(F.col(c)[b]).alias(f"{c}{b}") for c in "rs" for b in bits)).first()
    if sums.n and len(languages) > 1:
        model.trust = np.maximum(np.array([sums[f"r{b}"] for b in bits]) / sums.n - 0.5, 1e-3)
        model.scale = np.maximum(np.array([sums[f"s{b}"] for b in bits]) / sums.n, 1e-6)
    return model


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1), ambiguous. Rows keep their number; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers a bit

    def make():
        def f(texts: list[str]) -> dict[str, list]:
            lang, score, unsure = sent.value.predict(texts)
            return {"lang_pred": lang, "score": score, "ambiguous": unsure}

        return f

    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return map_text(docs, schema, make, text_col=text_col, keep=(id_col,))


def held_out(id_col: str = "doc_id") -> Column:
    return doc_bucket(id_col, 5) == 0


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
