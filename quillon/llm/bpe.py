"""BPE encoding and decoding over a pair occurrence index (operator 2).

The distinct words of a stretch of a partition lie in one symbol array with links to their neighbours. An index maps
each mergeable pair to all of its positions. Active ranks come off a heap in ascending order; applying one merges all of
its positions at once, and the lists of the pairs that appear beside them are extended. Words do not touch, so merging
by ascending rank over all words gives each word the merges it would get alone (load() refuses vocabularies whose merges
use a token before its own merge, where that would not hold).

Null and empty text encode to no ids. Special strings in a text are single ids. Undefined characters do not occur: all
bytes are symbols.
"""

from __future__ import annotations

import hashlib
import heapq
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.llm.bytelevel import Vocabulary, printable_bytes
from quillon.llm.common import map_text, table


#: Characters whose new words are encoded together: the more, the fewer merges are applied one after the other.
STRETCH_CHARS = 4_000_000


class PairIndex:
    """Merges of one vocabulary, applied to many words at once."""

    def __init__(self, vocab: Vocabulary):
        made_at = {c: r for r, (_, _, c) in enumerate(vocab.merges)}
        if len(made_at) < len(vocab.merges) or any(made_at.get(t, -1) >= r for r, (a, b, _) in enumerate(vocab.merges) for t in (a, b)):
            raise ValueError("merges are not in the order in which their tokens arise")
        ids = vocab.ids()
        self.inner = np.array([ids[c] for c in printable_bytes()], np.int64)
        self.final = np.array([ids[c + vocab.suffix] for c in printable_bytes()], np.int64)
        left, right, made = np.array(vocab.merges, np.int64).T
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.left, self.right, self.made = left, right, made

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        k = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words (none empty), and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        ends = np.cumsum(sizes) - 1
        sym = self.inner[data]
        sym[ends] = self.final[data[ends]]
        nxt = np.arange(1, n + 1)
        nxt[ends] = -1
        prv = np.arange(-1, n - 1)
        prv[ends - sizes + 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            """Positions of pairs by their left symbol; each list of the index gets its share."""
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.append(0, cut)].tolist(), np.split(at, cut) if len(cut) else [at]):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        at = np.flatnonzero(nxt >= 0)
        add(at, self.ranks(sym[at], sym[at + 1]))
        while heap:
            r = heapq.heappop(heap)
            a, b, c = self.left[r], self.right[r], self.made[r]
            lists = index.pop(r)
            pos = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            after = nxt[pos]
            ok = (sym[pos] == a) & (after >= 0)
            ok &= sym[after] == b
            pos, after = pos[ok], after[ok]
            if not len(pos):
                continue
            if a == b and len(pos) > 1:  # in a run of one symbol, every other position merges
                fresh = np.append(True, after[:-1] != pos[1:])
                run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                odd = (np.arange(len(pos)) - run) % 2 == 0
                pos, after = pos[odd], after[odd]
            sym[pos], sym[after] = c, -1
            beyond = nxt[after]
            nxt[pos] = beyond
            more = beyond >= 0
            prv[beyond[more]] = pos[more]
            before = prv[pos]
            before = before[before >= 0]
            at = np.concatenate([before, pos[more]])
            if len(at):
                add(at, self.ranks(sym[at], sym[nxt[at]]))
        alive = sym >= 0
        counts = np.add.reduceat(alive, ends - sizes + 1, dtype=np.int64) if n else sizes
        return sym[alive], counts


class Codec:
    """Encodes and decodes texts with one vocabulary file. Words seen before are looked up, in bounded memory."""

    def __init__(self, path: str, most_words: int = 120_000):
        self.vocab = Vocabulary.load(path)
        self.pairs = PairIndex(self.vocab)
        specials = sorted(self.vocab.specials, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        steps = self.vocab.config["normalizer"]["normalizers"]
        self.nfc, self.lower = ({"type": k} in steps for k in ("NFC", "Lowercase"))
        split = self.vocab.config["pre_tokenizer"]["pretokenizers"][0]
        # White space is never part of a word, so replacing it beforehand changes nothing.
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.most_words = most_words
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        # No word looks like these: a word has no letters beside signs.
        self.special_entries = {s: (1, str(i), s) for s, i in self.vocab.specials.items()}

    def split(self, text: str) -> list[str]:
        """The words of a text; special strings among them stay as they are."""
        if self.specials and self.specials.search(text):
            return [w for i, part in enumerate(self.specials.split(text)) for w in ([part] if i % 2 else self.split_plain(part))]
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: no final form of sigma
        return self.words.findall(text)

    def learn(self, words: list[str]) -> None:
        ids, counts = self.pairs.encode([w.encode("utf-8", "surrogatepass") for w in words])
        ids, at = ids.tolist(), 0
        for w, n in zip(words, counts.tolist()):
            own = ids[at : at + n]
            at += n
            self.known[w] = (n, " ".join(map(str, own)), self.decode(own))

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces: what a vocabulary file without a decoder means. Special tokens stay."""
        return " ".join(map(self.vocab.tokens.__getitem__, ids))

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        if len(self.known) > self.most_words:
            self.known, self.older = {}, self.known
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.known)
        fresh = []
        for w in new:
            if w in self.special_entries:
                self.known[w] = self.special_entries[w]
            elif w in self.older:
                self.known[w] = self.older[w]
            else:
                fresh.append(w)
        if fresh:
            fresh.sort()
            self.learn(fresh)
        return split

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for w in words for i in self.known[w][1].split()] for words in self.prepare(texts)]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_documents(docs: DataFrame, tokenizer_path: str, *, outputs: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_tokens, and of `outputs` ids (array), decoded (string), ids_sha256 and decoded_sha256.

    Null text counts as empty: no tokens, digests of the empty string. Rows keep their number and multiplicity, and
    columns other than the id and the text are not read, whatever their names.
    """
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    fields = [T.StructField("n_tokens", T.LongType()), *(T.StructField(o, kinds[o]) for o in outputs)]

    def make():
        codec = Codec(tokenizer_path)

        def f(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], **{o: [] for o in outputs}}
            for words in codec.prepare(texts):
                known = [codec.known[w] for w in words]
                out["n_tokens"].append(sum([k[0] for k in known]))
                if "ids" in out or "ids_sha256" in out:
                    ids = " ".join([k[1] for k in known])
                    if "ids" in out:
                        out["ids"].append([int(x) for x in ids.split()])
                    if "ids_sha256" in out:
                        out["ids_sha256"].append(_sha256(ids))
                if "decoded" in out or "decoded_sha256" in out:
                    decoded = " ".join([k[2] for k in known])
                    if "decoded" in out:
                        out["decoded"].append(decoded)
                    if "decoded_sha256" in out:
                        out["decoded_sha256"].append(_sha256(decoded))
            return out

        return f

    return map_text(docs, T.StructType(fields), make, text_col=text_col, keep=(id_col,), chunk=STRETCH_CHARS)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), outputs=("ids_sha256", "decoded_sha256"))
