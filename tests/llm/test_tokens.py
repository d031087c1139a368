"""Operators 2 and 7 against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm.bpe import Codec, encode_documents, op2_bpe
from quillon.llm.common import table
from quillon.llm.token_count import TokenCounter, op7_token_counts, token_counts

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = ["'s", "'re", "ll", "ve", "r", "t", " ", "  ", "\n", "\t", "\xa0", "a", "B", "1", "²", "é", "É", "İ", "Σ", "漢", "!", "'!", "\x85", "\x1c", "​", "😀", "<|endoftext|>", "<|startoftext|>", "the", "aaa", "́", "Ⅳ", "\x00", "ﬁ"]
ODD = ["", "a" * 3000, " " * 500 + "x", "'" * 50, "x'r", "l'", "\0", "ab" * 20000]


def texts() -> list[str]:
    r = random.Random(3)
    return ["".join(r.choices(PIECES, k=r.randint(0, 40))) for _ in range(3000)] + ODD


def test_counts():
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(texts(), add_special_tokens=False)]
    assert TokenCounter(BYTE).counts(texts()) == want


def test_counts_with_small_memory():
    c = TokenCounter(BYTE, most_pieces=3)
    c.counter.most_states = 50
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(texts()[:300], add_special_tokens=False)]
    assert [c.counts([t])[0] for t in texts()[:300]] == want


def test_codec():
    lib, own = Tokenizer.from_file(WORD), Codec(WORD, most_words=10)
    want = [e.ids for e in lib.encode_batch(texts(), add_special_tokens=False)]
    assert own.encode(texts()) == want
    assert [own.decode(i) for i in want] == [lib.decode(i, skip_special_tokens=False) for i in want]


def test_merge_order_is_checked():
    from quillon.llm.bpe import PairIndex
    from quillon.llm.bytelevel import Vocabulary

    v = Vocabulary.load(WORD)
    v.merges = v.merges[::-1]
    with pytest.raises(ValueError):
        PairIndex(v)


def test_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "a b", "z")], "doc_id long, text string, n_tokens string")
    n = token_counts(rows, BYTE).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in n) == [(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 3, 2, False)]
    e = encode_documents(rows, WORD).collect()
    assert sorted((r.doc_id, r.n_tokens, len(r.ids)) for r in e) == [(1, 0, 0), (2, 0, 0), (2, 0, 0), (3, 2, 2)]
    none = rows.selectExpr("cast(null as long) as doc_id", "text", "'x' as ids", "1 as n_bytes")  # null ids, clashing names
    assert sorted(r.n_tokens for r in token_counts(none, BYTE).collect()) == [0, 0, 0, 2] == sorted(len(r.ids) for r in encode_documents(none, WORD).collect())
    assert token_counts(rows.limit(0), BYTE).count() == 0 == encode_documents(rows.limit(0), WORD).count()


def test_queries(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for r in op7_token_counts(spark, sf_dir).collect():
        assert (r.n_bytes, r.n_tokens) == (len(docs[r.doc_id].encode()), len(byte.encode(docs[r.doc_id], add_special_tokens=False).ids))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in op2_bpe(spark, sf_dir).collect():
        ids = word.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False)))
