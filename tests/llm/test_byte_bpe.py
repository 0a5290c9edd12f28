import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken

from driftwell.llm.byte_bpe import decoded, encoded, tokenizer

VOCABULARY = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return tokenizer(VOCABULARY, P.PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids(bpe, text):
    data = bpe.encode(text)
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_merges_are_those_of_a_plain_scan(bpe):
    """Lowest rank first, leftmost of equal ranks, by scanning all pairs after each merge."""
    rng = random.Random(1)
    for _ in range(400):
        piece = bytes(rng.choice(b"abcthein 01aaaa") for _ in range(rng.randrange(1, 120)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [bpe.ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
            if min(ranks) == 1 << 40:
                break
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge(piece) == ([bpe.ranks[piece]] if piece in bpe.ranks else [bpe.ranks[x] for x in parts])


@pytest.mark.parametrize("text", ["", "a", "Hello world", "naïve café — 你好 🙂\n\n  x", "don't 12345 !!!??", "a" * 3000, " " * 500 + "x", "abc" * 2000, "<|endoftext|>"])
def test_same_as_the_library(bpe, reference, text):
    assert ids(bpe, text) == reference.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()


def test_random_texts(bpe, reference):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abe thin.ß\n 0é你") for _ in range(rng.randrange(200)))
        assert ids(bpe, text) == reference.encode_ordinary(text)


def test_whole_table_is_the_library_s_and_through_the_queue(spark, bpe, reference, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded(docs, VOCABULARY, P.PATTERN, keep_ids=False).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(got) == set(texts)
    merges = 0
    monkeypatch.setattr(bpe, "pops", 0)
    monkeypatch.setattr(bpe, "cache", {})
    for doc, text in texts.items():
        ids = reference.encode_ordinary(text)
        data = np.array(ids, "<u4").tobytes()
        assert got[doc] == (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert bpe.encode(text) == data
    # each merge of a pre-token that is no token is an entry of the queue
    for piece, packed in bpe.cache.items():
        data = piece.encode()
        if data not in bpe.ranks:
            merges += len(data) - len(packed) // 4
    assert 0 < merges <= bpe.pops


def test_frame_with_nulls_repeats_and_clashing_names(spark, bpe):
    rows = [(1, "the cat", 5), (2, None, None), (2, "", 7), (None, "the cat", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in encoded(docs, VOCABULARY, P.PATTERN).collect()}
    sha = lambda s: hashlib.sha256(s).hexdigest()
    assert got == {(1, 2, sha(b"the cat")), (2, 0, sha(b"")), (None, 2, sha(b"the cat"))}
    back = decoded(encoded(docs, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN)
    assert sorted(bytes(r.text) for r in back.collect()) == [b"", b"", b"the cat", b"the cat"]
    assert encoded(docs.limit(0), VOCABULARY, P.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, "the cat", 2, 3, 4)], "doc_id long, Text string, _text int, _ROW int, IDS int")
    assert encoded(odd, VOCABULARY, P.PATTERN, "Text").columns == ["doc_id", "_text", "_ROW", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
