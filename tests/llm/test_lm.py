import math
import random
import zlib
from collections import Counter

import numpy as np

from driftwell.llm import common, lm

from .brute import words


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, order=3):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    tokens = [[*words(lower(t)), None] for _, t in rows]
    c = Counter()
    for w, h in zip(tokens, held):
        for i in range(len(w) if not h else 0):
            for k in range(1, order + 1):
                c[tuple(["<"] * max(0, k - 1 - i) + w[max(0, i + 1 - k) : i + 1])] += 1
    for k in range(1, order):
        c[("<",) * k] = sum(not h for h in held)
    n, v = sum(t for g, t in c.items() if len(g) == 1 and g != ("<",)), sum(len(g) == 1 and g != ("<",) for g in c)
    c[()] = n

    def parts(w, i, weights, deleted):
        """(bucket, own estimate, probability by the lower orders) of the order above those with weights."""
        p = 1.0 / (v + 1)
        for k in range(1, order + 1):
            gram = tuple(["<"] * max(0, k - 1 - i) + w[max(0, i + 1 - k) : i + 1])
            seen = max(c[gram[:-1]] - deleted, 0)
            own, bucket = max(c[gram] - deleted, 0) / max(seen, 1), int(lm.context_bucket(np.array([seen]))[0])
            if k > len(weights):
                return bucket, own, p
            p = weights[k - 1][bucket] * own + (1 - weights[k - 1][bucket]) * p
        return bucket, own, p

    weights = []
    for _ in range(order):
        cells = {}
        for w, h in zip(tokens, held):
            for i in range(len(w) if not h else 0):
                bucket, own, p = parts(w, i, weights, 1)
                cell = cells.setdefault((bucket, int(lm._cells(np.array([own]))[0]), int(lm._cells(np.array([p]))[0])), [0, 0.0, 0.0])
                cell[0] += 1
                cell[1] += own
                cell[2] += p
        times = np.array([x[0] for x in cells.values()], float)
        weights.append(lm.learn(np.array([b for b, _, _ in cells], np.int64), np.array([x[1] for x in cells.values()]) / times, np.array([x[2] for x in cells.values()]) / times, times))
    out = []
    for (d, _), h, w in zip(rows, held, tokens):
        score = sum(math.log10(parts(w, i, weights, 0)[2]) for i in range(len(w)))
        out.append((d, h, len(w), sum(c[x,] > 0 for x in w), n, sum(math.log10((c[x,] + 1) / (n + v + 1)) for x in w), score))
    return out


def run(docs):
    out = lm.scored(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return sorted(map(tuple, out.collect()), key=lambda r: str(r[:4]))


def same(got, want):
    want = sorted(want, key=lambda r: str(r[:4]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_documents_against_plain_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = run(docs)
    same(got, brute([tuple(r) for r in docs.collect()]))
    out = [r for r in got if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out)  # beats add-one words on held-out text


def test_weights_are_the_best_of_a_grid():
    """EM ends where no other weight of a bucket makes the held-out counts likelier."""
    rng = np.random.default_rng(3)
    own, lower, times = rng.random(200) * (rng.random(200) < 0.6), rng.random(200) * 0.1 + 1e-4, rng.integers(1, 50, 200).astype(float)
    w = lm.learn(np.full(200, 5), own, lower, times)
    likely = lambda x: float((times * np.log(x * own + (1 - x) * lower)).sum())
    assert likely(w[5]) >= max(likely(x) for x in np.linspace(0.001, 0.999, 500)) - 1e-3 and w[0] == 0 and (w < 1).all()


def test_orders_and_levels(spark, monkeypatch):
    monkeypatch.setattr(common.pack, "__defaults__", ("text", 300))
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(40)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for order, bits in ((1, 1), (2, 2), (3, 1), (4, 8)):
        out = lm.scored(docs, order=order, fan_bits=bits).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        same(sorted(map(tuple, out.collect()), key=lambda r: str(r[:4])), brute(rows, order))


def test_very_long_text_and_clashing_names(spark):
    rows = [(1, "a b c " * 40_000), (2, "c b a")]
    same(run(spark.createDataFrame(rows, "doc_id long, text string")), brute(rows))
    odd = spark.createDataFrame([(1, "a b", 2, 3, 4)], "doc_id long, text string, id int, _ROW int, N int")
    assert lm.scored(odd).columns == ["doc_id", "id", "_ROW", "N", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_nulls_blanks_repeats_and_extra_columns(spark):
    rows = [(1, "The cat THE cat"), (1, "The cat THE cat"), (2, None), (3, ""), (None, "the dog"), (12, "Ünseen cat")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, score int")
    same(run(docs), brute(rows))
    assert run(docs.limit(0)) == []
    held = [d for d in range(40) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    got = run(spark.createDataFrame([(d, "only held out") for d in held], "doc_id long, text string"))
    assert [r[2:5] for r in got] == [(4, 0, 0)] * 2 and all(r[6] == 0 for r in got)
