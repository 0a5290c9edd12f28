import random

import pytest
from pyspark.sql import functions as F

from driftwell.llm import simhash

from .brute import simhash as brute


def run(docs):
    out = simhash.near_duplicates(docs)
    return [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in out.collect()]


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = run(docs)
    assert len(got) == len(set(got)) and set(got) == brute([tuple(r) for r in docs.collect()])


def test_large_ball_of_fingerprints(spark):
    rng, fps = random.Random(5), {0}
    while len(fps) < 1500:  # a dense ball around 0, far more than GROUP in a block, and chains
        f = 0
        for _ in range(rng.randrange(1, 6)):
            f |= 1 << rng.randrange(64)
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    ordered = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    top = {f: f for f in ordered}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    want = {f: find(f) for f in ordered}
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    got = {r.fp: r["class"] for r in simhash.link_classes(spark.createDataFrame([(f,) for f in ordered], "fp long")).collect()}
    assert got == {f: c for f, c in want.items() if sizes[c] > 1}


def test_nulls_blanks_repeats_and_extra_columns(spark):
    rows = [(3, None, 1, 9), (1, "", 2, 9), (2, " \n", 3, 9), (4, "one two", 4, 9), (4, "one two", 4, 9), (5, "ONE two", 5, 9), (None, "alone it stands here", 6, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id int")
    got = sorted(run(docs), key=str)
    assert [(d, c) for d, _, c in got] == [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (None, None)]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4]
    assert run(docs.limit(0)) == [] and simhash.keep_first(docs.limit(0)).count() == 0


def test_first_of_unlike_documents_without_or_with_one_id(spark):
    rows = [(None, "one text that stands here alone"), (None, "quite another text of other words"), (7, "some words of the first kind"), (7, "a different text with the same id"), (7, "a different text with the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in simhash.keep_first(docs).collect()), key=str) == sorted(rows[:4], key=str)


def test_very_long_text():
    text = "a b c d e f g " * 40000
    assert simhash.fingerprint(text.encode()) == simhash.fingerprint((text + " ").encode())
