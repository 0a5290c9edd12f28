import re
from collections import Counter

import corpus_pipeline
import pytest
from driftwell.llm import packing, pii, quality_rules

from . import brute, test_near_copies, test_pii

SF = "/root/testdata/sf0.001"


def quality(text):
    w = brute.words(text)
    n = len(w)
    windows = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    repeated = {i + k for i in range(n - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    if n < 10 or 100 * len(repeated) > 20 * n:
        return False
    lines = [x for x in text.split("\n") if brute.words(x)]
    stop = {x for s in quality_rules.STOP_WORDS for x in (s, s.capitalize())}
    measures = {
        "word_chars": sum(map(len, w)), "n_words": n, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_stop_words": sum(x in stop for x in w),
        "n_bullet_lines": sum(x.lstrip(" ")[:1] in ("-", "*", "•", "|") and bool(x.lstrip(" ")) for x in lines),
    }
    for _, rule, low, high in quality_rules.RULES:
        x = eval(rule, {}, measures)
        if low is not None and x < low or high is not None and x > high:
            return False
    return True


def expected(rows):
    rows = [r for r in rows if r[1] is not None and quality(r[1])]
    rows = test_near_copies.expected(rows)
    out = {}
    first = {}
    for d, t in sorted(rows):
        w = brute.words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, t in rows:
        w, gone = brute.words(t), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        if len(gone) < len(w):
            out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    return out


@pytest.fixture
def key(spark):
    spark.conf.set(pii.KEY_SETTING, test_pii.KEY)
    yield
    spark.conf.unset(pii.KEY_SETTING)


def test_stages_against_plain_python(spark, key):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, SF)
        assert done.columns == docs.columns and done.dtypes == docs.dtypes
        docs = done
    want = {d: test_pii.expected(t)[0] for d, t in expected(rows).items()}
    got = {r.doc_id: r for r in docs.collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    pieces = corpus_pipeline.run(spark, SF).collect()
    words = Counter()
    for r in pieces:
        words[r.doc_id] += r.n_words
    assert words == Counter({d: len(brute.words(t)) for d, t in want.items()})
    assert max(Counter((r.shard, r.bin, r.source) for r in pieces).values()) == 1
    room = Counter()
    for r in pieces:
        room[r.shard, r.bin] += r.n_words
    assert max(room.values()) <= packing.CAPACITY


def test_empty_documents_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() <= 3
