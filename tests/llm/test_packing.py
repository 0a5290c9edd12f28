import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from driftwell.llm import packing

from . import brute
from .brute import words


def test_every_choice_is_the_tightest_compatible_bin():
    rng = random.Random(1)
    for capacity in (20, 100):
        for _ in range(60):
            k = rng.randrange(1, 120)
            sizes = sorted((rng.randrange(0, capacity) for _ in range(k)), reverse=rng.random() < 0.7)
            sources = [rng.choice([None, 0, 0, 1, 2, 3]) for _ in range(k)]
            clusters = [rng.choice([None, *range(8)]) for _ in range(k)]
            got = packing.pack_shard(sizes, sources, clusters, capacity)
            room, src, clu = [], [], []
            for n, s, c, b in zip(sizes, sources, clusters, got):
                fits = [i for i in range(len(room)) if room[i] >= n and (s is None or s not in src[i]) and (c is None or c not in clu[i])]
                if not fits:
                    assert b == len(room)
                    room.append(capacity), src.append(set()), clu.append(set())
                else:
                    assert b in fits and room[b] == min(room[i] for i in fits)
                room[b] -= n
                src[b].add(s), clu[b].add(c)


def test_documents_keep_the_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.packed(docs, capacity=300, shard_pieces=200).collect()
    cluster = {d: c for d, _, c in brute.simhash([(r.doc_id, r.text) for r in docs.collect()])}
    text = {r.doc_id: r.text for r in docs.collect()}
    bins, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.shard, r.bin].append(r)
        spans[r.doc_id].append((r.first_word, r.n_words))
    assert set(spans) == set(text)
    for d, s in spans.items():
        s.sort()
        assert sum(n for _, n in s) == len(words(text[d])) and all(a + n == b for (a, n), (b, _) in zip(s, s[1:]))
    for members in bins.values():
        assert sum(r.n_words for r in members) <= 300
        assert len({r.source for r in members}) == len(members) == len({cluster[r.doc_id] for r in members})
    assert sum(len(m) for m in bins.values()) > len(bins)


def test_nulls_blanks_repeats_and_extra_columns(spark):
    rows = [(1, None, "a", 1), (2, "", None, 2), (3, " \n", None, 3), (4, "x y z", "a", 4), (4, "x y z", "b", 4), (None, "p q " * 5, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int")
    out = packing.packed(docs, capacity=4).collect()
    assert len(out) == 8 and sum(r.n_words for r in out) == 16
    twins = [(r.shard, r.bin) for r in out if r.doc_id == 4]
    assert len(set(twins)) == 2
    assert packing.packed(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 100001, "s")], "doc_id long, text string, source string")
    assert packing.packed(docs, capacity=1000).agg(F.sum("n_words"), F.count("*")).first() == (100001, 101)


def test_no_bin_takes_more_than_it_holds(spark):
    long = "w " * 5000
    rows = [(1, long, "a"), (1, long, "a"), (1, long, None), (None, long, "b"), (None, long, "b"), (2, "x " * 2500, None), (3, "x " * 2500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for clusters in (None, "source"):
        bins, members = defaultdict(int), defaultdict(list)
        for r in packing.packed(docs, cluster_col=clusters, capacity=1000).collect():
            bins[r.shard, r.bin] += r.n_words
            members[r.shard, r.bin].append(r)
        assert max(bins.values()) <= 1000 and sum(bins.values()) == 30000
        assert all(len(m) == 1 for m in members.values() if sum(x.n_words for x in m) == 1000 and m[0].n_words == 1000)


def test_repeated_rows_spread_over_shards(spark):
    docs = spark.createDataFrame([(None, "", "s")] * 400 + [(7, "same text", None)] * 400, "doc_id long, text string, source string")
    sizes = Counter(r.shard for r in packing.packed(docs, shard_pieces=100).collect())
    assert len(sizes) == 8 and max(sizes.values()) < 200


def test_other_columns_and_ids(spark):
    rows = [("b", "x y", "s", 1, 2), ("a", "x z", "t", 3, 4), (None, "q", "s", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, _n int, _CLASS int")
    out = packing.packed(docs).collect()
    assert sorted((r.doc_id or "", r.n_words) for r in out) == [("", 1), ("a", 2), ("b", 2)]
