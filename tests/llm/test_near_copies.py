import random

import numpy as np

import corpus_pipeline
from driftwell.llm import meetings, near_copies
from driftwell.llm.common import stash
from pyspark.sql import functions as F

from . import brute


def shingles(text, k=5):
    w = brute.words((text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def expected(rows):
    """The rows (id, text) that stay, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    best = {}
    for i, top in enumerate(brute.joined(len(rows), links)):
        best[top] = min(best.get(top, (True, 0, len(rows))), (rows[i][0] is None, rows[i][0] or 0, i))
    return sorted((rows[i] for _, _, i in best.values()), key=str)


def edited(rng, words, most):
    words = list(words)
    for _ in range(rng.randrange(most)):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_stage_against_all_pairs(spark):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(500)
    made = []
    for d in range(100_000, 100_040):  # near copies on both sides of 4/5
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 200))]
        made += [(d * 10 + k, " ".join(edited(rng, words, 2 + len(words) // 25)), "en", "s", 0) for k in range(3)]
    docs = stash(docs.union(spark.createDataFrame(made, docs.schema)), "docs")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows)
    assert len(want) < len({near_copies.set_key(near_copies.shingle_set((t or "").encode())) for _, t in rows}) - 10
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want


def test_group_larger_than_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", 0)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(edited(rng, base, 6))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_copies.keep_first(docs).collect()), key=str) == expected(rows)


def test_pairs_of_a_meeting():
    rng = np.random.default_rng(5)
    for m in (2, 8, 9, 60):
        keys, sizes = rng.permutation(m).astype(np.int64), rng.integers(30, 45, m)
        base = rng.integers(0, 1 << 63, dtype=np.uint64)
        fps = np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 20), replace=False))) for _ in range(m)], np.uint64)
        classes = rng.integers(0, 3, m)
        far = np.bitwise_count(fps[:, None] ^ fps)
        may = (5 * np.minimum.outer(sizes, sizes) >= 4 * np.maximum.outer(sizes, sizes)) & ((far <= near_copies.DISTANCE) | (np.minimum.outer(sizes, sizes) < near_copies.SHORT))
        want = {(keys[i], keys[j]) for i in range(m) for j in range(m) if keys[i] < keys[j] and may[i, j]}
        a, b, whole = near_copies.nearest(keys, sizes, fps)
        got = set(zip(np.concatenate(a).tolist(), np.concatenate(b).tolist()))
        assert got <= want and whole == (m <= near_copies.SMALL) and (got == want or not whole and len(got) < m)
        of = dict(zip(keys.tolist(), classes.tolist()))
        here, other = 1, 2
        shared = rng.random(m) < 0.5  # these meet in a more frequented place too
        met = [[other, here] if both else [here] for both in shared]
        twice = {k for k, both in zip(keys.tolist(), shared) if both}
        lists = list(meetings.across(keys, classes, [sizes, fps.view(np.int64)], near_copies.may_meet, met.__getitem__, 1, part=7))
        assert {(a, b) for _, _, own, partners in lists for a, p in zip(own, partners) for b in p} == {(x, y) for x, y in want if of[x] != of[y] and not {x, y} <= twice}


def test_links_connect_what_all_pairs_connect():
    rng = random.Random(5)
    for _ in range(60):
        base = rng.sample(range(400), 60)
        sets = [np.array(sorted({*rng.sample(base, rng.randrange(44, 60)), *rng.sample(range(400, 900), rng.randrange(8))}), np.uint64) for _ in range(rng.randrange(2, 40))]
        n = len(sets)
        links = [(i, j) for i in range(n) for j in range(i) if near_copies.similar(sets[i], sets[j])]
        found = list(near_copies.links_of(list(range(n)), sets, [list(range(i + 1, n)) for i in range(n)]))
        assert brute.joined(n, found) == brute.joined(n, links) and len(found) < n


def test_runs_are_whole():
    import pyarrow as pa

    x = np.sort(np.random.default_rng(2).integers(0, 30, 500))
    for size in (1, 7, 100, 500):
        batches = (pa.RecordBatch.from_arrays([pa.array(x[i : i + size]), pa.array(np.arange(500)[i : i + size])], names=["x", "n"]) for i in range(0, 500, size))
        found = [(int(v[a]), n[a:b].tolist()) for edges, (v, n) in meetings.whole_runs(batches) for a, b in zip(edges[:-1], edges[1:])]
        assert found == [(int(v), np.flatnonzero(x == v).tolist()) for v in np.unique(x)]


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6, 7), (2, "A B C", 5, 6, 8)], "doc_id long, text string, _row int, _AT int, c0 int")
    out = near_copies.keep_first(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a b c", 5, 6, 7)]


def test_nulls_blanks_repeats_and_ids(spark):
    rows = [(None, "one text that stands here alone"), (None, "quite another text of other words"), (7, "some words of the first kind"), (7, "a different text with the same id"), (1, None), (2, " \n"), (3, "Same TEXT"), (4, "same text"), (4, "same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_copies.keep_first(docs).collect()), key=str) == expected(rows)
    assert near_copies.keep_first(docs.limit(0)).count() == 0


def pairs_within(fps, bits):
    return {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= bits}


def test_blocks_bring_together_all_within_their_radius(spark):
    assert [near_copies.blocks_for(n) for n in (0, 1 << 20, 1 << 21, 1 << 24, 1 << 40)] == [12, 12, 10, 9, 4]
    rng = random.Random(6)
    fps = []
    for _ in range(60):  # around each, fingerprints at every distance up to 20 bits
        base = rng.getrandbits(64)
        fps += [base, *(base ^ sum(1 << b for b in rng.sample(range(64), far)) for far in range(1, 21))]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    sets = stash(spark.createDataFrame([(k, 100, f) for k, f in enumerate(signed)], "key long, n int, fp long"), "sets")
    for blocks in (4, 6, 9, 12):
        got = {tuple(r) for r in near_copies.near_by_blocks(sets, blocks).collect()}
        assert pairs_within(fps, blocks - 2) <= got <= pairs_within(fps, near_copies.NEAR)


def test_crowded_bucket_hangs_together():
    rng = np.random.default_rng(7)
    base, m = rng.integers(0, 1 << 63, dtype=np.uint64), near_copies.BLOCK + 300
    fps = np.array([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, m)], np.uint64)
    a, b = map(np.concatenate, near_copies.near_in_bucket(np.arange(m), np.full(m, 100), fps))
    assert len(a) <= m and (a < b).all() and set(brute.joined(m, list(zip(a.tolist(), b.tolist())))) == {0}


def test_fingerprints_alone_find_near_copies(spark, monkeypatch):
    """Without the meetings in shingles the pairs that their fingerprints bring together are still found, and only similar ones are linked."""
    monkeypatch.setattr(near_copies, "prefix", lambda hashes, known, counts: hashes[:0])
    rng = random.Random(8)
    rows = []
    for d in range(0, 400, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        rows += [(d, " ".join(words)), (d + 1, " ".join(edited(rng, words, 8)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.keep_first(docs).collect()}
    hashes = [near_copies.shingle_set(t.encode()) for _, t in rows]
    fps = [near_copies.set_fingerprint(h) & (1 << 64) - 1 for h in hashes]
    for d in range(0, 400, 2):
        far = (fps[d] ^ fps[d + 1]).bit_count()
        alike = near_copies.similar(hashes[d], hashes[d + 1])
        assert d in kept and (d + 1 in kept or alike)
        assert not alike or far > near_copies.MOST_BLOCKS - 2 or d + 1 not in kept
    assert len(kept) < 300


def test_pairs_of_a_large_group_grow_with_its_members(spark):
    """A family of near fingerprints: nearly all of its pairs meet in some bucket, but only some for each member are rows."""
    rng = np.random.default_rng(9)
    per_member = []
    for m in (100, 400):
        fps = rng.integers(0, 1 << 63, dtype=np.uint64) ^ np.array([sum(1 << int(b) for b in rng.choice(63, 5, replace=False)) for _ in range(m)], np.uint64)
        sets = stash(spark.createDataFrame([(k, 100, f) for k, f in enumerate(fps.view(np.int64).tolist())], "key long, n int, fp long"), "sets")
        got = [tuple(r) for r in near_copies.near_by_blocks(sets, 12).collect()]
        assert len(set(got)) == len(got) and set(got) <= pairs_within(fps.tolist(), near_copies.NEAR)
        assert set(brute.joined(m, got)) == {0}
        per_member.append(len(got) / m)
    assert max(per_member) <= near_copies.SMALL


def test_sieve_keeps_what_is_asked(spark, monkeypatch):
    rows = stash(spark.range(50_000).select((F.col("id") * 7 + (F.col("id") % 5) * (1 << 33)).alias("_at"), F.lit("t").alias("text")), "rows")
    asked = stash(rows.filter("_at % 11 = 0").select("_at"), "asked")
    want = {r[0] for r in asked.collect()}
    for most, others in ((1 << 25, 0.1), (1 << 15, 1)):  # a sieve too small lets others through, and loses none
        monkeypatch.setattr(near_copies, "MOST_SIEVE", most)
        out = near_copies.sifted(rows, asked)
        got = [r[0] for r in out.collect()]
        assert out.columns == rows.columns and len(set(got)) == len(got) and want <= set(got)
        assert len(got) - len(want) <= others * (50_000 - len(want))
    assert near_copies.sifted(rows, asked.limit(0)).count() == 0


def test_only_sifted_rows_are_shuffled(spark):
    rows = stash(spark.range(1000).select(F.col("id").alias("_at"), F.lit("t").alias("text")), "rows")
    asked = stash(rows.filter("_at % 11 = 0").select("_at"), "asked")
    out = near_copies.picked(rows, asked)
    assert {r[0] for r in out.collect()} == {r[0] for r in asked.collect()} and out.columns == rows.columns
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")  # the sieve stands below the join that shuffles
