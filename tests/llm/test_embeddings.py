import numpy as np

from driftwell.llm import embeddings, meetings

from .brute import joined


def brute(rows, cosine=0.95):
    rows = sorted(rows, key=lambda r: r[0])
    good = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, count = [], [0] * len(rows)
    for x in good:
        for y in good:
            if y < x and len(rows[x][1]) == len(rows[y][1]):
                a, b = np.array(rows[x][1], float), np.array(rows[y][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links.append((x, y))
                    count[x] += 1
                    count[y] += 1
    low = joined(len(rows), links)
    return [(d, count[i], rows[low[i]][0], rows[low[i]][0] == d) for i, (d, _) in enumerate(rows)]


def run(df):
    return sorted(map(tuple, embeddings.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()))


def test_transform_is_orthogonal():
    h = embeddings.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_recall_at_the_threshold():
    k, tables = embeddings.shape_of(64, 50_000, 0.95)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    h = embeddings.Hasher(64, k, tables)
    assert embeddings._meet(h(x), h(y)).any(axis=1).mean() >= 0.97


def test_clusters_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(meetings, "PART", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    vectors = [centres[rng.integers(12)] + rng.normal(size=32) * rng.choice([0.0, 0.02, 0.08]) for _ in range(350)]
    vectors += [rng.normal(size=32) for _ in range(150)]
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(500), vectors)]
    got, want = run(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.97 * len(want)


def test_table_against_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert run(df) == brute(rows)


def test_unfit_vectors_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (10, [1e300, 1e300]), (10, [1.0, -1.0]), (11, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, embedding array<double>, kept boolean")
    got = run(df)
    assert [g for g in got if g[0] < 7] == [(i, 0, i, True) for i in range(1, 7)]
    assert [g for g in got if g[0] in (7, 8, 9, 11)] == [(7, 3, 7, True), (8, 3, 7, False), (9, 0, 9, True), (11, 3, 7, False)]
    assert sorted(g[1:3] for g in got if g[0] == 10) == [(0, 10), (3, 7)]
    assert run(df.limit(0)) == []


def test_one_dense_cluster_sends_a_vector_about_once(spark, monkeypatch):
    """A cluster of distinct vectors that all link: links are those of all pairs, and rows grow with its members, not with its pairs."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=24)
    rows = [(i, [float(np.float32(x)) for x in centre + rng.normal(size=24) * 0.02]) for i in range(300)]
    sizes = {}
    monkeypatch.setattr(meetings, "stash", lambda df, tag, keep=meetings.stash: sizes.setdefault(tag, keep(df, tag)))
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows)
    assert sizes["partners"].count() <= 5 * 300


def test_a_threshold_out_of_reach_is_refused():
    import pytest

    with pytest.raises(ValueError):
        embeddings.shape_of(64, 10**6, 0.2)
    # signs of pairs at the threshold stay within the distance that rules pairs out
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    far = np.bitwise_count((embeddings.signs(x) ^ embeddings.signs(y)).view(np.uint64))
    assert far.max() <= embeddings.sign_distance(0.95)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 4, 5, 6), (2, [1.0, 0.1], 4, 5, 6)], "vec_id long, embedding array<double>, _v int, _KEY int, N_links int")
    out = embeddings.near_duplicates(df)
    assert out.columns == ["vec_id", "_v", "_KEY", "n_links", "component_id", "kept"] and sorted(r.n_links for r in out.collect()) == [1, 1]
