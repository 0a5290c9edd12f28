import random

import pytest

from driftwell.llm import common

from . import brute


@pytest.mark.parametrize("joined", [40, 1 << 20])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_against_plain_python(spark, monkeypatch, joined, kind):
    monkeypatch.setattr(common, "JOINED_EDGES", joined)
    rng = random.Random(joined)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(400 + i, 401 + i) for i in range(60)] + [(500, 501 + i) for i in range(200)] + [(7, 7), (399, 399)]
    rng.shuffle(edges)
    name = (lambda n: n) if kind == "long" else (lambda n: n.to_bytes(2, "big"))
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}").repartition(7)
    low = brute.joined(701, edges)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    got = [(r.node if kind == "long" else int.from_bytes(r.node, "big"), r.component if kind == "long" else int.from_bytes(r.component, "big")) for r in common.components(df).collect()]
    assert sorted(got) == sorted((n, low[n]) for n in nodes)
    assert common.components(df.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_columns_by_place(spark):
    df = spark.createDataFrame([(1, 2, 3, "t")], "a int, _row int, Score int, text string")
    rows = common.positional(df, ["score"], ["text"])
    out = rows.back(rows.frame.select(rows.row(), rows["A"].alias("score")), "score")
    assert out.columns == ["a", "_row", "score"] and tuple(out.first()) == (1, 2, 1)
    with pytest.raises(ValueError):
        rows.place("nothing")
    only = common.positional(df.select("text"), (), ["text"])
    assert only.back(only.frame.select(only.row())).columns == []
