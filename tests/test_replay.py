"""Changes that no merge covers, against a row-by-row replay in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from driftwell.meta import TableMeta, table_meta
from driftwell.operators import apply, changes, check, merge
from driftwell.plans.task import TaskSpec
from driftwell.streaming.tables import ChangeTable

COLUMNS = "k long, u long, v string"
IMAGE = "struct<k:long,u:long,v:string>"
CHANGE = f"op string, seq long, before {IMAGE}, after {IMAGE}, unchanged array<string>"
KEYED = TableMeta("s", "t", ("k", "u", "v"), ("k",))
BAG = TableMeta("s", "t", ("k", "u", "v"))
NULLABLE = TableMeta("s", "t", ("k", "u", "v"), unique=(("k",),), nullable=frozenset("kuv"))
UNIQUE = TableMeta("s", "t", ("k", "u", "v"), ("k",), (("u",),), frozenset("uv"))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frames(spark, rows, items):
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(items, CHANGE)


def merged(old, new, unsent):
    """``new`` with the columns in ``unsent`` from ``old``."""
    return tuple(o if c in (unsent or ()) else n for c, o, n in zip("kuv", old, new))


def replayed(rows, items, meta):
    """Upserts: the contract of ``apply_changes``, a row at a time."""
    rows = list(rows)
    for op, _, before, after, unsent in sorted(items, key=lambda x: x[1]):
        if meta.is_bag:
            if op != "insert" and before in rows:
                rows.remove(before)
            if op != "delete":
                rows.append(merged(before, after, unsent) if op == "update" else after)
            continue
        key = (before if op == "delete" else after)[0]
        if op == "delete":
            rows = [r for r in rows if r[0] != key]
        elif op == "update" and before is not None and before[0] != key:
            old = next((r for r in rows if r[0] == before[0]), before)
            rows = [r for r in rows if r[0] != before[0] and (key is None or r[0] != key)] + [merged(old, after, unsent)]
        elif key is None:
            rows = [merged(r, after, unsent) if op == "update" and r[0] is None else r for r in rows] + ([after] if op == "insert" else [])
        else:
            old = next((r for r in rows if r[0] == key), (key, None, None))
            rows = [r for r in rows if r[0] != key] + [merged(old, after, unsent if op == "update" else ())]
    return sorted(rows, key=repr)


def log(rng, rows, n, null_keys=False, unsent=False):
    """A consistent log over a keyed table: what a source sends of changes that it made itself."""
    state, items = {r[0]: r for r in rows if r[0] is not None}, []
    for seq in range(n):
        k = rng.randrange(12)
        if null_keys and rng.random() < 0.25:
            op = rng.choice(["insert", "insert", "update", "delete"])
            row, lost = (None, rng.randrange(9), str(seq)), rng.sample("uv", rng.randrange(2)) if unsent and op == "update" else []
            sent = tuple(None if c in lost else x for c, x in zip("kuv", row))
            items.append((op, seq, None if op == "insert" else (None, None, None), None if op == "delete" else sent, lost))
        elif k not in state:
            state[k] = (k, rng.randrange(100), str(seq))
            items.append(("insert", seq, None, state[k], []))
        elif rng.random() < 0.2:
            items.append(("delete", seq, state.pop(k), None, []))
        else:
            to = rng.choice([k, k, k, 20 + seq])
            lost = rng.sample("uv", rng.randrange(3)) if unsent else []
            row = merged(state[k], (to, rng.randrange(100), str(seq)), lost)
            sent = tuple(None if c in lost else x for c, x in zip("kuv", row))
            before = (k, None, None) if to == k or not unsent else state[k]
            del state[k]
            state[to] = row
            items.append(("update", seq, before, sent, lost))
    return items


def test_what_was_lost_before(spark):
    target, rows = frames(spark, [(1, 1, "x"), (1, 1, "x"), (2, 2, "y")], [("insert", 1, None, (1, 1, "x"), None), ("insert", 2, None, (5, None, None), None)])
    assert got(apply.apply_changes(target, rows, BAG)) == sorted([(1, 1, "x")] * 3 + [(2, 2, "y"), (5, None, None)], key=repr)
    target, rows = frames(spark, [(1, 1, "x")], [("insert", 1, None, (None, 2, "n"), None), ("insert", 2, None, (None, 2, "n"), None)])
    assert got(apply.apply_changes(target, rows, NULLABLE)) == sorted([(1, 1, "x"), (None, 2, "n"), (None, 2, "n")], key=repr)
    target, rows = frames(spark, [(1, 1, "x")], [("update", 1, (1, None, None), (1, 5, None), ["v"])])
    assert got(apply.apply_changes(target, rows, KEYED)) == [(1, 5, "x")]


@pytest.mark.parametrize("seed", range(4))
def test_mixed_logs_against_replay(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(100), "old") for k in range(0, 12, 2)]
    odd = [(None, 1, "a"), (None, 2, "b")] if seed % 2 else []
    items = log(rng, rows, 120, null_keys=True, unsent=True)
    target, change = frames(spark, rows + odd, items)
    want = replayed(rows + odd, items, NULLABLE)
    assert got(apply.apply_changes(target, change, NULLABLE)) == want
    assert got(apply.apply_changes(apply.apply_changes(target, change.filter("seq < 50"), NULLABLE), change.filter("seq >= 50"), NULLABLE)) == want


@pytest.mark.parametrize("seed", range(3))
def test_bags_against_replay(spark, seed, monkeypatch):
    monkeypatch.setattr("driftwell.operators.replay.SLICE", 16)
    rng = random.Random(seed)
    row = lambda: (rng.randrange(3), rng.choice([None, 1]), rng.choice([None, "x"]))
    rows = [row() for _ in range(20)]
    items = []
    for seq in range(150):
        op = rng.choice(["insert", "delete", "delete", "update"])
        lost = ["v"] if op == "update" and rng.random() < 0.3 else []
        items.append((op, seq, None if op == "insert" else row(), None if op == "delete" else row(), lost))
    target, change = frames(spark, rows, items)
    assert got(apply.apply_changes(target, change, BAG)) == replayed(rows, items, BAG)
    with pytest.raises(ValueError):
        apply.apply_changes(target, change, BAG, "update_only")
    with pytest.raises(ValueError):
        merge.compact(change, BAG)


def test_moves_take_what_was_not_sent(spark):
    items = [("update", 1, (1, None, None), (1, 9, None), ["v"]), ("update", 2, (1, None, None), (7, None, None), ["u", "v"])]
    target, rows = frames(spark, [(1, 1, "long")], items)
    assert got(apply.apply_changes(target, rows, KEYED)) == [(7, 9, "long")]
    twice = [*items, ("update", 3, (7, None, None), (8, None, None), ["u", "v"])]
    with pytest.raises(Exception, match="no value of"):
        apply.apply_changes(target, frames(spark, [], twice)[1], KEYED).collect()


def test_update_only_keeps_what_was_not_sent(spark):
    target, rows = frames(spark, [(1, 1, "x")], [("update", 1, (1, 1, "x"), (1, 2, None), ["v"]), ("update", 2, (3, 1, "x"), (3, 2, None), ["v"])])
    assert got(apply.apply_changes(target, rows, KEYED, "update_only")) == [(1, 2, "x")]


def test_a_primary_key_has_no_nulls(spark):
    target, rows = frames(spark, [(1, 1, "x")], [("insert", 1, None, (None, 1, "x"), None)])
    with pytest.raises(Exception, match="null in the key"):
        apply.apply_changes(target, rows, KEYED).collect()


def test_empty(spark):
    target, rows = frames(spark, [], [])
    for meta in (KEYED, BAG, NULLABLE, UNIQUE):
        assert apply.apply_changes(target, rows, meta).count() == 0 and apply.replace_rows(target, rows, meta).count() == 0


def replaced(rows, items):
    """REPLACE on k and u, a row at a time."""
    rows = list(rows)
    for op, _, before, after, unsent in sorted(items, key=lambda x: x[1]):
        old = next((r for r in rows if before and r[0] == before[0]), before)
        if op != "insert":
            rows = [r for r in rows if r[0] != before[0]]
        if op != "delete":
            new = merged(old, after, unsent) if op == "update" else after
            rows = [r for r in rows if (r[0] != new[0] or new[0] is None) and (r[1] != new[1] or new[1] is None)] + [new]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("meta", [UNIQUE, TableMeta("s", "t", ("k", "u", "v"), unique=(("k",), ("u",)), nullable=frozenset("kuv"))])
def test_unique_keys_against_replay(spark, meta):
    rng = random.Random(7)
    rows = [(k, k + 100, "old") for k in range(0, 12, 3)]
    items = []
    for seq in range(100):
        op, k = rng.choice(["insert", "update", "delete"]), rng.randrange(12)
        key = None if meta.nullable.intersection("k") and rng.random() < 0.1 else k
        row = (key, rng.choice([None, rng.randrange(8), k + 100]), str(seq))
        items.append((op, seq, None if op == "insert" else (key, None, None), None if op == "delete" else row, []))
    target, change = frames(spark, rows, items)
    want = replaced(rows, items)
    assert got(apply.replace_rows(target, change, meta)) == want
    assert got(TaskSpec().applied(target, change, meta)) == want


@pytest.mark.parametrize("kind", ["keyed", "null", "bag"])
def test_change_tables_keep_everything(spark, tmp_path, kind):
    rng = random.Random(3)
    rows = [(k, 1, "old") for k in range(0, 12, 2)]
    meta = {"keyed": KEYED, "null": NULLABLE, "bag": BAG}[kind]
    if kind == "bag":
        state, items = list(rows), []
        for seq in range(60):
            new = (rng.randrange(3), None, "n")
            items.append(("insert", seq, None, new, []) if seq % 3 else ("delete", seq, rng.choice([*state, new]), None, []))
    else:
        items = log(rng, rows, 120, null_keys=kind == "null", unsent=True)
    target, change = frames(spark, rows, items)
    at = ChangeTable(spark, str(tmp_path / "t"), meta, target.schema)
    at.load(target)
    want = replayed(rows, items, meta)
    for n, cut in enumerate(range(0, 120, 40)):
        batch = change.filter(f"seq >= {cut} AND seq < {cut + 40}")
        at.append(batch.withColumn("unchanged", F.array().cast("array<string>")) if kind == "bag" else batch, n)
        at.append(batch, n)  # a repeated batch replaces its folder
        if n == 1:
            at.fold()
    assert got(at.read()) == want


def test_digests_say_what_the_full_check_says(spark):
    src = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (None, 3, "z")], COLUMNS)
    meta = table_meta(src, "t", unique=[("k",)])
    for dst in (src.drop("v"), src.filter("k = 1"), src.withColumn("v", F.lit("y")), src):
        for how in ("left", "full"):
            full = check.compared(src, dst, meta, how).filter("kind <> 'same'").select("k", "kind", "diff_cols")
            assert got(check.by_digest(src, dst, meta, how).select("k", "kind", "diff_cols")) == got(full)


def test_a_written_batch_is_held_to_what_was_sent(spark):
    target, rows = frames(spark, [(1, 5, "x")], [("update", 1, (1, None, None), (1, 5, None), ["v"])])
    assert [r.kind for r in check.applied(rows, target, KEYED).collect()] == ["same"]


def test_names_may_be_swapped_in_logs(spark):
    src = spark.createDataFrame([(1, 2, "x")], "k long, a long, b string")
    dst = spark.createDataFrame([(1, 3, "x", 4)], "k long, a long, b string, src long")
    meta = TableMeta("s", "t", ("k", "a", "b"), ("k",))
    out = check.under_names(check.compared(src, dst, meta), meta, {"a": "b", "b": "a", "k": "src"})
    row = out.first()
    assert row["diff_cols"] == ["b"] and row["dst"].asDict() == {"src": 1, "b": 3, "a": "x"}


def test_columns_not_sent_fill_up(spark):
    _, rows = frames(spark, [], [("insert", 1, None, (1, 1, "a"), []), ("update", 2, None, (1, 2, None), ["v"])])
    assert not changes.sends_all(rows) and changes.sends_all(rows.drop("unchanged")) and changes.sends_all(rows.filter("seq = 1"))
    net = merge.compact(rows, KEYED).first()
    assert (net.after.u, net.after.v, net.unsent) == (2, "a", [])
