"""The effect of changes on a target table, as a new DataFrame.

A batch is small beside its target, so targets are anti-joined with the batch's keys (which adaptive execution broadcasts if
their measured size allows) and never aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import bit_text, text_or_hex
from ..meta import TableMeta
from . import replay
from .changes import fill_unchanged, sends_all
from .merge import compact, has_null, images, net_effect

DELETED, STAMP = "_is_deleted", "_sync_ts"


def apply_changes(target: DataFrame, changes: DataFrame, meta: TableMeta, mode: str = "upsert") -> DataFrame:
    """``target`` after the changes, as if they were replayed in the order of ``seq``.

    upsert: an update of a missing row writes it.  update_only: it does nothing, unless it moves a row to another key, which is a
    delete and an insert.  Columns that an update did not send (``unchanged``) stay as they are.  A table without a key is a bag
    of rows (``replay.bag``), which knows upsert only; rows with a null in a nullable key follow ``replay.null_keyed``; a null in a
    primary key is an error.
    """
    if mode not in ("upsert", "update_only"):
        raise ValueError(mode)
    if meta.is_bag:
        if mode != "upsert":
            raise ValueError("a table without a key has no mode update_only")
        return replay.bag(target, changes)
    if sends_all(changes):
        changes = changes.drop("unchanged")
    else:
        changes = replay.moved_values(target, changes, meta)
    key, odd = list(meta.id_cols), has_null(meta.id_cols)
    flat = images(changes, meta)
    if not meta.nullable.intersection(key):
        missing = F.raise_error(F.lit(f"{meta.schema}.{meta.table}: a change has a null in the key")).cast("boolean")
        out = _keyed(target, flat.filter(F.when(odd, missing).otherwise(F.lit(True))), meta, mode)
        return out
    plain = _keyed(target.filter(~odd), flat.filter(~odd), meta, mode)
    return plain.unionByName(replay.null_keyed(target, flat, meta))


def _keyed(target: DataFrame, flat: DataFrame, meta: TableMeta, mode: str) -> DataFrame:
    """The target after images of rows that have their key."""
    columns, key = target.columns, list(meta.id_cols)
    net = net_effect(flat, meta)
    partial = "unsent" in net.columns
    if mode == "upsert":
        kept = target.join(net.select(*key), key, "left_anti").select(*columns)
        alive = net.filter("op <> 'delete'")
        whole = (alive.filter(F.size("unsent") == 0) if partial else alive).select("after.*").select(*columns)
        out = kept.unionByName(whole)
        if not partial:
            return out
        holes = alive.filter(F.size("unsent") > 0).select(*key, "after", "unsent")
        # both sides of the second join have a row per such key; the target is scanned, not shuffled, while the batch can be broadcast
        known = target.select(F.struct(*columns).alias("_old"), *key).join(holes.select(*key), key, "left_semi")
        met = holes.join(known, key, "left")
        return out.unionByName(met.select(*[F.when(F.array_contains("unsent", c), F.col("_old")[c]).otherwise(F.col("after")[c]).alias(c) for c in columns]))
    known = target.select(F.struct(*columns).alias("_row"), *key)
    joined = known.join(net, key, "full_outer")
    exists = F.when(F.col("born").isNotNull(), F.col("born") != "delete").otherwise(F.col("_row").isNotNull())
    value = lambda c: F.when(F.array_contains("unsent", c), F.col("_row")[c]).otherwise(F.col("after")[c]) if partial else F.col("after")[c]
    row = F.when(F.col("op").isNull(), F.col("_row")).otherwise(F.struct(*[value(c).alias(c) for c in columns]))
    return joined.filter(exists).select(row.alias("_row")).select("_row.*")


def replace_rows(target: DataFrame, changes: DataFrame, meta: TableMeta) -> DataFrame:
    """REPLACE semantics on several unique keys: a written row removes every row, old or new, that shares a key with it.

    Nulls in a unique key conflict with nothing, but a delete or an update names its row by the identifying columns, where null equals null.
    Columns that were not sent take the key's last value, in the batch or in the target.
    """
    if meta.is_bag:
        return replay.bag(target, changes)
    columns, key = target.columns, list(meta.id_cols)
    if sends_all(changes):
        changes = changes.drop("unchanged")
    else:
        changes = _completed(target, replay.moved_values(target, changes, meta), meta)
    flat = images(changes, meta).withColumn("_at", (F.col("seq") * 2 + F.col("part")).cast("long"))
    writes = flat.filter("after IS NOT NULL").select("after.*", "_at").select(*columns, "_at")
    rows = target.select(*columns, F.lit(-1).cast("long").alias("_at")).unionByName(writes)
    # what ends a row: a later delete or update of its key, a later write that shares any whole key with it
    named = flat.filter("op <> 'insert'").groupBy(*key).agg(F.max("_at").alias("_last"))
    alive = _not_ended(rows, named, key, null_safe=bool(meta.nullable.intersection(key)))
    for unique in meta.keys:
        held = ~has_null(unique)
        taken = writes.filter(held).groupBy(*unique).agg(F.max("_at").alias("_last"))
        alive = _not_ended(alive, taken, list(unique))
    return alive.select(*columns)


def _not_ended(rows: DataFrame, ends: DataFrame, key: list[str], null_safe: bool = False) -> DataFrame:
    """Rows without a later end of their key."""
    names = [f"_k{n}" for n in range(len(key))]
    ends = ends.select(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)], "_last")
    cond = F.col("_at") < F.col("_last")
    for c, n in zip(key, names, strict=True):
        cond = cond & (F.col(c).eqNullSafe(F.col(n)) if null_safe else F.col(c) == F.col(n))
    return rows.join(ends, cond, "left_anti")


def _completed(target: DataFrame, changes: DataFrame, meta: TableMeta) -> DataFrame:
    """Changes with all columns: the key's last sent value, else the target's."""
    filled = fill_unchanged(changes, meta)
    known = target.select(F.struct(*target.columns).alias("_old"), *[F.col(c).alias(f"_k{n}") for n, c in enumerate(meta.id_cols)])
    cond = F.lit(True)
    for n, c in enumerate(meta.id_cols):
        cond = cond & F.col("after")[c].eqNullSafe(F.col(f"_k{n}"))
    holes = F.size(F.coalesce("unchanged", F.array().cast("array<string>"))) > 0
    met = filled.filter(holes & F.col("after").isNotNull()).join(known, cond, "left")
    fields = changes.schema["after"].dataType.names
    value = lambda c: F.when(F.array_contains("unchanged", c), F.col("_old")[c]).otherwise(F.col("after")[c]) if c in target.columns else F.col("after")[c]
    met = met.withColumn("after", F.struct(*[value(c).alias(c) for c in fields])).select(*filled.columns)
    return filled.filter(~holes | F.col("after").isNull()).unionByName(met).drop("unchanged")


def insert_or_update_values(target: DataFrame, rows: DataFrame, meta: TableMeta, on_conflict: str = "update") -> DataFrame:
    """New keys are inserted; of rows that exist, only columns outside every key change (``nothing``: none change)."""
    columns, key = target.columns, list(meta.id_cols)
    fixed = set(meta.key_cols)
    known = target.select(F.struct(*columns).alias("_old"), *key)
    new = rows.select(F.struct(*columns).alias("_new"), *key)
    joined = known.join(new, key, "full_outer")
    merged = F.struct(*[(F.col("_old")[c] if c in fixed or on_conflict == "nothing" else F.col("_new")[c]).alias(c) for c in columns])
    row = F.when(F.col("_new").isNull(), F.col("_old")).when(F.col("_old").isNull(), F.col("_new")).otherwise(merged)
    return joined.select(row.alias("_row")).select("_row.*")


def append_audited(changes: DataFrame, meta: TableMeta, soft: bool = True) -> DataFrame:
    """Rows for an append-only target: every image with ``_is_deleted`` and ``_sync_ts``; its latest version per key is the table."""
    flat = images(changes, meta)
    deleted = (F.col("op") == "delete").cast("int")
    row = [F.coalesce(F.col("after")[c], F.col(c)) if c in meta.id_cols else F.col("after")[c] for c in meta.columns]
    out = flat.select(*[x.alias(c) for x, c in zip(row, meta.columns, strict=True)], deleted.alias(DELETED), (F.col("seq") * 2 + F.col("part")).alias(STAMP))
    return out if soft else out.filter(F.col(DELETED) == 0)


def load_rows(changes: DataFrame, meta: TableMeta, hard_delete: bool = False, json_columns: Sequence[str] = (), bit_columns: Sequence[str] = ()) -> DataFrame:
    """The net effect of a batch as JSON rows for bulk loading: (``row``, ``seq``).

    Soft: the audit columns mark deletes.  Hard: ``__op`` is upsert or delete, and a delete carries the key only.  Texts in ``json_columns``
    become nested values (null if they are no JSON); bit fields in ``bit_columns`` become numbers, other bytes text or hex.
    """
    net = compact(changes, meta)
    kinds = {f.name: f.dataType for f in changes.schema["after"].dataType}

    def value(c: str):
        x = F.coalesce(F.col("after")[c], F.col(c)) if c in meta.id_cols else F.col("after")[c]
        if c in json_columns:
            return F.try_parse_json(x).alias(c)
        if c in bit_columns:
            return (bit_text(x) if kinds[c].typeName() == "binary" else x.cast("decimal(20,0)")).alias(c)
        return (text_or_hex(x) if kinds[c].typeName() == "binary" else x).alias(c)

    mark = [F.col("op").alias("__op")] if hard_delete else [(F.col("op") == "delete").cast("int").alias(DELETED), F.col("seq").alias(STAMP)]
    return net.select(F.to_json(F.struct(*[value(c) for c in meta.columns], *mark)).alias("row"), "seq")


def latest_view(log: DataFrame, meta: TableMeta, with_deleted: bool = False) -> DataFrame:
    """The live rows of an append-only table; one aggregation with partial results."""
    others = [c for c in log.columns if c not in meta.id_cols]
    last = log.groupBy(*meta.id_cols).agg(F.max_by(F.struct(*others), STAMP).alias("_v")).select(*meta.id_cols, "_v.*").select(*log.columns)
    return last if with_deleted else last.filter(F.col(DELETED) == 0)


def delete_rows(target: DataFrame, deletes: DataFrame, meta: TableMeta) -> DataFrame:
    """Removes rows by their identifying columns; null equals null.  In a bag table each delete removes one row only."""
    if meta.is_bag:
        return bag_delete(target, deletes.select(*target.columns))
    gone = deletes.select(*[F.col(c).alias(f"_k_{c}") for c in meta.id_cols])
    cond = F.lit(True)
    for c in meta.id_cols:
        cond = cond & (F.col(c).eqNullSafe(F.col(f"_k_{c}")) if c in meta.nullable else F.col(c) == F.col(f"_k_{c}"))
    return target.join(gone, cond, "left_anti")


def bag_delete(target: DataFrame, deletes: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Removes as many rows as ``deletes`` has, one each.

    With all columns given it is a multiset difference.  With fewer, any row that agrees on ``key`` may go: rows of a key are numbered,
    the lowest in the order of all columns first, so the result does not depend on the partitioning.
    """
    if key is None or set(key) == set(target.columns):
        return target.exceptAll(deletes.select(*target.columns))
    numbered = target.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*target.columns)))
    counts = deletes.groupBy(*key).agg(F.count("*").alias("_gone")).select(*[F.col(c).alias(f"_k_{c}") for c in key], "_gone")
    cond = F.col("_n") <= F.col("_gone")
    for c in key:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return numbered.join(counts, cond, "left_anti").drop("_n")


def bag_update(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Keyless update: one row equal to each ``before`` becomes its ``after``; an update without such a row does nothing."""
    columns = target.columns
    n = F.row_number().over(Window.partitionBy(*columns).orderBy(F.lit(1)))
    rows = target.withColumn("_n", n)
    wanted = updates.select(*[F.col("before")[c].alias(f"_b_{c}") for c in columns], "after", "seq")
    wanted = wanted.withColumn("_n2", F.row_number().over(Window.partitionBy(*[f"_b_{c}" for c in columns]).orderBy("seq")))
    cond = F.col("_n") == F.col("_n2")
    for c in columns:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    joined = rows.join(wanted, cond, "left")
    return joined.select(F.when(F.col("after").isNotNull(), F.col("after")).otherwise(F.struct(*columns)).alias("_r")).select("_r.*")


def snapshot_plus_changes(snapshot: DataFrame, changes: DataFrame, meta: TableMeta, snapshot_seq: int) -> DataFrame:
    """A snapshot taken at ``snapshot_seq`` and the changes since: what the snapshot already holds is not applied again."""
    return apply_changes(snapshot, changes.filter(F.col("seq") > snapshot_seq), meta)
