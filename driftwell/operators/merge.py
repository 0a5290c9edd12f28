"""The net effect of a batch of changes on each key.

The contract is replay in the order of ``seq``.  For keyed rows the last image of a key decides, so one aggregation
over the key columns gives the net effect; partial aggregation shrinks a hot key before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import TableMeta
from .changes import key_changed, sends_all
from .ordered import with_segments


def images(changes: DataFrame, meta: TableMeta, moves_are_whole: bool = True) -> DataFrame:
    """Key columns, ``op``, ``seq``, ``part`` and ``after``: what each change does to one key; ``unsent`` too if the changes have ``unchanged``.

    An update that changes the identifying columns is a delete of the old key (part 0) and an insert of the new one (part 1), which has
    all columns unless ``moves_are_whole`` is false.
    """
    after_type = changes.schema["after"].dataType
    key = lambda image: F.struct(*[F.col(image)[c].alias(c) for c in meta.id_cols])
    none, all_sent = F.lit(None).cast(after_type), F.array().cast("array<string>")
    partial = "unchanged" in changes.columns
    row = lambda k, op, part, after, unsent=all_sent: F.struct(k.alias("k"), op.alias("op"), F.lit(part).alias("part"), after.alias("after"), unsent.alias("unsent"))
    moved = is_moved(meta)
    gone = row(key("before"), F.lit("delete"), 0, none)
    unsent = F.when(F.col("op") == "update", F.coalesce("unchanged", all_sent)).otherwise(all_sent) if partial else all_sent
    put = row(key("after"), F.when(moved, "insert").otherwise(F.col("op")), 1, F.col("after"), F.when(moved, all_sent).otherwise(unsent) if moves_are_whole else unsent)
    rows = F.when(F.col("op") == "delete", F.array(gone)).when(moved, F.array(gone, put)).otherwise(F.array(put))
    return changes.select("seq", F.explode(rows).alias("r")).select("r.k.*", "r.op", "seq", "r.part", "r.after", *["r.unsent"][: int(partial)])


def is_moved(meta: TableMeta) -> Column:
    """Whether an update changes the identifying columns."""
    moved = F.lit(False)
    for c in meta.id_cols:
        moved = moved | ~F.col("before")[c].eqNullSafe(F.col("after")[c])
    return (F.col("op") == "update") & F.col("before").isNotNull() & moved


def has_null(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def net_effect(flat: DataFrame, meta: TableMeta) -> DataFrame:
    """One row per key of ``images``: key columns, ``op`` (the last), ``after``, ``seq``, ``clears``, ``born`` (the last insert or delete, if any).

    With ``unsent`` in the images, each column has its last sent value since the key was born, and the result's ``unsent``
    lists the columns that no image of the key gives: the target's row has them.
    """
    key, order = list(meta.id_cols), F.struct("seq", "part")
    births = F.when(F.col("op").isin("insert", "delete"), order)
    wanted = [
        F.max_by(F.struct("op", "after"), order).alias("last"), F.max("seq").alias("seq"), F.max(F.col("op") != "insert").alias("clears"),
        F.max_by(F.struct("op"), births)["op"].alias("born"),
    ]
    fields = flat.schema["after"].dataType.names
    if "unsent" not in flat.columns:
        return flat.groupBy(*key).agg(*wanted).select(*key, "last.op", "last.after", "seq", "clears", "born")
    wanted.append(F.max(births).alias("birth"))
    sent = {c: F.col("after").isNotNull() & ~F.array_contains("unsent", c) for c in fields}
    got = {c: f"got{n}" for n, c in enumerate(fields) if c not in key}
    for c, name in got.items():
        wanted.append(F.max_by(F.struct(order.alias("at"), F.col("after")[c].alias("value")), F.when(sent[c], order)).alias(name))
    net = flat.select(F.struct(*key).alias("k"), "op", "seq", "part", "after", "unsent").groupBy("k").agg(*wanted)
    fresh = {c: F.col(name).isNotNull() & (F.col("birth").isNull() | (F.col(f"{name}.at") >= F.col("birth"))) for c, name in got.items()}
    after = F.struct(*[(F.when(fresh[c], F.col(f"{got[c]}.value")) if c in got else F.col("k")[c]).alias(c) for c in fields])
    lacking = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.col(name).isNull(), F.lit(c)) for c, name in got.items()]))
    alive = F.col("last.op") != "delete"
    unsent = F.when(alive & F.col("birth").isNull(), lacking).otherwise(F.array().cast("array<string>"))
    return net.select("k.*", "last.op", F.when(alive, after).alias("after"), "seq", "clears", "born", unsent.alias("unsent"))


def compact(changes: DataFrame, meta: TableMeta) -> DataFrame:
    """One row per key: key columns, ``op`` (upsert or delete), ``after``, ``seq``, ``clears``: whether the target's row must go first; ``unsent`` as in ``net_effect``
    if some row of the batch lacks a column.

    A null in the key never merges: such rows are in ``unmergeable``.  Nor do rows of a table without a key; ``apply`` replays both.
    """
    if meta.is_bag:
        raise ValueError(f"{meta.schema}.{meta.table} has no key: its changes are replayed, not merged")
    flat = images(changes.drop("unchanged") if sends_all(changes) else changes, meta)
    net = net_effect(flat.filter(~has_null(meta.id_cols)), meta).drop("born")
    return net.withColumn("op", F.when(F.col("op") == "delete", "delete").otherwise("upsert"))


def phases(net: DataFrame, meta: TableMeta) -> tuple[DataFrame, DataFrame]:
    """(keys to delete first, rows to insert after that): in this order re-inserted and updated rows come out right."""
    return net.filter((F.col("op") == "delete") | F.col("clears")).select(*meta.id_cols), net.filter("op = 'upsert'").select("after.*")


def unmergeable(changes: DataFrame, meta: TableMeta, update_ends: bool = False) -> Column:
    """Rows that must be replayed one by one: keyless tables, nulls in the key, changed keys, columns not sent.

    ``update_ends``: document stores, where an update is not a full image.
    """
    image = F.when(F.col("op") == "delete", F.col("before")).otherwise(F.col("after"))
    no_key = F.lit(meta.is_bag)
    for c in meta.order_cols:
        no_key = no_key | image[c].isNull()
    bad = no_key | key_changed(meta)
    if "unchanged" in changes.columns:
        bad = bad | (F.size(F.coalesce("unchanged", F.array().cast("array<string>"))) > 0)
    if update_ends:
        bad = bad | (F.col("op") == "update")
    return F.coalesce(bad, F.lit(True))


def with_unmerged(changes: DataFrame, bad: Column, seq: str = "seq", per: Sequence[str] = ()) -> DataFrame:
    """``unmerged``: from a table's first unmergeable row on, all its rows are.

    The first such row of each table comes from an aggregation, not from a running window over the table.
    """
    first = changes.filter(bad).groupBy(*per).agg(F.min(seq).alias("_first"))
    if not per:
        return changes.withColumn("unmerged", F.coalesce(F.col(seq) >= first.scalar(), F.lit(False)))
    return changes.join(first, list(per), "left").withColumn("unmerged", F.coalesce(F.col(seq) >= F.col("_first"), F.lit(False))).drop("_first")


def replay_runs(unmerged: DataFrame, seq: str = "seq") -> DataFrame:
    """``segment``: runs of one operation, to be replayed in turn; within a run of inserts rows may be batched."""
    return with_segments(unmerged, seq, ["op"])
