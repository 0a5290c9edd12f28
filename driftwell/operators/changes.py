"""Change rows of one table: ``op`` (insert, update, delete), ``seq`` (long, the order of commits), ``before`` and ``after``.

The images are structs of the table's columns; an insert has no ``before``, a delete no ``after``.  ``unchanged`` (optional)
lists columns of ``after`` whose value the source did not send: they are null there but not NULL.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..meta import TableMeta
from .ordered import with_segments

OPS = ("insert", "update", "delete")


def snapshot_changes(rows: DataFrame, seq: int = 0) -> DataFrame:
    """A snapshot as inserts."""
    image = F.struct(*rows.columns)
    return rows.select(F.lit("insert").alias("op"), F.lit(seq).cast("long").alias("seq"), F.when(F.lit(False), image).alias("before"), image.alias("after"))


def with_before(changes: DataFrame, meta: TableMeta) -> DataFrame:
    """Where the source sent no old image, the new one's identifying columns serve as it."""
    fields = changes.schema["after"].dataType
    own = F.struct(*[(F.col("after")[f.name] if f.name in meta.id_cols else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
    return changes.withColumn("before", F.when(F.col("op") == "update", F.coalesce("before", own)).otherwise(F.col("before")))


def split_updates(changes: DataFrame) -> DataFrame:
    """An update as a delete of the old image and an insert of the new one; ``part`` orders the two and ``is_origin`` tells them from sent rows."""
    none_b, none_a = F.lit(None).cast(changes.schema["before"].dataType), F.lit(None).cast(changes.schema["after"].dataType)
    row = lambda op, part, before, after, origin: F.struct(F.lit(op).alias("op"), F.lit(part).alias("part"), before.alias("before"), after.alias("after"), F.lit(origin).alias("is_origin"))
    both = F.array(row("delete", 0, F.col("before"), none_a, False), row("insert", 1, none_b, F.col("after"), False))
    same = F.array(F.struct(F.col("op"), F.lit(0).alias("part"), F.col("before"), F.col("after"), F.lit(True).alias("is_origin")))
    rest = [c for c in changes.columns if c not in ("op", "before", "after")]
    return changes.select(*rest, F.inline(F.when(F.col("op") == "update", both).otherwise(same)))


def reversed_changes(changes: DataFrame) -> DataFrame:
    """What undoes each change; apply these from the last to the first."""
    op = F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise(F.col("op"))
    return changes.withColumns({"op": op, "before": F.col("after"), "after": F.col("before")})


def sends_all(changes: DataFrame) -> bool:
    """Whether no row of the batch lacks a column; one look at the column ``unchanged``."""
    return "unchanged" not in changes.columns or changes.filter(F.size("unchanged") > 0).isEmpty()


def fill_unchanged(changes: DataFrame, meta: TableMeta) -> DataFrame:
    """Columns that the source did not send take the key's last sent value; ``unchanged`` keeps those never sent before."""
    key = [F.coalesce(F.col("after")[c], F.col("before")[c]) for c in meta.id_cols]
    until = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fields = changes.schema["after"].dataType.names
    kept = F.coalesce("unchanged", F.array().cast("array<string>"))
    last = {c: F.last(F.when(F.col("after").isNotNull() & ~F.array_contains(kept, c), F.struct(F.col("after")[c].alias("v"))), ignorenulls=True).over(until) for c in fields if c not in meta.id_cols}
    held = changes.withColumns({f"_last_{c}": x for c, x in last.items()})
    after = F.struct(*[(F.col(f"_last_{c}.v") if c in last else F.col("after")[c]).alias(c) for c in fields])
    still = F.filter(kept, lambda c: ~F.array_contains(F.array_compact(F.array(*[F.when(F.col(f"_last_{c}").isNotNull(), F.lit(c)) for c in last])), c))
    out = held.withColumns({"after": F.when(F.col("after").isNotNull(), after), "unchanged": still})
    return out.drop(*[f"_last_{c}" for c in last])


def key_changed(meta: TableMeta, before: str = "before", after: str = "after") -> Column:
    """Whether an update changes a column of any key."""
    changed = F.lit(False)
    for c in meta.key_cols:
        changed = changed | ~F.col(before)[c].eqNullSafe(F.col(after)[c])
    return (F.col("op") == "update") & changed


def drain_segments(changes: DataFrame, seq: str = "seq", parts: Sequence[str] = ("kind", "origin")) -> DataFrame:
    """Runs of one kind of statement from one origin: within a run changes may be merged, between runs they may not."""
    return with_segments(changes, seq, parts)


def drop_loops(changes: DataFrame, own_node: str, do_nodes: Collection[str], ignore_nodes: Collection[str] = (), txn: str = "txn", seq: str = "seq", marker: str = "marker_origin") -> DataFrame:
    """Drops transactions that came from elsewhere than ``do_nodes``.

    The first row of a transaction may be a marker: ``marker`` then names the node where the transaction began.  Such
    a row goes in any case; without one the transaction is ``own_node``'s and stays.  A later marker is an ordinary row.
    """
    rows = Window.partitionBy(txn)
    first = F.min(F.struct(F.col(seq).alias("at"), F.col(marker).alias("origin"))).over(rows)
    found = changes.withColumn("_first", first)
    origin = F.col("_first.origin")
    is_marker = (F.col(seq) == F.col("_first.at")) & F.col(marker).isNotNull()
    foreign = origin.isNotNull() & (origin.isin(list(ignore_nodes)) | ~origin.isin(list(do_nodes)))
    return found.filter(~is_marker & ~foreign).withColumn("data_origin", F.coalesce(origin, F.lit(own_node))).drop("_first")


def without_statements(events: DataFrame, log_table: str, schema: str = "schema", table: str = "table") -> tuple[DataFrame, DataFrame]:
    """(row changes, statements): inserts into a table in which a trigger logs DDL are statements, its other changes are nothing."""
    logged = F.col(table).eqNullSafe(F.lit(log_table))
    return events.filter(~logged), events.filter(logged & (F.col("op") == "insert"))


def last_positions(commits: DataFrame, key: Sequence[str], position: str = "position", seq: str = "seq") -> DataFrame:
    """The position of the last commit of each key."""
    return commits.groupBy(*key).agg(F.max_by(F.struct(position), seq)[position].alias(position), F.max(seq).alias(seq))
