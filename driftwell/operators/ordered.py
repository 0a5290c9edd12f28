"""Positions, running sums and runs in a global order, without one task that holds all rows.

Rows are cut into ranges of the whole order, by Spark's range partitioning, and written; each range is summed by itself, and the ranges' totals,
one row per range, give the offsets.  Nothing that grows with the rows comes to the driver or into a plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 2_000_000


def range_of(key: Column, cuts: Sequence, low: int = 0) -> Column:
    """``low`` and the number of cuts below ``key``, by bisection of one array literal; a null key is below all."""
    if not cuts:
        return F.lit(low)
    held = F.lit(list(cuts))

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["a"] + at["b"]) / 2).cast("int")
        above = F.coalesce(key > F.get(held, middle), F.lit(False))
        open_ = at["a"] < at["b"]
        return F.struct(F.when(open_ & above, middle + 1).otherwise(at["a"]).alias("a"), F.when(open_ & ~above, middle).otherwise(at["b"]).alias("b"))

    start = F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, step)["a"] + F.lit(low)


def with_running(df: DataFrame, order: Sequence[str], value: Column, name: str, rows_per_range: int | None = None) -> DataFrame:
    """``df`` with the sum (a long) of ``value`` over the rows before each in the order of the columns, nulls first.

    Rows that tie are put in an order of their own.  One count, and beyond ``rows_per_range`` rows one table written to the shared folder.
    """
    from ..sources.shared import scratch

    rows_per_range = ROWS_PER_RANGE if rows_per_range is None else rows_per_range
    before = lambda window: F.coalesce(F.sum("_value").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    total = df.count()
    valued = df.withColumn("_value", value)
    if total <= rows_per_range:
        return valued.withColumn(name, before(Window.orderBy(*order))).drop("_value")
    # rows that tie in the order are spread over ranges by their other columns
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    ranged = valued.withColumn("_tie", tie).repartitionByRange(ceil(total / rows_per_range), *order, "_tie").withColumn("_range", F.spark_partition_id())
    at = scratch(df.sparkSession, "ranges")
    ranged.write.parquet(at)
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(at)
    sums = ranged.groupBy("_range").agg(F.sum("_value").alias("_value"))
    offsets = sums.select("_range", before(Window.orderBy("_range")).alias("_offset"))
    inside = before(Window.partitionBy("_range").orderBy(*order, "_tie"))
    return ranged.withColumn("_inside", inside).join(offsets, "_range").withColumn(name, F.col("_offset") + F.col("_inside")).select(*df.columns, name)


def with_positions(df: DataFrame, order: Sequence[str], name: str = "position", rows_per_range: int | None = None) -> DataFrame:
    """``df`` with the place (from 1, a long) of each row in the order of the columns, nulls first; rows that tie get distinct places."""
    out = with_running(df, order, F.lit(1), name, rows_per_range)
    return out.withColumn(name, F.col(name) + 1)


def with_segments(df: DataFrame, order: str, parts: Sequence[str], name: str = "segment", span: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with the number (from 1) of the run of equal ``parts`` that a row stands in, in the order of a distinct long.

    ``span`` numbers of the order make a range.  A range's first and last parts and its count of changes are one row; only
    those rows meet in one task.
    """
    state = F.struct(*parts)
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(span)))
    inside = Window.partitionBy("_range").orderBy(order)
    before = F.lag(state).over(inside)
    changed = F.when(before.isNotNull() & ~before.eqNullSafe(state), 1).otherwise(0)
    marked = ranged.withColumn("_changes", F.sum(changed).over(inside))
    ends = ranged.groupBy("_range").agg(F.min_by(state, order).alias("head"), F.max_by(state, order).alias("tail"))
    totals = marked.groupBy("_range").agg(F.max("_changes").alias("inner"))
    across = Window.orderBy("_range")
    joint = F.when(F.lag("tail").over(across).isNotNull() & ~F.lag("tail").over(across).eqNullSafe(F.col("head")), 1).otherwise(0)
    offsets = ends.join(totals, "_range").withColumn("_joint", joint)
    offsets = offsets.select("_range", (F.sum(F.col("_joint") + F.col("inner")).over(across) - F.col("inner")).alias("_offset"))
    out = marked.join(offsets, "_range")
    return out.withColumn(name, (F.col("_offset") + F.col("_changes") + 1).cast("long")).drop("_range", "_changes", "_offset")
