"""Snapshot scans: predicates, chunks of a key's range, the pass over null keys, progress."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import ROWS_PER_RANGE, range_of, with_positions, with_running

#: Outside these bounds of (max - min + 1) / rows an even cut would give chunks that are too empty or too full.
SPARSEST, DENSEST = 1000.0, 0.05


@dataclass(frozen=True)
class Chunk:
    """Open below, closed above; None is no bound."""

    number: int
    low: object = None
    high: object = None

    def condition(self, key: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (key > F.lit(self.low))
        if self.high is not None:
            out = out & (key <= F.lit(self.high))
        return out

    def sql(self, key: str, quote=str) -> str:
        """For a JDBC source: one predicate is one partition of the read."""
        parts = ([f"{key} > {quote(self.low)}"] if self.low is not None else []) + ([f"{key} <= {quote(self.high)}"] if self.high is not None else [])
        return " AND ".join(parts) or f"{key} IS NOT NULL"


def splittable(kind: T.DataType) -> bool:
    """Numbers, times, texts and bytes have a range to cut; nested values have not."""
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BinaryType))


def even_chunks(low: int, high: int, rows: int, batch: int, resume: int | None = None) -> list[Chunk] | None:
    """Chunks of equal width for about ``batch`` rows each; None if the keys are too sparse or too dense for that.

    The first has no lower bound, the last ends at ``high``.  ``resume``: the scan goes on after this key.
    """
    if rows <= batch or low == high:
        return [Chunk(1, resume, None)]
    spread = (high - low + 1) / rows
    if not DENSEST <= spread <= SPARSEST:
        return None
    step = max(int(spread * batch), 1)
    start = low if resume is None else resume
    ends = list(range(start + step, high, step)) + [high]
    lows = [resume, *ends[:-1]]
    return [Chunk(k + 1, a, b) for k, (a, b) in enumerate(zip(lows, ends, strict=True)) if a is None or a < b]


def key_statistics(df: DataFrame, key: str) -> DataFrame:
    """One row: low, high, rows (of non-null keys)."""
    return df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("rows"))


def estimated_rows(df: DataFrame, row_bytes: int = 64) -> int:
    """Rows by what Spark knows of the plan without running it: catalogue or file statistics, else bytes over ``row_bytes``."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    if rows.isDefined():
        return int(str(rows.get()))
    return max(1, int(str(stats.sizeInBytes())) // row_bytes)


def uneven_chunks(df: DataFrame, key: str, batch: int) -> DataFrame:
    """One row per chunk of ``batch`` rows in the key's order: number, low, high (open below, closed above), rows.

    Rows that share a key stay in one chunk, the one where the first of them falls.
    """
    cut = _chunked_keys(df, key, batch).groupBy("_chunk").agg(F.max(key).alias("high"), F.sum("_n").alias("rows"))
    placed = with_positions(cut, ["_chunk"], "chunk", ROWS_PER_RANGE)
    below = placed.select((F.col("chunk") + 1).alias("chunk"), F.col("high").alias("low"))
    return placed.join(below, "chunk", "left").select("chunk", "low", "high", "rows")


def _chunked_keys(df: DataFrame, key: str, batch: int) -> DataFrame:
    """Each distinct key with its rows (_n) and the chunk (_chunk, from 1, with gaps behind a key of several chunks' rows) where the first of them falls."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    placed = with_running(counts, [key], F.col("_n"), "_before", ROWS_PER_RANGE)
    return placed.select(key, "_n", (F.floor(F.col("_before") / F.lit(batch)) + 1).cast("long").alias("_chunk"))


def with_uneven_chunk(df: DataFrame, key: str, batch: int, name: str = "chunk") -> DataFrame:
    """The chunk of each row as ``uneven_chunks`` numbers them, by joins on the key and the chunk: no list of chunks is made."""
    keys = _chunked_keys(df, key, batch).drop("_n")
    numbers = with_positions(keys.select("_chunk").distinct(), ["_chunk"], name, ROWS_PER_RANGE)
    return df.join(keys.join(numbers, "_chunk").select(key, name), key, "left").select(*df.columns, name)


def plan_chunks(df: DataFrame, key: str, batch: int) -> list[Chunk]:
    """Chunks of a table: even if its keys are integers that lie well, else uneven; a single one if it can't be cut.

    The list is what a reader over JDBC needs, a predicate and a partition each; ``batch`` is chosen so that it is short.
    """
    kind = df.schema[key].dataType
    if not splittable(kind):
        return [Chunk(1)]
    stats = key_statistics(df, key).first()
    if not stats["rows"] or stats["rows"] <= batch:
        return [Chunk(1)]
    if isinstance(kind, T.IntegralType) and (even := even_chunks(stats["low"], stats["high"], stats["rows"], batch)):
        return even
    return [Chunk(r["chunk"], r["low"], r["high"]) for r in uneven_chunks(df, key, batch).orderBy("chunk").collect()]


def with_chunk(df: DataFrame, key: str, chunks: Sequence[Chunk], name: str = "chunk") -> DataFrame:
    """The chunk of each row by its key, for a list of chunks as ``plan_chunks`` gives it; null keys have none, the null pass reads them."""
    inner = [c.high for c in chunks[:-1]]
    return df.withColumn(name, F.when(F.col(key).isNotNull(), range_of(F.col(key), inner, chunks[0].number).cast("long")))


def with_row_chunks(df: DataFrame, order: Sequence[str], batch: int, name: str = "chunk") -> DataFrame:
    """Every ``batch`` rows of the order share a number, from 1."""
    placed = with_positions(df, order, "_place")
    return placed.withColumn(name, (F.floor((F.col("_place") - 1) / F.lit(batch)) + 1).cast("long")).drop("_place")


def keyset(columns: Sequence[str], values: Sequence, closed: bool = False) -> Column:
    """``(c1, c2, ...) > (v1, v2, ...)`` in a form that reaches the scan: a bound on the first column and the lexicographic cases."""
    cases, equal = F.lit(False), F.lit(True)
    for k, (c, v) in enumerate(zip(columns, values, strict=True)):
        last = k == len(columns) - 1
        step = F.col(c) >= F.lit(v) if last and closed else F.col(c) > F.lit(v)
        cases = cases | (equal & step)
        equal = equal & (F.col(c) == F.lit(v))
    return (F.col(columns[0]) >= F.lit(values[0])) & cases


def page(df: DataFrame, columns: Sequence[str], after: Sequence | None, size: int) -> DataFrame:
    """The next rows in the order of the key: a bounded top-n, no full sort."""
    rows = df if after is None else df.filter(keyset(columns, after))
    return rows.orderBy(*columns).limit(size)


def null_pass(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that the keyed pass cannot see: a null in the ordering columns."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).isNull()
    return df.filter(cond)


def keyed_and_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both passes, with ``scan_pass`` telling them apart."""
    keyed = df
    for c in columns:
        keyed = keyed.filter(F.col(c).isNotNull())
    return keyed.withColumn("scan_pass", F.lit("keyed")).unionByName(null_pass(df, columns).withColumn("scan_pass", F.lit("null")))


def top_sample(df: DataFrame, order: Sequence[str], percent: int, rows: int | None = None) -> DataFrame:
    """The first rows in the order of the key, ``percent`` of their (estimated) number, one at least."""
    n = df.count() if rows is None else rows
    return df.orderBy(*order).limit(max(1, -(-n * percent // 100)))


def checkpoints(done: DataFrame, chunk: str = "chunk", at: str = "done_order", last: str = "last_key") -> DataFrame:
    """Progress that may be recorded as chunks finish out of order: (done_order, chunk, last_key).

    At each finish all chunks up to some number are complete; a row says which, and the last key among those that
    this finish completed.  Empty chunks (null key) count as complete, but a finish that completes only such gives no row.
    The table has a row per chunk, not per row of data.
    """
    upto = Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gapless = F.count("*").over(upto) == F.col(chunk)
    ready = done.withColumn("_gapless", gapless).withColumn("_ready", F.max(at).over(upto)).filter("_gapless")
    keyed = F.when(F.col(last).isNotNull(), F.col(chunk))
    out = ready.groupBy(F.col("_ready").alias(at)).agg(F.max(chunk).alias(chunk), F.max_by(last, keyed).alias(last))
    return out.filter(F.col(last).isNotNull())


def progress(finished: Column, total: Column) -> Column:
    """Percent, a whole number of at most 100."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(finished * 100 / total))).otherwise(0).cast("long")


def read_chunks(spark, path: str, key: str, chunks: Iterable[Chunk]) -> list[DataFrame]:
    """One frame per chunk of a Parquet table, its bounds pushed down to the row groups."""
    return [spark.read.parquet(path).filter(c.condition(F.col(key))) for c in chunks]
