"""How rows are dealt out: by key, by table, evenly, or by plans over chunk sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame, n: int, column: str) -> DataFrame:
    """Rows of a key meet in one partition; with adaptive execution on, Spark may join small ones."""
    return df.repartition(n, column)


def by_table(df: DataFrame, schema: str = "schema", table: str = "tb") -> DataFrame:
    return df.repartition(schema, table)


def evenly(df: DataFrame, n: int) -> DataFrame:
    """Equal shares whatever the keys."""
    return df.repartition(n)


def serially(df: DataFrame, *order: str) -> DataFrame:
    """All rows in one task, in an order: for targets that take nothing else.  Everything before it stays parallel."""
    return df.repartition(1).sortWithinPartitions(*order)


def key_bucket(df: DataFrame, n: int, column: str, name: str = "bucket") -> DataFrame:
    """The bucket of a key, the same in any engine: from its MD5."""
    return df.withColumn(name, F.pmod(F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n)))


@dataclass(frozen=True)
class Group:
    """Rows of one chunk of one table, in the order in which chunks were first seen."""

    table: str
    chunk: int
    rows: int
    size: int


@dataclass(frozen=True)
class Part:
    """Rows ``start`` to ``end`` of a group (``table_*`` strategies: of a run of neighbouring chunks)."""

    table: str
    chunk: int
    start: int
    end: int
    size: int

    @property
    def rows(self) -> int:
        return self.end - self.start


@dataclass(frozen=True)
class Rebalance:
    strategy: str = "none"  # none, chunk_largest_first, auto_split, table_min_rows, table_even
    cost: str = "rows"  # rows, bytes
    min_rows: int = 1
    skew_ratio: float = 2.0
    most_per_worker: int = 4


def _aligned(count: int, unit: int, least: int, most: int) -> int:
    """The multiple of ``unit`` nearest to ``count`` within the bounds, the lower one on a tie; ``count`` clipped if there is none."""
    down = count // unit * unit
    options = [x for x in (down, down + unit) if least <= x <= most]
    return min(options, key=lambda x: (abs(x - count), x)) if options else max(least, min(count, most))


def _halved(part: Part, cost: str, unit: int) -> tuple[Part, Part] | None:
    """Two parts near half the rows (or, with equal-sized rows assumed, half the bytes), each of ``unit`` rows at least."""
    if part.rows < 2 * unit or part.rows < 2:
        return None
    left = _aligned((part.rows + 1) // 2, unit, unit, part.rows - unit)
    size = part.size * left // part.rows
    cut = part.start + left
    return replace(part, end=cut, size=size), replace(part, start=cut, size=part.size - size)


def _cost(part: Part, cost: str) -> tuple[int, int]:
    return (part.size, part.rows) if cost == "bytes" else (part.rows, part.rows)


def _auto_split(parts: list[Part], workers: int, rule: Rebalance) -> list[Part]:
    """The largest part is halved until there is work for all and none of it stands out."""
    rows = sum(p.rows for p in parts)
    most = max(workers, min(max(1, rows // max(1, rule.min_rows)), workers * rule.most_per_worker))
    weight = lambda p: max(p.size, p.rows) if rule.cost == "bytes" else p.rows
    fair = max(sum(map(weight, parts)) // workers, rule.min_rows)
    while len(parts) < most:
        open_parts = [k for k, p in enumerate(parts) if p.rows >= 2 * max(1, rule.min_rows)]
        if not open_parts:
            break
        k = max(open_parts, key=lambda i: (_cost(parts[i], rule.cost), i))
        if len(parts) >= workers and weight(parts[k]) <= fair * rule.skew_ratio:
            break
        halves = _halved(parts[k], rule.cost, max(1, rule.min_rows))
        if not halves:
            break
        parts[k] = halves[0]
        parts.append(halves[1])
    return parts


def _table_runs(groups: Sequence[Group]) -> list[Part]:
    """Neighbouring chunks of a table as one."""
    runs: list[list[Group]] = []
    for g in sorted(groups, key=lambda g: (g.table, g.chunk)):
        if runs and runs[-1][-1].table == g.table and g.chunk - runs[-1][-1].chunk <= 1:
            runs[-1].append(g)
        else:
            runs.append([g])
    return [Part(r[0].table, r[0].chunk, 0, sum(g.rows for g in r), sum(g.size for g in r)) for r in runs]


def plan_parts(groups: Sequence[Group], workers: int, rule: Rebalance) -> list[Part]:
    """Parts of the groups for ``workers``; splitting never changes a row's chunk.

    It works on sizes, a row per chunk, on the driver; adaptive execution serves the same purpose within Spark's own shuffles.
    """
    parts = [Part(g.table, g.chunk, 0, g.rows, g.size) for g in groups]
    if workers <= 1:
        return parts
    if rule.strategy == "chunk_largest_first":
        return sorted(parts, key=lambda p: _cost(p, rule.cost), reverse=True)
    if rule.strategy == "auto_split":
        return sorted(_auto_split(parts, workers, rule), key=lambda p: _cost(p, rule.cost), reverse=True)
    if rule.strategy == "table_min_rows":
        step = max(1, rule.min_rows)
        return [replace(p, start=a, end=min(a + step, p.rows)) for p in _table_runs(groups) for a in range(0, p.rows, step)]
    if rule.strategy == "table_even":
        unit, out = max(1, rule.min_rows), []
        for p in sorted(_table_runs(groups), key=lambda p: -p.rows):
            if p.rows < workers * unit:
                out.append(p)
                continue
            start, n = 0, min(workers, p.rows)
            for left in range(n, 0, -1):
                rest = p.rows - start
                size = rest if left == 1 else _aligned(-(-rest // left), unit, 1, rest - (left - 1))
                out.append(replace(p, start=start, end=start + size))
                start += size
        return out
    if rule.strategy == "none":
        return parts
    raise ValueError(rule.strategy)


def group_sizes(rows: DataFrame, table: str = "tb", chunk: str = "chunk", size: str | None = None) -> DataFrame:
    """A row per chunk: rows and bytes."""
    return rows.groupBy(table, chunk).agg(F.count("*").alias("rows"), (F.sum(size) if size else F.lit(0)).cast("long").alias("bytes"))


def even_parts(sizes: DataFrame, workers: int, min_rows: int, table: str = "tb") -> DataFrame:
    """``table_even`` as a frame: tables large enough for all workers are cut into that many parts, each cut at a multiple of ``min_rows`` near an even share."""
    unit, rows = max(1, min_rows), F.col("rows")
    whole = rows.cast("long")

    def cut(at, left):
        rest = whole - at["start"]
        share, most = F.ceil(rest / left).cast("long"), rest - (left - 1)
        down = share - share % unit
        fits = lambda x: (x >= 1) & (x <= most)
        near = F.when(fits(down) & (~fits(down + unit) | (share - down <= down + unit - share)), down).when(fits(down + unit), down + unit).otherwise(F.greatest(F.lit(1), F.least(share, most)))
        size = F.when(left == 1, rest).otherwise(near)
        return F.struct((at["start"] + size).cast("long").alias("start"), F.concat(at["cuts"], F.array((at["start"] + size).cast("long"))).alias("cuts"))

    start = F.struct(F.lit(0).cast("long").alias("start"), F.array(F.lit(0).cast("long")).alias("cuts"))
    many = F.aggregate(F.sequence(F.lit(workers), F.lit(1), F.lit(-1)), start, cut)["cuts"]
    cuts = F.when(whole >= workers * unit, many).otherwise(F.array(F.lit(0).cast("long"), whole))
    out = sizes.withColumn("_cuts", cuts).withColumn("part", F.explode(F.sequence(F.lit(1), F.size("_cuts") - 1)))
    bound = lambda k: F.get("_cuts", k)
    place = F.row_number().over(Window.orderBy(F.desc("rows"), table, "part")).cast("long")
    return out.select(table, F.col("part").cast("long").alias("part"), bound(F.col("part") - 1).alias("start_row"), bound(F.col("part")).alias("end_row"), place.alias("place"))


def to_groups(rows: Sequence[Mapping]) -> list[Group]:
    return [Group(r["tb"], r["chunk"], r["rows"], r["bytes"]) for r in rows]
