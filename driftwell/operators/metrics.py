"""Statistics of a task: per-second rates in a window, response times, totals, progress.

All values are whole numbers; divisions drop the fraction, and seconds without samples do not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.floor(a / b)).otherwise(0).cast("long")


def per_second(samples: DataFrame, by: Sequence[str] = (), ts: str = "ts", value: str = "value") -> DataFrame:
    """The sum of each second that has samples."""
    second = F.date_trunc("second", F.col(ts))
    return samples.groupBy(*by, second.alias("second")).agg(F.sum(value).cast("long").alias("total"), F.count("*").alias("n"), F.max(value).alias("largest"), F.min(value).alias("least"))


def window_statistics(samples: DataFrame, by: Sequence[str] = (), window: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Per group (and window, e.g. ``1 hour``): sum, count, max, min, avg by sample, and max, min, avg by second.

    Two aggregations; the first leaves at most a row per second and group.
    """
    seconds = per_second(samples, by, ts, value)
    keys: list = [*by]
    if window:
        seconds = seconds.withColumn("window_start", F.window("second", window).start)
        keys.append("window_start")
    out = seconds.groupBy(*keys).agg(
        F.sum("total").alias("sum"), F.sum("n").alias("count"), F.max("largest").cast("long").alias("max"), F.min("least").cast("long").alias("min"),
        F.max("total").alias("max_by_sec"), F.min("total").alias("min_by_sec"), F.count("*").alias("seconds"),
    )
    return out.withColumns({"avg": _whole(F.col("sum"), F.col("count")), "avg_by_sec": _whole(F.col("sum"), F.col("seconds"))}).drop("seconds")


def over_members(statistics: DataFrame, by: Sequence[str], how: dict[str, str]) -> DataFrame:
    """Statistics of several members of a component as one: ``how`` maps a column to min, max, add, avg or latest (by ``at``)."""
    of = {"min": F.min, "max": F.max, "add": F.sum, "avg": lambda c: F.floor(F.avg(c)), "latest": lambda c: F.max_by(c, "at")}
    return statistics.groupBy(*by).agg(*[of[k](c).cast("long").alias(c) for c, k in how.items()])


def streamed_rates(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "1 second", by: Sequence[str] = ()) -> DataFrame:
    """Rows per second of a stream, with a watermark for late ones."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"))
