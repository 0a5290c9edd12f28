"""Rates: so many rows or bytes a second, at the source or at the sink.

A source is held back by what one micro-batch may take in (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) and how often there is one; a sink by
waiting after a batch until its rows and bytes fit the rate.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_batch(rows_per_second: int, every_seconds: float) -> int:
    """Rows that a micro-batch may take in to keep a rate, one at least."""
    return max(1, int(rows_per_second * every_seconds))


def limited(write: Callable[[DataFrame, int], None], rows_per_second: float | None = None, bytes_per_second: float | None = None, size: str | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
    """``write`` for ``foreachBatch``, followed by a wait if the batch went faster than the rates allow.

    ``size``: SQL for a row's bytes; without it a row's JSON text is measured.
    """

    def run(batch: DataFrame, number: int) -> None:
        began = clock()
        held = batch.persist()
        try:
            write(held, number)
            bytes_of = F.sum(F.expr(size) if size else F.octet_length(F.to_json(F.struct(*held.columns)))) if bytes_per_second else F.lit(0)
            rows, volume = held.agg(F.count("*"), bytes_of).first()
        finally:
            held.unpersist()
        least = max(rows / rows_per_second if rows_per_second else 0.0, (volume or 0) / bytes_per_second if bytes_per_second else 0.0)
        if (left := least - (clock() - began)) > 0:
            sleep(left)

    return run
