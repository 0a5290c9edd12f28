"""Keys that a continuous check has found wrong and not yet found right.

The state of a key is its last finding; a later one replaces it, and ``same`` clears it, so state holds unresolved keys only.
Of findings with one ``seq``, as where a side holds two rows of a key, one that isn't ``same`` counts, the last by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..meta import TableMeta
from ..operators import check

OUT = "key string, kind string, seq long"
STATE = "kind string, seq long"


def _rank(kind: str) -> tuple:
    return kind != "same", kind


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kind, seq = state.get if state.exists else (None, -1)
    before = (kind, seq)
    for rows in batches:
        newest = rows[rows["seq"] == rows["seq"].max()]
        at, found = int(newest["seq"].iloc[0]), max(map(str, newest["kind"]), key=_rank)
        if at > seq or at == seq and kind is not None and _rank(found) > _rank(kind):
            kind, seq = found, at
    if kind in (None, "same"):
        if state.exists:
            state.remove()
    else:
        state.update((kind, seq))
    if (kind, seq) != before:
        yield pd.DataFrame({"key": [key[0]], "kind": [kind], "seq": [seq]})


def follow(findings: DataFrame) -> DataFrame:
    """From a stream of (key, kind, seq): each change of a key's state; ``same`` says it is cleared."""
    return findings.groupBy("key").applyInPandasWithState(_follow, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def key_text(meta: TableMeta) -> Column:
    """A row's key as the state names it: one JSON object."""
    return F.to_json(F.struct(*meta.id_cols), {"ignoreNullFields": "false"})


def rechecked(state: DataFrame, src: DataFrame, dst: DataFrame, meta: TableMeta, seq: int) -> DataFrame:
    """What a restart adds to the state: each unresolved key looked up again on both sides, with its finding as of ``seq``.

    ``state``: (key, kind, seq) with keys as ``key_text`` writes them; a key that is right by now, or that no side has, is ``same`` and so cleared.
    """
    kinds = F.lit(", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in meta.id_cols))
    keys = state.select(F.from_json("key", kinds).alias("k")).select("k.*")
    found = check.recheck(keys, src, dst, meta)
    kind = F.when(F.col("outcome") == "clear", "same").otherwise(F.col("outcome"))
    return found.select(key_text(meta).alias("key"), kind.alias("kind"), F.lit(seq).cast("long").alias("seq"))


def current(changes: DataFrame) -> DataFrame:
    """The unresolved keys, from all changes of state so far."""
    last = changes.groupBy("key").agg(F.max(F.struct("seq", F.col("kind") != "same", "kind")).alias("s")).select("key", "s.kind", "s.seq")
    return last.filter("kind <> 'same' AND seq IS NOT NULL")
