"""Sets that meet in named places: who has to be compared with whom, and where.

A place may have very many members, and two members may meet in very many places.  Pairs are never rows: a place lists, for each member, its
partners there, and a pair is listed in one place only, the most frequented that both are in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Members of a place are compared in blocks of so many, and listed by pairs of blocks.
PART = 512


def runs_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(edges, rows) of rows sorted by the first column, cut so that no run of equal values is split."""
    held: list[pa.RecordBatch] = []

    def cut() -> tuple[np.ndarray, pa.Table]:
        table = pa.Table.from_batches(held).combine_chunks()
        x = table.column(0).to_numpy()
        return np.r_[0, np.flatnonzero(np.diff(x)) + 1, len(x)], table

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and held[0].column(0)[-1].as_py() == batch.column(0)[batch.num_rows - 1].as_py():
            continue  # still inside the run that was carried over
        edges, table = cut()
        last = int(edges[-2])
        if last:
            yield edges[:-1], table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield cut()


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The same with the columns as arrays."""
    for edges, table in runs_of_rows(batches):
        yield edges, [c.to_numpy() for c in table.columns]


def across(keys: np.ndarray, classes: np.ndarray, values: list[np.ndarray], may_link: Callable, meetings: Callable[[int], Iterable[int]], here: int, part: int = PART) -> Iterator[tuple[int, int, list[int], list[list[int]]]]:
    """(block, block, keys, partners of each) of one place's pairs of different classes that ``may_link``.

    ``may_link(values, p, q)``: a matrix for two slices of the members.  ``meetings`` gives the names of the places of a member, the most
    frequented first; ``here`` is this one, and pairs that meet in an earlier one of both lists are left to that.
    """
    keys, at = np.unique(keys, return_index=True)
    classes, values = classes[at], [v[at] for v in values]
    if (classes == classes[0]).all():
        return
    blocks = range(0, len(keys), part)
    found = []
    for i in blocks:
        for j in (j for j in blocks if j >= i):
            p, q = slice(i, i + part), slice(j, j + part)
            one, two = np.nonzero(may_link(values, p, q) & (classes[p, None] != classes[q]) & (keys[p, None] < keys[q]))
            if len(one):
                found.append((i, j, one + i, two + j))
    if not found:
        return
    # the meetings before this one, numbered; a pair that shares one of them is not ours
    names: dict[int, int] = {}
    involved = np.unique(np.concatenate([x for f in found for x in f[2:]]))
    before = []
    for k in involved:
        mine = []
        for m in meetings(int(at[k])):
            if m == here:
                break
            mine.append(names.setdefault(m, len(names)))
        before.append(mine)
    bits = np.zeros((len(keys), -(-max(1, len(names)) // 64)), np.uint64)
    for k, mine in zip(involved, before, strict=True):
        for n in mine:
            bits[k, n >> 6] |= np.uint64(1 << (n & 63))
    for i, j, one, two in found:
        own = np.ones(len(one), bool)
        for w in range(bits.shape[1]):
            own &= (bits[one, w] & bits[two, w]) == 0
        partners: dict[int, list[int]] = {}
        for a, b in zip(keys[one[own]].tolist(), keys[two[own]].tolist(), strict=True):
            partners.setdefault(a, []).append(b)
            partners.setdefault(b, [])
        if partners:
            yield i, j, list(partners), list(partners.values())


def partners(rows: DataFrame, columns: Sequence[str], may_link: Callable, part: int | None = None) -> DataFrame:
    """``(g, key, partners)`` for the members ``rows`` (x, key, class, load and ``columns``) of places x: the groups to be compared, and in each the keys that take part.

    A key's list of places is as long as its number of places, which the caller bounds.
    """
    part = PART if part is None else part
    places = F.sort_array(F.collect_list(F.struct((-F.col("load")).alias("load"), "x")))
    met = rows.groupBy("key").agg(F.transform(places, lambda m: m["x"]).alias("met"))
    wide = rows.join(stash(met, "meetings").hint("merge"), "key").select("x", "key", "class", "met", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, table in runs_of_rows(batches):
            x, key, of = (table.column(c).to_numpy() for c in range(3))
            values = [table.column(c).to_numpy() for c in range(4, table.num_columns)]
            all_met = table.column(3).combine_chunks()
            starts, names = all_met.offsets.to_numpy(), all_met.values.to_numpy()
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                met = lambda k, lo=lo: names[starts[lo + k] : starts[lo + k + 1]].tolist()
                for i, j, keys, lists in across(key[lo:hi], of[lo:hi], [v[lo:hi] for v in values], may_link, met, int(x[lo]), part):
                    group = np.uint64(xxhash.xxh64_intdigest(np.array([x[lo], i, j], np.int64).tobytes())).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([group] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["g", "key", "partners"])

    return stash(wide.repartition("x").sortWithinPartitions("x").mapInArrow(run, "g long, key long, partners array<bigint>"), "partners")
