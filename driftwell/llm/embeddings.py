"""Near-duplicate vectors by cross-polytope hashing.

A hash function is three rounds of random signs and a fast Hadamard transform; its value is the
index and sign of the largest coordinate.  ``k`` functions make a bucket number, ``tables`` of them an index.  Each vector
stands in its own bucket and, per table, in ``PROBES`` more: those where its least certain function takes the second-largest
coordinate.  Vectors that share a bucket are candidates.  ``k`` follows the number of vectors, so a bucket's expected load stays below one;
``tables`` follows from the measured chance that a pair at the threshold meets in one table, for a recall of ``RECALL``.  A threshold
that ``MOST_TABLES`` tables can't serve is refused.

Equal vectors are one class and enter once, by a number.  Only numbers stand in buckets.  Where a bucket has several, the signs of 64 random
projections rule out pairs that are far apart (six standard deviations beyond the threshold's angle), and each pair left is compared in one bucket
only, the fullest that both are in.  Such buckets are sent the vectors, each with the list of its partners there: candidates are never rows, and
a vector travels about once.  Cosines are taken in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths do not link; a null id takes part and names a component only if it has no other; rows that repeat an id
are judged each for itself; an empty table gives an empty table; input columns named like a result (in any case) are replaced, all others
come back whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import meetings
from .common import components, lowest_reachable, mix, positional, stash

PROBES = 3
RECALL = 0.995
MOST_TABLES = 60


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform along the last axis, whose length is a power of two."""
    n = x.shape[-1]
    h = 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


class Hasher:
    """Buckets of unit vectors of one length."""

    def __init__(self, dim: int, k: int, tables: int, seed: int = 5):
        self.dim, self.k, self.tables = dim, k, tables
        self.wide = 1 << max(1, (dim - 1).bit_length())
        self.probes = min(PROBES, k)
        self.signs = np.random.default_rng(seed + dim).choice([-1.0, 1.0], (tables * k, 3, self.wide))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes) bucket numbers, the vector's own first."""
        n, k = len(x), self.k
        wide = np.zeros((n, self.wide))
        wide[:, : self.dim] = x
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        place = (2 * self.wide) ** np.arange(k, dtype=np.int64)
        for t in range(self.tables):
            first, second, gap = (np.empty((n, k), kind) for kind in (np.int64, np.int64, np.float64))
            for f in range(k):
                y = wide
                for r in range(3):
                    y = hadamard(y * self.signs[t * k + f, r])
                size = np.abs(y)
                if self.wide == 1:
                    best = other = np.zeros((n, 1), np.int64)
                else:
                    top = np.argpartition(-size, 1, axis=1)[:, :2]
                    swap = np.take_along_axis(size, top[:, :1], 1) < np.take_along_axis(size, top[:, 1:], 1)
                    best, other = np.where(swap, top[:, 1:], top[:, :1]), np.where(swap, top[:, :1], top[:, 1:])
                code = lambda i, y=y: (2 * i + (np.take_along_axis(y, i, 1) < 0))[:, 0]
                first[:, f], second[:, f] = code(best), code(other)
                gap[:, f] = (np.take_along_axis(size, best, 1) - np.take_along_axis(size, other, 1))[:, 0]
            own = first @ place
            out[:, t, 0] = own
            least = np.argsort(gap, axis=1, kind="stable")
            for p in range(self.probes):
                f = least[:, p : p + 1]
                out[:, t, 1 + p] = own + ((np.take_along_axis(second, f, 1) - np.take_along_axis(first, f, 1)) * place[f])[:, 0]
        return out


@lru_cache(maxsize=8)
def hasher(dim: int, k: int, tables: int) -> Hasher:
    return Hasher(dim, k, tables)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs of code rows share a bucket, by table."""
    return (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3))


@lru_cache(maxsize=32)
def shape_of(dim: int, n: int, cosine: float) -> tuple[int, int]:
    """(k, tables) for ``n`` vectors of a length: the largest k up to what n asks for that reaches the recall within ``MOST_TABLES``."""
    wide = 1 << max(1, (dim - 1).bit_length())
    per = np.log2(2 * wide)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(y, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * y / np.where(length > 0, length, 1)
    for k in range(int(np.clip(np.ceil((np.log2(max(n, 2)) + 3) / per), 1, 60 // per)), 0, -1):
        h = Hasher(dim, k, 1)
        rate = float(np.clip(_meet(h(x), h(y)).mean(), 1e-9, 0.999))
        tables = max(2, int(np.ceil(np.log(1 - RECALL) / np.log(1 - rate))))
        if tables <= MOST_TABLES:
            return k, tables
    raise ValueError(f"a cosine of {cosine} at {dim} dimensions needs {tables} tables for a recall of {RECALL}: more than {MOST_TABLES}")


def signs(x: np.ndarray) -> np.ndarray:
    """64 bits of unit vectors: on which side of random planes they lie."""
    planes = np.random.default_rng(77 + x.shape[1]).normal(size=(x.shape[1], 64))
    return np.packbits(x @ planes > 0, axis=1, bitorder="little").view(np.int64)[:, 0]


def sign_distance(cosine: float) -> int:
    """Bits in which two vectors at a cosine differ at most: the mean and six standard deviations."""
    share = float(np.arccos(np.clip(cosine, -1, 1))) / np.pi
    return min(64, int(np.ceil(64 * share + 6 * np.sqrt(64 * share * (1 - share)))))


def _unit(values) -> np.ndarray | None:
    """The vector at length one, or None if it cannot link."""
    if values is None or not len(values) or values.null_count:
        return None
    x = np.asarray(values.to_numpy(zero_copy_only=False), np.float64)
    if not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.linalg.norm(x) + 0.0


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vectors`` without the vector, with n_links, component_id, kept."""
    made = ["n_links", "component_id", "kept"]
    given = positional(vectors, made, [vector_col])
    src = given.frame.select(given.row(), given[id_col].alias("_id"), given[vector_col].cast("array<double>").alias("_v"))
    schema = src.select("_row", "_id").schema.add("_key", "binary").add("_dim", "integer").add("_unit", "binary")

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [_unit(x.values) if x.is_valid else None for x in batch.column(2)]
            raw = [None if u is None else u.astype("<f8").tobytes() for u in units]
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(keys, pa.binary()), pa.array([None if u is None else len(u) for u in units], pa.int32()), pa.array(raw, pa.binary())],
                names=["_row", "_id", "_key", "_dim", "_unit"],
            )

    rows = stash(src.mapInArrow(normal, schema), "vectors")
    classes = rows.filter("_key IS NOT NULL").groupBy("_key").agg(F.min("_id").alias("low"), F.count("*").alias("n"), F.min("_dim").alias("dim"), F.min("_unit").alias("unit"))
    classes = stash(classes.withColumn("key", F.monotonically_increasing_id()), "vector-classes")
    # a row per length of vectors
    shapes = {r["dim"]: shape_of(r["dim"], r["n"], cosine) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}

    def each_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, numbers, unit vectors) of the rows (key, dim, unit), in parts."""
        dims = batch.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            for at in range(0, part.num_rows, 2048):
                some = part.slice(at, 2048)
                yield dim, some.column(0).to_numpy(), np.frombuffer(b"".join(some.column(2).to_pylist()), "<f8").reshape(-1, dim)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, keys, x in each_length(batch):
                codes = hasher(dim, *shapes[dim])(x)
                place = np.uint64(xxhash.xxh64_intdigest(f"{dim}")) + np.arange(codes.shape[1], dtype=np.uint64)[:, None]
                names = mix(mix(place)[None] ^ codes.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(names.reshape(-1).view(np.int64)), pa.array(np.repeat(keys, codes[0].size))], names=["x", "key"])

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, (x, key) in meetings.whole_runs(batches):
            size = np.diff(edges)
            many = np.repeat(size > 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(x[many]), pa.array(key[many]), pa.array(np.repeat(size, size)[many])], names=["x", "key", "load"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, x in each_length(batch):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(signs(x))], names=["key", "sketch"])

    units = classes.select("key", "dim", "unit")
    spots = units.mapInArrow(buckets, "x long, key long").repartition("x").sortWithinPartitions("x").mapInArrow(crowded, "x long, key long, load long")
    spots = stash(spots, "vector-spots")
    sketches = stash(units.mapInArrow(sketched, "key long, sketch long"), "vector-signs")
    members = spots.join(sketches.hint("merge"), "key").withColumn("class", F.col("key"))
    most = sign_distance(cosine)

    def may_link(values: list[np.ndarray], p: slice, q: slice) -> np.ndarray:
        bits = values[0].view(np.uint64)
        return np.bitwise_count(bits[p, None] ^ bits[q]) <= most

    asked = meetings.partners(members, ["sketch"], may_link)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, table in meetings.runs_of_rows(batches):
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = table.slice(lo, hi - lo)
                keys, n = part.column(1).to_numpy(), part.column(3).to_numpy()
                raw, place = part.column(4).to_pylist(), {k: i for i, k in enumerate(keys.tolist())}
                links, a, b = np.zeros(len(keys), np.int64), [], []
                for i, mine in enumerate(part.column(2).to_pylist()):
                    some = [j for j in map(place.__getitem__, mine) if len(raw[j]) == len(raw[i])]
                    if not some:
                        continue
                    others = np.frombuffer(b"".join([raw[j] for j in some]), "<f8").reshape(len(some), -1)
                    near = np.array(some)[others @ np.frombuffer(raw[i], "<f8") >= cosine]
                    links[i] += n[near].sum()
                    links[near] += n[i]
                    a += [i] * len(near)
                    b += near.tolist()
                low = lowest_reachable(len(keys), np.array(a, np.int64), np.array(b, np.int64))
                found = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(keys[found]), pa.array(links[found]), pa.array(keys[low[found]])], names=["key", "links", "to"])

    sent = asked.join(classes.select("key", "n", "unit").hint("merge"), "key").select("g", "key", "partners", "n", "unit")
    found = stash(sent.repartition("g").sortWithinPartitions("g").mapInArrow(compared, "key long, links long, to long"), "vector-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("key").alias("a"), F.col("to").alias("b")))
    of = classes.select("_key", "key", "low", "n").join(comp.select(F.col("node").alias("key"), "component").hint("merge"), "key", "left")
    of = stash(of.join(links.hint("merge"), "key", "left").withColumn("component", F.coalesce("component", "key")), "vector-components")
    # written before it is joined: adaptive execution then splits a large component
    lowest = stash(of.groupBy("component").agg(F.min("low").alias("component_id")), "vector-lowest")
    of = stash(of.join(lowest.hint("merge"), "component").select("_key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "vector-results")
    out = rows.select("_row", "_id", "_key").join(of.hint("merge"), "_key", "left")
    component = F.when(F.col("_key").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return given.back(out, F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
