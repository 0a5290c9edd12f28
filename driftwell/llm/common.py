"""What several operators of this subpackage share.

* ``stash``: cut lineage by writing a table in the shared checkpoint folder.
* ``pack``: turn documents into *chunks*, rows that hold about ``CHUNK_BYTES`` of
  whole documents as a compressed Arrow stream.  Later passes shuffle chunks, not
  documents, and one chunk is what a Python worker holds at a time.
* ``components``: connected components without a collected edge.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 6 << 20
#: The words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder; on a cluster, where executors would write what others can't read, it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="driftwell-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: a lost executor costs no earlier stage.

    The tables stay there, as later actions on a result read them; the folder is the session's to clear, like that of any checkpoint.
    """
    spark, schema = df.sparkSession, df.schema
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    del df  # the last reference, if the caller keeps none: its shuffle files can go
    release(spark)
    return spark.read.schema(schema).parquet(at)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class positional:  # noqa: N801 - used like a function
    """A caller's frame with its columns known by place, so that none of their names can clash with ours.

    ``frame`` has the columns c0, c1, ...; ``row()`` is one struct of those to be given back: all but ``without`` and those named like a result
    in ``made`` (in any case), which the result replaces.  ``back`` turns the struct into columns of the old names again.
    """

    def __init__(self, docs: DataFrame, made: tuple[str, ...] | list[str] = (), without: tuple[str, ...] | list[str] = ()):
        self.names, replaced = docs.columns, {m.lower() for m in made}
        self.frame = docs.toDF(*[f"c{n}" for n in range(len(self.names))])
        gone = {self.place(c) for c in without}
        self.kept = [n for n, c in enumerate(self.names) if n not in gone and c.lower() not in replaced]

    def place(self, name: str) -> int:
        if name in self.names:
            return self.names.index(name)
        alike = [n for n, c in enumerate(self.names) if c.lower() == name.lower()]
        if len(alike) != 1:
            raise ValueError(f"no column {name}")
        return alike[0]

    def __getitem__(self, name: str) -> Column:
        return F.col(f"c{self.place(name)}")

    def row(self) -> Column:
        return F.struct(*([F.col(f"c{n}") for n in self.kept] or [F.lit(None).cast("boolean").alias("none")])).alias("_row")

    def inside(self, name: str) -> Column:
        """A column of the struct."""
        return F.col("_row")[f"c{self.place(name)}"]

    def back(self, df: DataFrame, *made: Column | str) -> DataFrame:
        return df.select(*[F.col("_row")[f"c{n}"].alias(self.names[n]) for n in self.kept], *made)


# ---------------------------------------------------------------- chunks


def ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def pack(df: DataFrame, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows ``chunk, n_rows, n_bytes, data``, written to the shared folder; no shuffle.

    A chunk closes with the document that takes it to ``chunk_bytes``.  Its number
    is made from the task and a counter and is fixed once the table is written.
    """
    names = df.columns
    if text_col not in names:
        raise ValueError(f"no column {text_col}")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = n = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_pydict(
                {"chunk": pa.array([base + n], pa.int64()), "n_rows": pa.array([table.num_rows], pa.int64()),
                 "n_bytes": pa.array([size], pa.int64()), "data": pa.array([ipc(table)], pa.binary())})

        for batch in batches:
            lens = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0), dtype=np.int64)
            start, ends = 0, np.cumsum(lens)
            done = 0
            while start < batch.num_rows:
                stop = min(int(np.searchsorted(ends, done + chunk_bytes - size)) + 1, batch.num_rows)
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - done
                done, start = int(ends[stop - 1]), stop
                if size >= chunk_bytes:
                    yield flush()
                    held, size, n = [], 0, n + 1
        if held:
            yield flush()

    plain = df.select(*[F.col(sql_name(c)).cast("binary").alias(c) if c == text_col else F.col(sql_name(c)) for c in names])
    return stash(plain.mapInArrow(run, "chunk long, n_rows long, n_bytes long, data binary"), "chunks")


# ---------------------------------------------------------------- words


class WordHash:
    """64-bit hashes of words through a bounded cache; ``second`` gives independent ones."""

    LIMIT = 1 << 20

    def __init__(self, second: bool = False):
        self.seen: dict[bytes, int] = {}
        self.of = (lambda w: xxhash.xxh3_64_intdigest(w, 77)) if second else xxhash.xxh3_64_intdigest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.LIMIT:
            seen.clear()
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            of = self.of
            for w in set(words):
                if w not in seen:
                    seen[w] = of(w)
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# ---------------------------------------------------------------- components


#: Edges that a task joins at once before the steps over the whole table.
JOINED_EDGES = 1 << 20


def lowest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of range(n), the smallest number reachable over the links (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        both = np.minimum(low[a], low[b])
        np.minimum.at(new, a, both)
        np.minimum.at(new, b, both)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v) as stars around the smallest node, as far as the rows of one task show it; connects what ``edges`` connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def star() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            of = pa.concat_arrays([*table.column(0).chunks, *table.column(1).chunks]).dictionary_encode()
            order = pa.compute.sort_indices(of.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            ends = rank[of.indices.to_numpy()]
            low = lowest_reachable(len(rank), ends[: table.num_rows], ends[table.num_rows :])
            leaves = np.flatnonzero(low != np.arange(len(low)))
            nodes = of.dictionary.take(order)
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(leaves)), nodes.take(pa.array(low[leaves]))], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * JOINED_EDGES:
                yield star()
                held, size = [], 0
        if size:
            yield star()

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    Tasks of ``JOINED_EDGES`` edges first join what they hold.  Then large-star and small-star steps in turn, until every node has one edge, to
    a node that has none: each step keeps at most a row per edge, takes the minimum of a node's neighbours with a map-side combine, and is
    written to the shared folder; the driver sees two counts per round.  The minima are written before they are joined: then both
    sides of the join are plain shuffles, and adaptive execution splits the rows of a node with very many neighbours.
    """
    start = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    start = stash(start.distinct(), "edges")
    parts = 1 + start.count() // JOINED_EDGES
    cur = stash(_stars(start.coalesce(parts)), "edges")

    def lowest(sym: DataFrame) -> DataFrame:
        return stash(sym.groupBy("u").agg(F.min("v").alias("m")), "lowest")

    def settled() -> bool:
        if parts == 1:
            return True  # one task has seen every edge
        if not cur.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return False
        return cur.select("u").join(cur.select(F.col("v").alias("u")).distinct().hint("merge"), "u", "left_semi").isEmpty()

    for _ in range(max_rounds):
        if settled():
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stash(large, "edges")
        small = large.join(lowest(large).hint("merge"), "u")
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        cur = stash(_stars(small).distinct(), "edges")
    raise RuntimeError("components did not settle")
