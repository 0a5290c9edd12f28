"""Best-fit packing under conflicts.

A bin holds ``capacity`` words.  It takes no two documents of one source and none two of one duplicate cluster.
Documents longer than a bin are cut; full pieces fill a bin each, the rest is packed.  Pieces go from
long to short into the bin with the least room that still fits them and does not conflict, else into a new bin.

In a shard the bins stand by residual.  Three integers used as bitmaps find the bin: residuals in use, and
for each source (and cluster) the residuals at which every bin has it.  The lowest set bit from the piece's length
upward, of those in use and not blocked, is the next residual to look at; each bin carries a bitmap of its sources
and of its clusters, and the search goes to the successor until a compatible bin is found.

Duplicate clusters are the classes of linked fingerprints (``simhash``) by default.

Pieces are dealt to shards by a hash of id, length and cluster, rows that agree on these by their place as well; a shard's size is about
``SHARD_PIECES`` whatever the input, so the work is linear in it and a hot source, cluster or repeated row is spread evenly.  Only lengths
and keys are shuffled.

Defined results: a null or blank text has no words and gets one empty piece, which needs no room but keeps the rules;
a null source or cluster conflicts with nothing; rows that repeat an id and text are of one cluster and so never share a bin, full pieces included;
ties go to the smaller id, null last, then the bin opened first; a very long text gives as many full pieces as it fills; other columns of the
input, whatever their names, are neither read nor returned; an empty table gives an empty table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import WORD_GAP, positional, stash

CAPACITY = 2048
SHARD_PIECES = 4000
_GAP_CHARS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_GAP_CHARS))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, WORD_GAP))).otherwise(0)


class Shelf:
    """The open bins of a shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0
        self.having: tuple[dict, dict] = ({}, {})
        self.blocked: tuple[dict, dict] = ({}, {})

    def _count(self, which: int, key: int, residual: int, step: int) -> None:
        row = self.having[which].setdefault(key, {})
        row[residual] = row.get(residual, 0) + step

    def _refresh(self, residual: int, masks: tuple[int, int]) -> None:
        """Blocked bits of the keys in ``masks`` at a residual."""
        n = len(self.at[residual])
        for which, mask in enumerate(masks):
            while mask:
                key = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                old = self.blocked[which].get(key, 0)
                all_have = n > 0 and self.having[which].get(key, {}).get(residual, 0) == n
                self.blocked[which][key] = old | 1 << residual if all_have else old & ~(1 << residual)

    def _place(self, b: int, residual: int) -> None:
        """Put bin b at a residual; blocked bits of keys that b lacks go there."""
        for which, masks in enumerate((self.sources, self.clusters)):
            mask = masks[b]
            lacking = [k for k, bits in self.blocked[which].items() if bits >> residual & 1 and not mask >> k & 1] if self.at[residual] else []
            for k in lacking:
                self.blocked[which][k] &= ~(1 << residual)
            m = mask
            while m:
                self._count(which, (m & -m).bit_length() - 1, residual, 1)
                m &= m - 1
        self.at[residual].append(b)
        self.used |= 1 << residual
        self.room[b] = residual
        self._refresh(residual, (self.sources[b], self.clusters[b]))

    def _take(self, b: int) -> None:
        residual = self.room[b]
        self.at[residual].remove(b)
        if not self.at[residual]:
            self.used &= ~(1 << residual)
        for which, masks in enumerate((self.sources, self.clusters)):
            m = masks[b]
            while m:
                self._count(which, (m & -m).bit_length() - 1, residual, -1)
                m &= m - 1
        # what the rest share may now block the residual
        rest = self.at[residual]
        if rest:
            first = rest[0]
            self._refresh(residual, (self.sources[first] | self.sources[b], self.clusters[first] | self.clusters[b]))
        else:
            self._refresh(residual, (self.sources[b], self.clusters[b]))

    def put(self, size: int, source: int | None, cluster: int | None) -> int:
        """The bin that took a piece of ``size``."""
        s = 1 << source if source is not None else 0
        c = 1 << cluster if cluster is not None else 0
        free = self.used & ~self.blocked[0].get(source, 0) & ~self.blocked[1].get(cluster, 0)
        free = free >> size << size
        found = -1
        while free and found < 0:
            residual = (free & -free).bit_length() - 1
            for b in self.at[residual]:
                if not self.sources[b] & s and not self.clusters[b] & c:
                    found = b
                    break
            free &= free - 1
        if found < 0:
            found = len(self.room)
            self.room.append(self.capacity - size)
            self.sources.append(s)
            self.clusters.append(c)
            self._place(found, self.capacity - size)
            return found
        self._take(found)
        self.sources[found] |= s
        self.clusters[found] |= c
        self._place(found, self.room[found] - size)
        return found


def _numbered(values: list) -> list[int | None]:
    seen: dict = {}
    return [None if v is None else seen.setdefault(v, len(seen)) for v in values]


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of each piece; the pieces come in the order in which they are placed."""
    shelf = Shelf(capacity)
    # a cluster with one piece here cannot conflict
    times: dict = {}
    for c in clusters:
        times[c] = times.get(c, 0) + 1
    of = _numbered([c if c is not None and times[c] > 1 else None for c in clusters])
    return [shelf.put(n, s, c) for n, s, c in zip(sizes, _numbered(sources), of, strict=True)]


def clustered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``_id, _source, _n, _class`` of each row: its words and its near-duplicate class; texts are read once."""
    rows = positional(docs)
    src = rows.frame.select(rows[id_col].alias("_id"), rows[source_col].cast("string").alias("_source"), word_count(rows[text_col]).cast("long").alias("_n"), rows[text_col].alias("_text"))
    hashed = stash(simhash.fingerprints(src, "_text"), "packing-fingerprints")
    return simhash.classes(hashed, "_id", keep_class=True).select("_id", "_source", "_n", "_class")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: the id, source, piece, first_word, n_words, shard, bin.

    ``cluster_col``: a column with the duplicate cluster; by default the near-duplicate class of ``clustered``.  (shard, bin) names a bin;
    a piece that fills a bin by itself has bin -1 - piece and a negative shard of its row's own.
    """
    if cluster_col is None:
        rows = clustered(docs, id_col, text_col, source_col).withColumnRenamed("_class", "_cluster")
    else:
        of = positional(docs)
        cluster = of[cluster_col]
        kind = of.frame.schema[f"c{of.place(cluster_col)}"].dataType.typeName()
        number = cluster.cast("long") if kind in ("byte", "short", "integer", "long") else F.when(cluster.isNotNull(), F.xxhash64(cluster))
        rows = of.frame.select(of[id_col].alias("_id"), of[source_col].cast("string").alias("_source"), word_count(of[text_col]).cast("long").alias("_n"), number.alias("_cluster"))
    rows = stash(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_h", F.xxhash64("_id", "_n", "_cluster")), "packing-rows")
    repeats = stash(rows.groupBy("_h").agg(F.count("*").alias("_times")).filter("_times > 1"), "packing-repeats")
    rows = rows.join(repeats.hint("merge"), "_h", "left")
    shards = max(1, -(-rows.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("_h", F.when(F.col("_times").isNotNull(), F.col("_at")).otherwise(0)), F.lit(shards)).alias("shard")
    whole = (F.col("_n") / capacity).cast("long")
    pieces = F.when((F.col("_n") % capacity > 0) | (F.col("_n") == 0), F.sequence(F.lit(0).cast("long"), whole)).otherwise(F.sequence(F.lit(0).cast("long"), whole - 1))
    each = rows.select("_id", "_source", "_n", "_cluster", "_at", shard, F.explode(pieces).alias("piece")).withColumn("n_words", F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity))
    each = each.withColumn("first_word", F.col("piece") * capacity)
    full = each.filter(F.col("n_words") == capacity).select("_id", "_source", "piece", "first_word", "n_words", (-1 - F.col("_at")).alias("shard"), (-1 - F.col("piece")).alias("bin"))
    part = each.filter(F.col("n_words") < capacity).select("shard", "_id", "_source", "_cluster", "_at", "piece", "first_word", "n_words")
    schema = part.select("_id", "_source", "piece", "first_word", "n_words", "shard").schema.add("bin", "long")

    def fill(table: pa.Table) -> pa.Table:
        # nulls come last
        order = pa.compute.sort_indices(table, sort_keys=[("n_words", "descending"), ("_id", "ascending"), ("_at", "ascending"), ("piece", "ascending")])
        table = table.take(order)
        bins = pack_shard(table.column("n_words").to_pylist(), table.column("_source").to_pylist(), table.column("_cluster").to_pylist(), capacity)
        return table.select(["_id", "_source", "piece", "first_word", "n_words", "shard"]).append_column("bin", pa.array(bins, pa.int64()))

    filled = part.groupBy("shard").applyInArrow(fill, schema)
    return full.union(filled.select(*full.columns)).select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "piece", "first_word", "n_words", "shard", "bin")
