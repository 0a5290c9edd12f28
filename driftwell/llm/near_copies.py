"""SimHash near-dedup at a similarity: near copies whose sets of word shingles have a Jaccard similarity of at least 4/5.

Fingerprints find the first candidates, by pigeonhole: two that differ in at most ``blocks - 2`` bits agree on two of the blocks, so they meet in
one of the buckets of each two blocks.  ``blocks_for`` takes as many blocks as leave about ``BUCKET`` sets by chance in a bucket (12 up to a million
sets: all pairs within 10 bits meet).  Each set and the ``SMALL`` nearest before it that it meets, within ``NEAR`` bits, are compared by whole
sets and joined to classes.

Two texts at 4/5 differ in about 10 of 64 fingerprint bits, and in up to 20; blocks short enough to be shared by all of them are shared by
everything.  So the pairs that no bucket brings together, or that a large group leaves untried, are found by the texts' rarest shingles, for which
the pigeonhole holds at any similarity of 4/5 or more; what the fingerprints have connected is not compared again.

``prefix``: shingles stand in one order for all texts, the frequent ones of a sample last.  Two sets of similarity 4/5 share at least
4/5 of the larger one, so they meet in a shingle among the first n // 5 + 1 of each; the order decides only how many others meet there.
Of the sets that meet, pairs whose sizes or fingerprints rule out 4/5 go; the rest is compared by whole sets.  ``DISTANCE`` is five standard
deviations above the mean for a pair at 4/5: about one such pair in a million is lost.

A meeting of more than ``SMALL`` sets does not give all its pairs: first each set and the nearest before it are compared; when these have
been joined to classes, each set outside a meeting's largest class and the nearest in other classes, for ``TURNS`` turns; at last all pairs
that are still across classes.  Those are never rows: a meeting that has some is sent the sets, each with the list of its partners there, and a pair is
compared in one meeting only, the most frequented that both sets are in.  So a group of copies costs rows in proportion to its members.

Shingles are their 64-bit hashes (XXH64, as the fingerprints have them); equal sets are one node, named by a hash of the set.

Defined results: words as in ``simhash``; null, empty and blank texts have no shingles and are one class; a text of at most ``shingle`` words is one shingle;
rows that repeat an id are judged each for itself; a null id is kept only where the class has no other; very long texts are compared whole;
columns of any name come back as they were; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from . import meetings
from .common import components, positional, stash

SMALL = 8
BLOCK = 2048
#: Sets that share a bucket by chance, at most about so many; the most blocks of a fingerprint; the bits that those who meet may differ in.  Two
#: unlike fingerprints are within ``NEAR`` bits once in 270,000 times.
BUCKET, MOST_BLOCKS, NEAR = 1024, 12, 14
TURNS, EACH_TURN = 1, 4
#: Bits of 64: 9.7 on average at 4/5, with a deviation of 2.9.  Sets of fewer than ``SHORT`` shingles vary more and are always compared.
DISTANCE, SHORT = 25, 32
#: Documents counted for the order of the shingles, from how many of them on a shingle is frequent, and so many at most.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 20_000, 4, 200_000
#: Bits of a sieve: for each row that it is made of, and at most (4 MB).
SIEVE_BITS, MOST_SIEVE = 16, 1 << 25


def shingle_set(text: bytes | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of the shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, joined, repeat(seed)), np.uint64, len(words) - shingle + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_key(hashes: np.ndarray) -> int:
    return _signed(xxh3_64_intdigest(hashes.tobytes()))


def set_fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if more than half of the distinct shingles have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a similarity of at least 4/5."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def _may_link(sizes: tuple[np.ndarray, np.ndarray], fps: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(whether size and fingerprint allow a link, the distance) of the sets of two arrays, by broadcasting."""
    low, high = np.minimum(*sizes), np.maximum(*sizes)
    far = np.bitwise_count(fps[0] ^ fps[1])
    return (5 * low >= 4 * high) & ((far <= DISTANCE) | (low < SHORT)), far


def may_meet(values: list[np.ndarray], p: slice, q: slice) -> np.ndarray:
    sizes, fps = values[0], values[1].view(np.uint64)
    return _may_link((sizes[p, None], sizes[q]), (fps[p, None], fps[q]))[0]


def nearest(keys: np.ndarray, sizes: np.ndarray, fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
    """(a, b, whether these are all) for the sets of one meeting: all pairs of a small one, else each set with the nearest before it."""
    keys, at = np.unique(keys, return_index=True)
    sizes, fps = sizes[at], fps[at]
    if len(keys) <= SMALL:
        ok, _ = _may_link((sizes[:, None], sizes), (fps[:, None], fps))
        i, j = np.nonzero(np.triu(ok, 1))
        return [keys[i]], [keys[j]], True
    a, b = [], []
    for start in range(0, len(keys), BLOCK):
        # a block starts with the last set of the one before, so that blocks hang together
        part = slice(max(0, start - 1), start + BLOCK)
        k, n, f = keys[part], sizes[part], fps[part]
        ok, far = _may_link((n[:, None], n), (f[:, None], f))
        far = np.where(np.tril(ok, -1), far, 255)
        best = far.argmin(axis=1)
        hit = np.flatnonzero(far[np.arange(len(k)), best] < 255)
        a.append(k[best[hit]])
        b.append(k[hit])
    return a, b, False


def nearest_across(keys: np.ndarray, sizes: np.ndarray, fps: np.ndarray, classes: np.ndarray, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each set outside the largest class of one meeting, the next ``EACH_TURN`` nearest sets of other classes."""
    keys, at = np.unique(keys, return_index=True)
    sizes, fps, classes = sizes[at], fps[at], classes[at]
    names, count = np.unique(classes, return_counts=True)
    if len(names) < 2:
        return
    asking = classes != names[count.argmax()]
    for start in range(0, len(keys), BLOCK):
        q = slice(start, start + BLOCK)
        p = np.flatnonzero(asking[q]) + start
        last = min((turn + 1) * EACH_TURN, len(keys[q]))
        if not len(p) or last <= turn * EACH_TURN:
            continue
        ok, far = _may_link((sizes[p, None], sizes[q]), (fps[p, None], fps[q]))
        far = np.where(ok & (classes[p, None] != classes[q]), far, 255)
        order = np.argsort(far, axis=1, kind="stable")[:, turn * EACH_TURN : last]
        i, j = np.nonzero(np.take_along_axis(far, order, 1) < 255)
        if len(i):
            one, two = keys[p[i]], keys[q][order[i, j]]
            yield np.minimum(one, two), np.maximum(one, two)


def blocks_for(n_sets: int) -> int:
    """How many blocks a fingerprint is cut into: the more, the wider the radius and the larger the buckets."""
    return next((m for m in range(MOST_BLOCKS, 4, -1) if n_sets <= BUCKET << 2 * (64 // m)), 4)


def near_in_bucket(keys: np.ndarray, sizes: np.ndarray, fps: np.ndarray, earlier: Sequence[int] = ()) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(a, b), a < b, of the sets of one bucket, sorted by key, within ``NEAR`` bits: all pairs, or in a crowd each set with the nearest before it.

    ``earlier`` are the bits of blocks; pairs that agree on one of them also meet in a bucket before this one and are left to that.
    """
    a, b = [], []
    for start in range(0, len(keys), BLOCK):
        # a block starts with the last set of the one before, so that blocks hang together
        part = slice(max(0, start - 1), start + BLOCK)
        k, n, f = keys[part], sizes[part], fps[part]
        far = np.bitwise_count(f[:, None] ^ f)
        i, j = np.nonzero(far <= NEAR)
        ok = j < i
        i, j = i[ok], j[ok]
        ok = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
        i, j = i[ok], j[ok]
        if len(i) > SMALL * len(k):
            order = np.lexsort((j, far[i, j], i))
            i, j = i[order], j[order]
            first = np.r_[True, i[1:] != i[:-1]]
            i, j = i[first], j[first]
        differ = f[i] ^ f[j]
        ours = np.ones(len(i), bool)
        for bits in earlier:
            ours &= (differ & np.uint64(bits)) != 0
        a.append(k[j[ours]])
        b.append(k[i[ours]])
    return a, b


def near_by_blocks(sets: DataFrame, blocks: int) -> DataFrame:
    """Pairs (a, b) of ``sets(key, n, fp)`` that agree on two of the blocks of their fingerprints and differ in at most ``NEAR`` bits, written.

    Of each b the ``SMALL`` nearest that its buckets give, so the pairs grow in proportion to the sets; the meetings in shingles look at the others.
    """
    ends = [64 * k // blocks for k in range(blocks + 1)]
    part = lambda k: f"(shiftrightunsigned(fp, {ends[k]}) & {(1 << ends[k + 1] - ends[k]) - 1}L)"
    two = list(combinations(range(blocks), 2))
    names = [f"{n << 32}L | shiftleft({part(i)}, 16) | {part(j)}" for n, (i, j) in enumerate(two)]
    bits = [(1 << ends[k + 1]) - (1 << ends[k]) for k in range(blocks)]
    # a pair is given only by the bucket of the first two blocks that it agrees on
    earlier = [[bits[k] for k in range(j) if k != i] for i, j in two]
    rows = sets.filter("n > 0").select(F.explode(F.expr(f"array({', '.join(names)})")).alias("x"), "key", "n", "fp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, (x, key, n, fp) in meetings.whole_runs(batches):
            n, fp = n.astype(np.int64), fp.view(np.uint64)
            a, b, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
            for k in np.flatnonzero(np.diff(edges) > 1):
                run = slice(int(edges[k]), int(edges[k + 1]))
                of, prints = key[run], fp[run]
                for p, q in zip(*near_in_bucket(of, n[run], prints, earlier[int(x[run.start]) >> 32]), strict=True):
                    a.append(p)
                    b.append(q)
                    far.append(np.bitwise_count(prints[np.searchsorted(of, p)] ^ prints[np.searchsorted(of, q)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)] + [pa.array(np.concatenate(far).astype(np.int32))], names=["a", "b", "far"])

    met = rows.repartition("x").sortWithinPartitions("x", "key").mapInArrow(meet, "a long, b long, far int")
    ranked = met.withColumn("turn", F.row_number().over(Window.partitionBy("b").orderBy("far", "a")))
    return stash(ranked.filter(F.col("turn") <= SMALL).select("a", "b"), "near-copies-blocks")


def links_of(keys: list[int], sets: list[np.ndarray], partners: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Similar pairs of each set and its partners, without pairs that those found before connect."""
    place = {k: n for n, k in enumerate(keys)}
    names, of = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(x) for x in sets])
    parts = np.split(of, ends[:-1])
    flags, top = np.zeros(len(names), np.int32), list(range(len(keys)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, mine in enumerate(partners):
        left = [b for b in map(place.__getitem__, mine) if find(b) != find(a)]
        if not left:
            continue
        flags[parts[a]] = 1
        sizes = np.array([len(parts[b]) for b in left])
        shared = np.add.reduceat(flags[np.concatenate([parts[b] for b in left])], np.r_[0, np.cumsum(sizes)[:-1]])
        flags[parts[a]] = 0
        for n in np.flatnonzero(5 * shared >= 4 * (sizes + len(parts[a]) - shared)).tolist():
            one, two = find(a), find(left[n])
            if one != two:
                top[max(one, two)] = min(one, two)
                yield keys[a], keys[left[n]]


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles of a sample of (_at, _text), sorted, and their counts: they order the shingles and decide nothing else."""
    share = min(1.0, SAMPLE_DOCS / max(1, texts.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle).view(np.int64))], names=["x"])

    some = texts.filter(F.pmod(F.xxhash64("_at"), F.lit(1_000_000)) < int(share * 1_000_000)).select("_text")
    counts = some.mapInArrow(run, "x long").groupBy("x").agg(F.count("*").alias("c")).filter(F.col("c") >= FREQUENT)
    got = counts.orderBy(F.desc("c"), "x").limit(MOST_FREQUENT).toArrow()
    x, c = got.column("x").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(x)
    return x[order], c[order]


def prefix(hashes: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones before frequent ones."""
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[: len(hashes) // 5 + 1]


def _marked(held: DataFrame, shingle: int) -> DataFrame:
    """``held`` (_at, _row, _id, _text) with its set's _key, _n, _fp and _first, written."""
    known, counts = _frequent(held.select("_at", "_text"), shingle)
    schema = held.drop("_text").schema.add("_key", "long").add("_n", "integer").add("_fp", "long").add("_first", T.ArrayType(T.LongType()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, fps, firsts = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                hashes = shingle_set(text.as_py(), shingle)
                keys.append(set_key(hashes))
                sizes.append(len(hashes))
                fps.append(set_fingerprint(hashes))
                firsts.append(prefix(hashes, known, counts).view(np.int64) if len(hashes) else [])
            made = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "_key", "_n", "_fp", "_first"])

    return stash(held.mapInArrow(mark, schema), "near-copies")


def sifted(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` whose _at may be in ``asked(_at)``, found without a shuffle: all that are, and a few others, which the caller's join takes out.

    The sieve has a bit for each hash of an _at.  It goes to every task and is of bounded size; an ``asked`` too long for it lets more others through.
    """
    bits = min(MOST_SIEVE, max(1 << 15, 1 << (SIEVE_BITS * asked.count()).bit_length()))
    slot = F.pmod(F.xxhash64("_at"), F.lit(bits)) + 1
    sieve = asked.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits"))
    held = rows.withColumn("_slot", slot).withColumn("_part", F.bitmap_bucket_number("_slot")).withColumn("_slot", F.bitmap_bit_position("_slot").cast("int"))
    byte = F.conv(F.hex(F.expr("substring(_bits, shiftright(_slot, 3) + 1, 1)")), 16, 10).cast("int")
    there = F.expr("shiftleft(1, _slot & 7)").bitwiseAND(byte) != 0
    return held.join(F.broadcast(sieve), "_part").filter(there).select(*rows.columns)


def picked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` whose _at is in ``asked(_at)``, which has no _at twice: then an inner join does, as a semi join would be moved below the sieve."""
    return sifted(rows, asked).join(asked.hint("merge"), "_at")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that are similar; ``texts(key, text)`` has a text of each set."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, one = a, shingle_set(x.as_py(), shingle)
                keep.append(similar(one, shingle_set(y.as_py(), shingle)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
    both = first.join(texts.select(F.col("key").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
    return stash(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "near-copies-links")


def link_classes(marked: DataFrame, text: Column, shingle: int = 5) -> DataFrame:
    """``(key, class)`` for the sets of ``marked`` that have a partner; class is the smallest key reachable.  ``text`` is a column of it."""
    # one row of each set; places are distinct, so no task gets all copies of a text
    one = stash(marked.groupBy("_key").agg(F.min("_at").alias("_at")).select("_at"), "near-copies-sets")
    sets = marked.select("_at", "_key", "_n", "_fp", "_first").join(one.hint("merge"), "_at", "left_semi")
    source = marked.select("_at", F.col("_key").alias("key"), text.alias("text"))

    def texts(of: DataFrame) -> DataFrame:
        asked = of.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        rows = stash(marked.select("_at", F.col("_key").alias("key")).join(one.hint("merge"), "_at", "left_semi").join(asked.hint("merge"), "key", "left_semi").select("_at"), "near-copies-asked")
        return picked(source, rows).select("key", "text")

    tried = near_by_blocks(sets.select(F.col("_key").alias("key"), F.col("_n").alias("n"), F.col("_fp").alias("fp")), blocks_for(one.count()))
    found = _verified(tried, texts(tried), shingle)

    def apart(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that have not been compared and that no links connect yet."""
        known = stash(components(found), "near-copies-known")
        for end in ("a", "b"):
            of = known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
            pairs = pairs.join(of.hint("merge"), end, "left")
        return pairs.filter("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b").join(tried.hint("merge"), ["a", "b"], "left_anti")

    rows = sets.select(F.explode("_first").alias("x"), F.col("_key").alias("key"), F.col("_n").alias("n"), F.col("_fp").alias("fp"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, (x, key, n, fp) in meetings.whole_runs(batches):
            size = np.diff(edges)
            n, fp = n.astype(np.int64), fp.view(np.uint64)
            i = edges[:-1][size == 2]
            ok, _ = _may_link((n[i], n[i + 1]), (fp[i], fp[i + 1]))
            i = i[ok & (key[i] != key[i + 1])]
            a, b, more = [np.minimum(key[i], key[i + 1])], [np.maximum(key[i], key[i + 1])], []
            load = [np.empty(0, np.int64)]
            for k in np.flatnonzero(size > 2):
                run = slice(int(edges[k]), int(edges[k + 1]))
                p, q, whole = nearest(key[run], n[run], fp[run])
                a += p
                b += q
                if not whole:
                    more.append(np.arange(run.start, run.stop))
                    load.append(np.full(run.stop - run.start, run.stop - run.start))
            a, b = np.concatenate(a), np.concatenate(b)
            left = np.concatenate(more) if more else np.empty(0, np.int64)
            none = lambda like: np.zeros(len(a), like)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[none(bool), np.ones(len(left), bool)]), pa.array(np.r_[a, x[left]]), pa.array(np.r_[b, key[left]]), pa.array(np.r_[none(np.int32), n[left].astype(np.int32)]), pa.array(np.r_[none(np.int64), fp[left].view(np.int64)]), pa.array(np.r_[none(np.int64), *load])],
                names=["more", "a", "b", "n", "fp", "load"],
            )

    met = rows.repartition("x").sortWithinPartitions("x").mapInArrow(meet, "more boolean, a long, b long, n int, fp long, load long").distinct()
    met = stash(met, "near-copies-met")
    pairs = met.filter("NOT more").select("a", "b")
    rest = met.filter("more").select(F.col("a").alias("x"), F.col("b").alias("key"), "n", "fp", "load")
    if not pairs.isEmpty():
        pairs = stash(apart(pairs), "near-copies-pairs")
        found, tried = found.unionByName(_verified(pairs, texts(pairs), shingle)), tried.unionByName(pairs)
    if rest.isEmpty():
        return components(found).select(F.col("node").alias("key"), F.col("component").alias("class"))

    def classed() -> DataFrame:
        """The large meetings that still have several classes."""
        known = components(found).select(F.col("node").alias("key"), F.col("component").alias("class"))
        rows = rest.join(known.hint("merge"), "key", "left").select("x", "key", "n", "fp", "load", F.coalesce("class", "key").alias("class"))
        several = rows.groupBy("x").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("x")
        several = stash(several, "near-copies-several")  # so that adaptive execution splits a meeting of very many
        return stash(rows.join(several.hint("merge"), "x", "left_semi"), "near-copies-open")

    def next_nearest(turn: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for edges, (_, key, n, fp, of) in meetings.whole_runs(batches):
                n, fp = n.astype(np.int64), fp.view(np.uint64)
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    for a, b in nearest_across(key[lo:hi], n[lo:hi], fp[lo:hi], of[lo:hi], turn):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        rows = classed().select("x", "key", "n", "fp", "class").repartition("x").sortWithinPartitions("x")
        return stash(rows.mapInArrow(run, "a long, b long").distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"), "near-copies-across")

    for turn in range(TURNS):
        more = next_nearest(turn)
        if not more.isEmpty():
            found, tried = found.unionByName(_verified(more, texts(more), shingle)), tried.unionByName(more)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, rows in meetings.runs_of_rows(batches):
            keys, partners = rows.column(1).to_pylist(), rows.column(2).to_pylist()
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                sets = [shingle_set(t.as_py(), shingle) for t in rows.column(3)[lo:hi]]
                links = list(links_of(keys[lo:hi], sets, partners[lo:hi]))
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    asked = meetings.partners(classed().withColumn("n", F.col("n").cast("long")), ["n", "fp"], may_meet)
    if not asked.isEmpty():
        of = texts(asked.select(F.col("key").alias("a"), F.col("key").alias("b")))
        both = asked.join(of.hint("merge"), "key").select("g", "key", "partners", "text")
        found = found.unionByName(stash(both.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "a long, b long"), "near-copies-links"))
    return components(found).select(F.col("node").alias("key"), F.col("component").alias("class"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row of each class of near copies, the one with the smallest id, with the columns of ``docs``.

    Rows that repeat the smallest id (or all lack one) are told apart by their place in the written table.
    """
    rows = positional(docs)
    held = rows.frame.select(F.monotonically_increasing_id().alias("_at"), rows.row(), rows[id_col].alias("_id"), rows[text_col].cast("binary").alias("_text"))
    marked = _marked(held, shingle)
    classes = link_classes(marked, rows.inside(text_col).cast("binary"), shingle)
    of = marked.select("_at", "_key", "_id").join(classes.withColumnRenamed("key", "_key").hint("merge"), "_key", "left")
    first = F.struct(F.col("_id").isNull().alias("n"), F.col("_id"), F.col("_at"))
    kept = of.groupBy(F.coalesce("class", "_key").alias("class")).agg(F.min(first).alias("k")).select(F.col("k._at").alias("_at"))
    return rows.back(marked.join(kept.hint("merge"), "_at", "left_semi"))
