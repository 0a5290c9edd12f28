"""SimHash near-duplicates by pigeonhole blocks.

``fingerprints``: 64 bits by majority over the XXH64 hashes of the word shingles.
``link_classes``: fingerprints that differ in at most two bits, found through blocks.

Two fingerprints within two bits agree on at least two of four 16-bit blocks, so every such
pair shares one of six 32-bit keys.  Only distinct fingerprints enter, so exact copies cost one row.
In a key's group of at most ``GROUP`` fingerprints the pairs are joined and their distance verified.
In a larger group pairs would grow with its square; there each member also stands under itself and its
32 one-bit flips outside the shared blocks.  Two members differ in at most two bits exactly if they
meet under such a flip (each is then within one bit of it), so linking each meeting to its smallest
member loses no component and adds none.

Defined results: null, empty and blank texts have fingerprint 0 and are linked with each other; a null doc_id
takes part, but is never the name of a component unless it has no other; repeated rows are one class;
ties cannot occur (the smallest id is unique); very long texts are hashed whole; columns named like a result (in any case) are replaced, all
others come back whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, positional, stash

BLOCKS, BITS = 4, 16
GROUP = 32


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit b is set if more than half of the shingles' hashes have it; repeats count."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxh64_intdigest, joined, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` without the text, with ``fp`` (long, the 64 bits)."""
    rows = positional(docs, ["fp"], [text_col])
    src = rows.frame.select(rows.row(), rows[text_col].cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["_row", "fp"])

    return rows.back(src.mapInArrow(run, src.select("_row").schema.add("fp", "long")), "fp")


def _keys(fps: DataFrame) -> DataFrame:
    """(fp, pair, key, rest): the six pairs of agreeing blocks, the shared 32 bits and the other 32."""
    made = []
    for n, (a, b) in enumerate(combinations(range(BLOCKS), 2)):
        c, d = (x for x in range(BLOCKS) if x not in (a, b))
        part = lambda x: f"(shiftrightunsigned(fp, {x * BITS}) & 65535L)"
        two = lambda x, y: f"(shiftleft({part(x)}, {BITS}) | {part(y)})"
        made.append(f"named_struct('pair', {n}, 'key', {two(a, b)}, 'rest', {two(c, d)})")
    return fps.select("fp", F.explode(F.expr(f"array({', '.join(made)})")).alias("k")).select("fp", "k.*")


def link_classes(fps: DataFrame) -> DataFrame:
    """``(fp, class)`` for the distinct fingerprints that have a partner; class is the smallest linked one (as a signed number)."""
    keys = stash(_keys(fps), "simhash-keys")
    groups = keys.groupBy("pair", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stash(keys.join(groups.hint("merge"), ["pair", "key"]), "simhash-shared")
    few = shared.filter(F.col("n") <= GROUP).select("pair", "key", "rest", "fp")
    other = few.select("pair", "key", F.col("rest").alias("rest2"), F.col("fp").alias("b"))
    near = few.join(other.hint("merge"), ["pair", "key"]).filter("fp < b AND bit_count(rest ^ rest2) <= 2").select(F.col("fp").alias("a"), "b")
    many = shared.filter(F.col("n") > GROUP)
    flips = F.expr("concat(array(rest), transform(sequence(0, 31), i -> rest ^ shiftleft(1L, i)))")
    stars = many.select("fp", "pair", "key", F.explode(flips).alias("meet"))
    centre = stars.groupBy("pair", "key", "meet").agg(F.min("fp").alias("low"), F.count("*").alias("m")).filter("m > 1").drop("m")
    star = stars.join(centre.hint("merge"), ["pair", "key", "meet"]).filter("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return components(near.union(star)).select(F.col("node").alias("fp"), F.col("component").alias("class"))


def classes(hashed: DataFrame, id_col: str = "doc_id", keep_class: bool = False) -> DataFrame:
    """``hashed`` (with ``fp``) and ``component_id``, the smallest id reachable through links.

    Classes may share a ``component_id`` (null or repeated ids); ``_class``, the smallest linked fingerprint, tells them apart if asked for.
    """
    made = ["component_id", *["_class"][: int(keep_class)]]
    rows = positional(hashed, made)
    src = rows.frame.select(rows.row(), rows[id_col].alias("_id"), rows["fp"].alias("_fp"))
    first = stash(src.groupBy("_fp").agg(F.min("_id").alias("_low")), "simhash-first")
    linked = link_classes(first.select(F.col("_fp").alias("fp"))).withColumnRenamed("fp", "_fp")
    of = stash(first.join(linked.hint("merge"), "_fp", "left").select("_fp", "_low", F.coalesce("class", "_fp").alias("_class")), "simhash-classes")
    # written before they are joined: adaptive execution then splits a large class
    lowest = stash(of.groupBy("_class").agg(F.min("_low").alias("component_id")), "simhash-lowest")
    of = stash(of.join(lowest.hint("merge"), "_class").select("_fp", *made), "simhash-components")
    return rows.back(src.join(of.hint("merge"), "_fp"), *made)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without the text, with ``fp`` and ``component_id``; columns of these names are replaced."""
    return classes(stash(fingerprints(docs, text_col, shingle), "simhash"), id_col)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id, with the columns of ``docs``.

    Rows that repeat the smallest id (or all lack one) are told apart by their place in the written table.
    """
    rows = positional(docs)
    held = stash(rows.frame.select(F.monotonically_increasing_id().alias("_at"), rows.row(), rows[id_col].alias("_id"), rows[text_col].alias("_text")), "simhash-rows")
    of = classes(stash(fingerprints(held.select("_id", "_at", "_text"), "_text", shingle), "simhash"), "_id", keep_class=True)
    first = F.struct(F.col("_id").isNull().alias("n"), F.col("_id"), F.col("_at"))
    kept = of.groupBy("_class").agg(F.min(first).alias("k")).select(F.col("k._at").alias("_at"))
    return rows.back(held.join(kept.hint("merge"), "_at", "left_semi"))
