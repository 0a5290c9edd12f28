"""Substring dedup by difference-cover anchors.

A window is ``WINDOW`` words.  Positions of a document count modulo ``PERIOD``; anchors are
the hashes of the shorter windows that start at positions in ``COVER``.  COVER is a perfect difference set:
for any two positions some shift below PERIOD takes both into it.  So two equal windows, wherever they start,
contain an equal anchor at the same offset: WINDOW = anchor length + PERIOD - 1.  Three in seven positions are hashed.

Passes over packed chunks of documents (``exchange``):
1. anchors, as sorted keys; the answer is which of them two documents share (a bit each);
2. windows that hold a shared anchor are extended to 13 words and hashed to 96 bits; the answer is which of
   them start in a smaller document elsewhere (a bit each);
3. the words those windows cover go.

Keys of one chunk are made distinct before they travel, so a passage that a third of all documents
share is one key per chunk.  All windows are judged on the input.  Ids are compared as numbers if they are whole numbers, else as texts, by
their place among the table's distinct ids.

Defined results: null and blank texts have no words; a null id is smaller than nothing and nothing is
smaller than it, so its words stay; rows that repeat an id are judged each for itself against smaller ids; very long texts are one chunk and
judged whole; columns named like a result (in any case) are replaced, all others come back whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import WordHash, mix, multipliers, pack, positional, release, stash, unpack

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
_A = multipliers(ANCHOR, 11)
_W = multipliers(WINDOW, 12)
_X = multipliers(WINDOW, 13)
#: Stands for a null id, which is smaller than no other.
_NO_ID = np.int64(2**63 - 1)
#: Text whose keys make a range.
BUCKET_BYTES = 12 << 20


def _sums(h: np.ndarray, m: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for k in range(len(m)):
        out += h[starts + k] * m[k]
    return mix(out)


class _Chunk:
    """The words of a chunk's documents, end to end, and its anchors in the order of their keys."""

    def __init__(self, table: pa.Table):
        self.ids = np.asarray(table.column("rank").fill_null(_NO_ID).to_numpy(), np.int64)
        self.nameless = np.asarray(table.column("rank").is_null().to_numpy(), bool)
        self.words = [x.as_py().split() if x.is_valid else [] for x in table.column("text")]
        n = np.array([len(w) for w in self.words], np.int64)
        self.n, self.first = n, np.concatenate([[0], np.cumsum(n)])
        one = WordHash()
        self.h = np.concatenate([one(w) for w in self.words]) if len(n) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(len(self.h)) - self.first[:-1][self.doc] if len(self.h) else np.zeros(0, np.int64)
        self.left = n[self.doc] - self.at if len(self.h) else self.at

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, distinct keys sorted, the key's number for each start)"""
        starts = np.flatnonzero((self.left >= ANCHOR) & np.isin(self.at % PERIOD, COVER) & (self.n[self.doc] >= WINDOW)) if len(self.h) else self.at
        keys, which = np.unique(_sums(self.h, _A, starts), return_inverse=True)
        return starts, keys, which

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows that hold a shared anchor, and their two hashes."""
        if not len(shared):
            return shared, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        edge = np.zeros(len(self.h) + 1, np.int32)
        np.add.at(edge, np.maximum(shared - (PERIOD - 1), self.first[self.doc[shared]]), 1)
        np.add.at(edge, shared + 1, -1)
        starts = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= WINDOW))
        return starts, _sums(self.h, _W, starts), _sums(mix(self.h), _X, starts)

    def distinct(self, hi: np.ndarray, lo: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows in order: keys, smallest id, and each start's number."""
        return WINDOWS.merge([(window_keys(hi, (lo >> np.uint64(32)).astype(np.uint32)), self.ids[self.doc[starts]])])


class Anchors(exchange.Flags):
    """Which keys two documents share; a value says whether two of one chunk do."""

    def pack(self, keys, values, width, kind):
        keys = exchange.pack_keys(keys, width)
        return len(keys).to_bytes(4, "little") + keys + np.packbits(values).tobytes()

    def unpack(self, data, width, kind):
        n = int.from_bytes(data[:4], "little")
        keys = exchange.unpack_keys(data[4 : 4 + n], width)
        return keys, np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + n), count=len(keys)).astype(bool)

    def merge(self, parts):
        keys, place = exchange.merged_keys(parts)
        twice = np.bincount(place, minlength=len(keys)) > 1
        twice[place[np.concatenate([v for _, v in parts])]] = True
        return keys, twice, place

    def whole(self, values):
        return values


class Windows(exchange.Flags):
    """Which windows start in a smaller document than any of the chunk's; a key is two hashes, a value the smallest document."""

    def pack(self, keys, values, width, kind):
        return len(keys).to_bytes(4, "little") + exchange.small(keys["hi"].tobytes() + keys["lo"].tobytes() + values.astype("<i8").tobytes())

    def unpack(self, data, width, kind):
        n, raw = int.from_bytes(data[:4], "little"), exchange.plain(data[4:])
        return window_keys(np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n)), np.frombuffer(raw, "<i8", n, 12 * n)

    def cut(self, keys, values, bits):
        for at, s in exchange.ranges(keys["hi"], bits):
            yield at, window_keys(exchange.inner(keys["hi"][s], bits), keys["lo"][s]), values[s]

    def merge(self, parts):
        keys, low = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((low, keys["lo"], keys["hi"]))
        sorted_keys = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_keys["hi"][1:] != sorted_keys["hi"][:-1]) | (sorted_keys["lo"][1:] != sorted_keys["lo"][:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return sorted_keys[new], low[order][new], place

    def whole(self, values):
        return np.zeros(len(values), bool)

    def answer(self, merged, answers, place, values):
        return answers[place] | (merged[place] < values)


def window_keys(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    out = np.empty(len(hi), [("hi", "<u8"), ("lo", "<u4")])
    out["hi"], out["lo"] = hi, lo
    return out


def _rows(kinds: list[tuple[int, bytes]], chunk: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in kinds], pa.int64()), pa.array([chunk] * len(kinds), pa.int64()), pa.array([d for _, d in kinds], pa.binary())], names=["range", "member", "data"])


def _same_doc_max(keys_n: int, which: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each key stands in documents of two ids of the chunk."""
    low, high = np.full(keys_n, _NO_ID), np.full(keys_n, np.iinfo(np.int64).min)
    np.minimum.at(low, which, ids)
    np.maximum.at(high, which, ids)
    return low < high


ANCHORS, WINDOWS = Anchors(), Windows()


def _ranked(rows: positional, id_col: str) -> DataFrame:
    """``rows`` with ``rank``: a long in the order of the ids, null for a null one."""
    kind = rows.frame.schema[f"c{rows.place(id_col)}"].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return rows.frame.withColumn("rank", rows[id_col].cast("long"))
    # sorted ranges of ids; a rank is the range's number and the place in it
    ids = rows.frame.select(rows[id_col].alias("id")).filter("id IS NOT NULL").distinct().repartitionByRange("id").sortWithinPartitions("id")
    ranks = stash(ids.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return rows.frame.join(ranks.hint("merge"), rows[id_col] == F.col("id"), "left").drop("id")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, fan_bits: int | None = None) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256; a text that lost words becomes its kept words joined by one space, others stay as they are."""
    made = ["n_words", "n_removed", "kept_sha256"]
    rows = positional(docs, made, [text_col])
    src = _ranked(rows, id_col).select(rows.row(), "rank", rows[text_col].alias("text"))
    chunks = pack(src, "text")
    found = chunks.agg(F.count("*"), F.sum("n_bytes")).first()
    plan = exchange.Plan(found[0], found[1] or 0, bucket_bytes, fan_bits)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = _Chunk(unpack(data.as_py()))
                starts, keys, which = c.anchors()
                if len(keys):
                    yield _rows(list(exchange.sent(ANCHORS, plan, 0, keys, _same_doc_max(len(keys), which, c.ids[c.doc[starts]]))), chunk)

    def shared_windows(c: _Chunk, answers: dict[int, bytes]) -> tuple:
        starts, keys, which = c.anchors()
        hit = exchange.received(ANCHORS, plan, 0, keys, np.zeros(len(keys), bool), answers)
        at, hi, lo = c.windows(starts[hit[which]])
        return (at, *c.distinct(hi, lo, at))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (chunk, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                if answers := exchange.answer_map(batch, "answers0", i):
                    _, keys, low, _ = shared_windows(_Chunk(unpack(data.as_py())), answers)
                    if len(keys):
                        yield _rows(list(exchange.sent(WINDOWS, plan, 0, keys, low)), chunk)

    row = "range long, member long, data binary"
    packed = chunks.select("chunk", "data")
    one = stash(exchange.answered(packed.mapInArrow(anchors, row), ANCHORS, plan), "anchors")
    two = stash(exchange.answered(exchange.joined(packed, one).mapInArrow(windows, row), WINDOWS, plan), "windows")

    schema = src.select("_row").schema.add("text", "string").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                table = unpack(data.as_py())
                c = _Chunk(table)
                gone = np.zeros(len(c.h) + 1, np.int32)
                if answers := exchange.answer_map(batch, "answers0", i):
                    at, keys, low, which = shared_windows(c, answers)
                    elsewhere = exchange.received(WINDOWS, plan, 0, keys, low, exchange.answer_map(batch, "answers1", i))
                    ids = c.ids[c.doc[at]]
                    hit = at[(elsewhere[which] | (low[which] < ids)) & ~c.nameless[c.doc[at]]] if len(at) else at
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + WINDOW, -1)
                covered = np.cumsum(gone[:-1]) > 0
                kept, n_removed = [], []
                for d, words in enumerate(c.words):
                    mask = covered[c.first[d] : c.first[d + 1]]
                    k = int(mask.sum())
                    n_removed.append(k)
                    kept.append(b" ".join(words if not k else [w for w, x in zip(words, mask.tolist(), strict=True) if not x]))
                text = pa.array([k if n else x.as_py() for k, n, x in zip(kept, n_removed, table.column("text"), strict=True)], pa.binary()).cast(pa.string())
                out = pa.table([table.column("_row").combine_chunks(), text, pa.array(c.n), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=["_row", "text", *made])
                yield from out.to_batches()

    out = exchange.joined(packed, one, two).mapInArrow(removed, schema)
    release(docs.sparkSession)
    at = rows.place(text_col)
    columns = sorted([*rows.kept, at])
    return out.select(*[(F.col("text") if n == at else F.col("_row")[f"c{n}"]).alias(rows.names[n]) for n in columns], *made)
