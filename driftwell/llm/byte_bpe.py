"""Byte-level BPE by a rank queue with a hierarchical bitmap.

A pre-token is a linked list of parts.  Each adjacent pair that has a merge rank waits
in the bucket of its rank; a two-level bitmap over the ranks, of 256-bit words, gives the lowest
bucket in use by find-first-set.  Entries that no longer describe a live pair are
skipped when they come up.  A merge costs a bounded number of steps (and a heap push
within its bucket), so a pre-token of n bytes costs O(n log n), never O(n^2).

Every pre-token that is no token itself goes through the queue, whatever its length.  Short ones repeat, and a bounded cache
keeps their ids.  The vocabulary file's path is a parameter.  Ids are those of the tiktoken library without special tokens.

Defined results: a null or empty text has no ids.  Repeated rows are encoded each for itself;
ties (equal ranks) merge leftmost first; very long texts and pre-tokens are encoded whole; an empty table gives an empty table; columns of the
input named like a result (in any case) are replaced, all others come back whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import positional


_BIT = [1 << n for n in range(256)]


class ByteBPE:
    """Encoder and decoder for one file of ranks."""

    CACHE = 1 << 20
    CACHED_BYTES = 64

    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        # any two tokens whose bytes together are a token: the rank of the merge is its id
        self.pair = {
            a << 20 | b: i
            for whole, i in self.ranks.items()
            for k in range(1, len(whole))
            if (a := self.ranks.get(whole[:k])) is not None and (b := self.ranks.get(whole[k:])) is not None
        }
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        #: Entries that the queue has given, stale ones included.
        self.pops = 0
        size = max(self.bytes_of, default=0) + 1
        self.buckets: list[int | list[int]] = [0] * size
        self.low = [0] * ((size >> 8) + 1)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        The queue stands here in full, as a call for each of its steps would cost more than the step.  ``top`` says which words of ``low``
        are not zero, these which buckets are in use; a bucket has the positions that wait at a rank (one, or a heap).  ``waits`` has the
        rank of the live pair at each position, so an entry with another rank is stale.  When no live pair is left the words in use are
        cleared for the next pre-token.
        """
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        pair, single, buckets, low, bit = self.pair.get, self.single, self.buckets, self.low, _BIT
        ids = [single[b] for b in piece]
        n = len(ids)
        after, before, waits = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        top = alive = pops = 0
        fresh = [(r, i) for i, (a, b) in enumerate(pairwise(ids)) if (r := pair(a << 20 | b)) is not None]
        while True:
            for r, i in fresh:
                waits[i] = r
                alive += 1
                word = r >> 8
                bits = low[word]
                mark = bit[r & 255]
                if not bits & mark:
                    buckets[r] = i
                    top |= 1 << word
                    low[word] = bits | mark
                elif type(held := buckets[r]) is int:
                    buckets[r] = [held, i] if held < i else [i, held]
                else:
                    heappush(held, i)
            if not alive:
                break
            while True:
                pops += 1
                word = (top & -top).bit_length() - 1
                bits = low[word]
                rank = word << 8 | (bits & -bits).bit_length() - 1
                i = buckets[rank]
                if type(i) is not int:
                    held = i
                    i = heappop(held)
                    if held:
                        if waits[i] == rank:
                            break
                        continue
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
                if waits[i] == rank:
                    break
            j = after[i]
            ids[i], ids[j] = rank, -1
            alive -= 1 if waits[j] < 0 else 2
            waits[i] = waits[j] = -1
            after[i] = k = after[j]
            fresh = []
            if k < n:
                before[k] = i
                if (r := pair(rank << 20 | ids[k])) is not None:
                    fresh.append((r, i))
            if (h := before[i]) >= 0:
                if waits[h] >= 0:
                    alive -= 1
                    waits[h] = -1
                if (r := pair(ids[h] << 20 | rank)) is not None:
                    fresh.append((r, h))
        while top:
            low[(top & -top).bit_length() - 1] = 0
            top &= top - 1
        self.pops += pops
        return [x for x in ids if x >= 0]

    def _packed(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        ids = self.merge(data)
        out = pack(f"<{len(ids)}I", *ids)
        if len(data) <= self.CACHED_BYTES:
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        cache, packed = self.cache, self._packed
        return b"".join([cache.get(p) or packed(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str, pattern: str) -> ByteBPE:
    """One per worker and file."""
    return ByteBPE(vocabulary, pattern)


def encoded(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` without the text, with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids (binary) and the decoded text.

    ``vocabulary``: a file of ranks that each worker can read (a public file on every machine, or one sent with ``--files``).
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
    rows = positional(docs, made, [text_col])
    src = rows.frame.select(rows.row(), rows[text_col].alias("_text"))
    schema = src.select("_row").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    for name in made[3:]:
        schema = schema.add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, shas, backs, all_ids, decoded = [], [], [], [], []
                for text in part.column(part.num_columns - 1):
                    ids = bpe.encode(text.as_py() or "")
                    back = bpe.decode(ids)
                    n.append(len(ids) >> 2)
                    shas.append(hashlib.sha256(ids).hexdigest())
                    backs.append(hashlib.sha256(back).hexdigest())
                    if keep_ids:
                        all_ids.append(ids)
                        decoded.append(back)
                extra = [pa.array(all_ids, pa.binary()), pa.array(decoded, pa.binary())] if keep_ids else []
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string()), *extra], names=["_row", *made]
                )

    return rows.back(src.mapInArrow(run, schema), *made)


def decoded(encodings: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``encodings`` with ``text`` (binary) in place of the ids; null ids decode to empty."""
    rows = positional(encodings, ["text"], [ids_col])
    src = rows.frame.select(rows.row(), rows[ids_col].alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary, pattern)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["_row", "text"])

    return rows.back(src.mapInArrow(run, src.select("_row").schema.add("text", "binary")), "text")
