"""Questions about keys that many chunks hold, answered to each chunk in the order of its keys.

A chunk's sorted keys go out as a row per range of the key space, at most ``FAN`` of them.  Up to ``FAN`` chunks make a group, and where a
range of a group meets its keys are merged.  While there are several groups, a merged range is itself such a chunk, cut into ranges of
ranges that go to groups of groups; the keys of the last groups are complete.  Answers go back the same way, so they need no keys.

The rows of a level number ``FAN`` for each chunk, whatever the input: levels grow as its logarithm, rows and bytes in proportion to it.
Keys are 64-bit hashes.  A range's leading bits are not sent, and of the rest so many bytes that the last group tells keys apart by 40 bits
beyond its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

FAN_BITS = 8
#: Bytes of a key beyond the range of the last group.
KEY_BYTES = 5
#: Ranges are numbered below a kind, which keeps tables of keys apart.
KIND = 40


class Plan:
    """Levels for ``members`` chunks of ``total`` bytes: ``groups`` of each, ``bits`` of a range at the first."""

    def __init__(self, members: int, total: int, bucket_bytes: int, fan_bits: int | None = None):
        self.fan_bits = FAN_BITS if fan_bits is None else fan_bits
        fan, self.groups = 1 << self.fan_bits, []
        n = max(1, members)
        while n > 1 or not self.groups:
            n = -(-n // fan)
            self.groups.append(n)
        wanted = int(np.ceil(np.log2(max(1, total / bucket_bytes))))
        # at least 64 ranges, so that tasks are many; a level more has all the ranges there are
        self.bits = self.fan_bits if len(self.groups) > 1 else min(self.fan_bits, max(6, wanted))

    def width(self, level: int) -> int:
        """Bytes of a key sent to a level, from 0."""
        return min(8, KEY_BYTES + -(-(len(self.groups) - 1 - level) * self.fan_bits // 8))


def ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(range, slice) of each range that has some of the sorted, left-aligned ``keys``."""
    if not len(keys):
        return
    tops = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(tops)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
        yield int(tops[lo]), slice(lo, hi)


def inner(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys without their leading bits, left-aligned again."""
    return keys << np.uint64(bits)


def short_keys(keys: np.ndarray, width: int) -> np.ndarray:
    """Keys with zeros after their first ``width`` bytes; sorted keys stay sorted."""
    return keys if width == 8 else keys & ~np.uint64((1 << (64 - 8 * width)) - 1)


def pack_keys(keys: np.ndarray, width: int) -> bytes:
    """Sorted keys as their steps, byte by byte: the high bytes of the steps are nearly all zero and shrink to nothing."""
    steps = np.diff(keys >> np.uint64(64 - 8 * width), prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return small(planes)


def unpack_keys(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(plain(data), np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view("<u8").reshape(-1), dtype=np.uint64) << np.uint64(64 - 8 * width)


def small(data: bytes) -> bytes:
    """Compressed behind a mark, or as it is where that is shorter: short rows carry no frame."""
    if len(data) > 64:
        packed = zstandard.ZstdCompressor(1).compress(data)
        if len(packed) < len(data):
            return b"z" + packed
    return b"p" + data


def plain(data: bytes) -> bytes:
    return zstandard.decompress(data[1:]) if data[:1] == b"z" else data[1:]


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes as the largest needs."""
    size = np.dtype(np.min_scalar_type(int(x.max()))).itemsize if len(x) else 1
    return bytes([size]) + small(x.astype(f"<u{size}").tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(plain(data[1:]), f"<u{data[0]}").astype(np.int64)


class Question:
    """What is sent about keys, how it is merged, and what is answered.  ``values`` is an array with a row for each key."""

    def pack(self, keys, values, width: int, kind: int) -> bytes:
        raise NotImplementedError

    def unpack(self, data: bytes, width: int, kind: int):
        """(keys, values)"""
        raise NotImplementedError

    def cut(self, keys, values, bits: int) -> Iterator[tuple]:
        """(range, keys without its bits, values) of each range."""
        for at, s in ranges(keys, bits):
            yield at, inner(keys[s], bits), values[s]

    def merge(self, parts: list):
        """(keys, values, place): distinct sorted keys, and for each key of the parts its place among them."""
        raise NotImplementedError

    def whole(self, values) -> np.ndarray:
        """The answers to keys that are merged from all chunks."""
        raise NotImplementedError

    def answer(self, merged, answers: np.ndarray, place: np.ndarray, values) -> np.ndarray:
        """The answers to a part's keys, from the values and answers of what it was merged into."""
        return answers[place]

    def pack_answers(self, answers: np.ndarray) -> bytes | None:
        raise NotImplementedError

    def unpack_answers(self, data: bytes | None, n: int) -> np.ndarray:
        raise NotImplementedError


class Flags(Question):
    """Answers of one bit; no answer at all where none is set."""

    def pack_answers(self, answers: np.ndarray) -> bytes | None:
        return small(np.packbits(answers).tobytes()) if answers.any() else None

    def unpack_answers(self, data: bytes | None, n: int) -> np.ndarray:
        return np.zeros(n, bool) if data is None else np.unpackbits(np.frombuffer(plain(data), np.uint8), count=n).astype(bool)


def merged_keys(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, place of each key of the parts)"""
    return np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)


def sent(question: Question, plan: Plan, kind: int, keys, values) -> Iterator[tuple[int, bytes]]:
    """(range, data) of a chunk's keys."""
    width = plan.width(0)
    for at, k, v in question.cut(keys, values, plan.bits):
        yield kind << KIND | at, question.pack(k, v, width, kind)


def received(question: Question, plan: Plan, kind: int, keys, values, answers: dict[int, bytes]) -> np.ndarray:
    """The answers to a chunk's keys."""
    pieces = [question.unpack_answers(answers.get(kind << KIND | at), len(v)) for at, _, v in question.cut(keys, values, plan.bits)]
    return np.concatenate(pieces) if pieces else question.unpack_answers(None, 0)


def joined(chunks: DataFrame, *replies: DataFrame) -> DataFrame:
    """One row per chunk with, for each table of replies, the array ``answersN`` of its (range, data)."""
    out = chunks
    for n, rows in enumerate(replies):
        per_chunk = rows.groupBy(F.col("member").alias("chunk")).agg(F.collect_list(F.struct("range", "data")).alias(f"answers{n}"))
        out = out.join(per_chunk.hint("merge"), "chunk", "left")
    return out


def answer_map(batch: pa.RecordBatch, name: str, i: int) -> dict[int, bytes]:
    got = batch.column(batch.schema.get_field_index(name))[i].as_py()
    return {x["range"]: x["data"] for x in got or ()}


def _split(place: np.ndarray, parts: list) -> list[np.ndarray]:
    return np.split(place, np.cumsum([len(p[1]) for p in parts])[:-1])


def answered(rows: DataFrame, question: Question, plan: Plan, extra: str = "", more=None) -> DataFrame:
    """``(range, member, data)`` for the rows (range, member, data) that chunks have sent; a range without any answer may be missing.

    ``extra`` and ``more``: columns (SQL) and their values, from kind, keys and values, that the complete keys of a range give once, with its first answer.
    """
    fan_bits, levels = plan.fan_bits, len(plan.groups)
    reply = "range long, member long, data binary"
    cur = rows.withColumn("group", F.pmod(F.xxhash64("member"), F.lit(plan.groups[0])) if levels > 1 else F.lit(0).cast("long"))
    nodes: list[DataFrame] = []
    for level in range(levels - 1):
        held = stash(cur.groupBy("range", "group").agg(F.collect_list(F.struct("member", "data")).alias("members")), "exchange-nodes")
        nodes.append(held)
        cur = held.select("range", "group", "members").mapInArrow(_climb(question, plan, level), "range long, group long, member long, data binary")

    last = plan.width(levels - 1)
    names = [x.split()[0] for x in extra.split(", ")] if extra else []

    def top(table: pa.Table) -> pa.Table:
        kind = table.column("range")[0].as_py() >> KIND
        parts = [question.unpack(x.as_py(), last, kind) for x in table.column("data")]
        keys, values, place = question.merge(parts)
        whole = question.whole(values)
        answers = [question.pack_answers(question.answer(values, whole, at, part[1])) for at, part in zip(_split(place, parts), parts, strict=True)]
        made = {"range": table.column("range"), "member": table.column("member"), "data": pa.array(answers, pa.binary())}
        if more is not None:
            for name, value in zip(names, more(kind, keys, values), strict=True):
                made[name] = pa.array([value, *[0] * (len(answers) - 1)], pa.int64())
            return pa.table(made)
        return pa.table(made).filter(pa.array([a is not None for a in answers], pa.bool_()))

    replies = cur.groupBy("range", "group").applyInArrow(top, reply + (", " + extra if extra else ""))
    for level in reversed(range(levels - 1)):
        replies = stash(replies, "exchange-replies")
        low, kind = F.col("range").bitwiseAND(F.lit((1 << KIND) - 1)), F.shiftright("range", KIND)
        upper = F.shiftleft(kind, KIND).bitwiseOR(F.shiftright(low, fan_bits))
        part = low.bitwiseAND(F.lit((1 << fan_bits) - 1))
        totals = [F.sum(n).alias(n) for n in names]
        got = replies.select(upper.alias("range"), F.col("member").alias("group"), F.struct(part.alias("part"), "data").alias("a"), *names).groupBy("range", "group").agg(F.collect_list("a").alias("got"), *totals)
        both = nodes[level].join(got.hint("merge"), ["range", "group"], "left").select("range", "members", "got", *names)
        replies = both.mapInArrow(_descend(question, plan, level, names), reply + (", " + extra if extra else ""))
    return replies


def _members(column, i: int) -> tuple[list[int], list[bytes]]:
    got = column[i].as_py()
    return [m["member"] for m in got], [m["data"] for m in got]


def _climb(question: Question, plan: Plan, level: int):
    """Merged ranges of a level as the chunks of the next."""
    fan_bits, groups, here, above = plan.fan_bits, plan.groups[level + 1], plan.width(level), plan.width(level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (at, group) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                kind, low = at >> KIND, at & (1 << KIND) - 1
                keys, values, _ = question.merge([question.unpack(x, here, kind) for x in _members(batch.column(2), i)[1]])
                sent = [(kind << KIND | low << fan_bits | part, question.pack(k, v, above, kind)) for part, k, v in question.cut(keys, values, fan_bits)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _ in sent], pa.int64()), pa.array([group % groups] * len(sent), pa.int64()), pa.array([group] * len(sent), pa.int64()), pa.array([d for _, d in sent], pa.binary())],
                    names=["range", "group", "member", "data"],
                )

    return run


def _descend(question: Question, plan: Plan, level: int, names: list[str]):
    """Answers to merged ranges as answers to what they were merged from."""
    fan_bits, here = plan.fan_bits, plan.width(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, at in enumerate(batch.column(0).to_pylist()):
                members, data = _members(batch.column(1), i)
                parts = [question.unpack(x, here, at >> KIND) for x in data]
                keys, values, place = question.merge(parts)
                got = {x["part"]: x["data"] for x in batch.column(2)[i].as_py() or ()}
                pieces = []
                for part, _, v in question.cut(keys, values, fan_bits):
                    pieces.append(question.unpack_answers(got.get(part), len(v)))
                merged = np.concatenate(pieces) if pieces else question.unpack_answers(None, 0)
                answers = [question.pack_answers(question.answer(values, merged, a, p[1])) for a, p in zip(_split(place, parts), parts, strict=True)]
                totals = [pa.array([batch.column(3 + n)[i].as_py() or 0, *[0] * (len(members) - 1)], pa.int64()) for n in range(len(names))]
                out = pa.RecordBatch.from_arrays([pa.array([at] * len(members), pa.int64()), pa.array(members, pa.int64()), pa.array(answers, pa.binary()), *totals], names=["range", "member", "data", *names])
                yield out if names else out.filter(pa.array([a is not None for a in answers], pa.bool_()))

    return run
