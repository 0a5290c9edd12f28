"""Dump files of a key-value store: one row per key.

A file is read by one task, as its format has no index; keys come out in batches, so memory holds the largest object, not the file.
Objects of modules come as keys without items, streams with their entries but without consumer groups.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "db int, key binary, type string, items array<struct<name:binary,value:binary,expires:long>>, expire_ms long, freq long, size long"
# Type bytes of the format.
STRING, LIST, SET, ZSET, HASH, ZSET2, MODULE2 = 0, 1, 2, 3, 4, 5, 7
ZIPMAP, LIST_ZIP, INTSET, ZSET_ZIP, HASH_ZIP, QUICKLIST, STREAM = 9, 10, 11, 12, 13, 14, 15
HASH_PACK, ZSET_PACK, QUICKLIST2, STREAM2, SET_PACK, STREAM3 = 16, 17, 18, 19, 20, 21
NAMES = {STRING: "string", LIST: "list", SET: "set", ZSET: "zset", HASH: "hash", ZSET2: "zset", ZIPMAP: "hash", LIST_ZIP: "list", INTSET: "set", ZSET_ZIP: "zset", HASH_ZIP: "hash",
         QUICKLIST: "list", STREAM: "stream", HASH_PACK: "hash", ZSET_PACK: "zset", QUICKLIST2: "list", STREAM2: "stream", SET_PACK: "set", STREAM3: "stream"}
FREQ, IDLE, AUX, RESIZE, EXPIRE_MS, EXPIRE_S, SELECT_DB, EOF, FUNCTION, MODULE_AUX = 0xF9, 0xF8, 0xFA, 0xFB, 0xFC, 0xFD, 0xFE, 0xFF, 0xF5, 0xF7


def lzf(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        c = data[at]
        at += 1
        if c < 32:
            out += data[at : at + c + 1]
            at += c + 1
            continue
        n = c >> 5
        if n == 7:
            n += data[at]
            at += 1
        back = len(out) - ((c & 31) << 8 | data[at]) - 1
        at += 1
        for k in range(n + 2):
            out.append(out[back + k])
    if len(out) != size:
        raise ValueError("a compressed text has the wrong length")
    return bytes(out)


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the file ends early")
        self.at += n
        return out

    def byte(self) -> int:
        return self.take(1)[0]

    def length(self) -> tuple[int, bool]:
        """(length, whether it is a special encoding)"""
        b = self.byte()
        if b >> 6 == 0:
            return b & 63, False
        if b >> 6 == 1:
            return (b & 63) << 8 | self.byte(), False
        if b == 0x80:
            return int.from_bytes(self.take(4), "big"), False
        if b == 0x81:
            return int.from_bytes(self.take(8), "big"), False
        return b & 63, True

    def count(self) -> int:
        return self.length()[0]

    def text(self) -> bytes:
        n, special = self.length()
        if not special:
            return self.take(n)
        if n < 3:
            return str(int.from_bytes(self.take(1 << n), "little", signed=True)).encode()
        packed, size = self.count(), self.count()
        return lzf(self.take(packed), size)

    def score(self) -> bytes:
        n = self.byte()
        return {253: b"nan", 254: b"inf", 255: b"-inf"}.get(n) or self.take(n)


def _number(x: float) -> bytes:
    return repr(int(x)).encode() if x == x and abs(x) < 1e15 and x == int(x) else repr(x).encode()


def intset(data: bytes) -> list[bytes]:
    width, n = struct.unpack_from("<II", data)
    return [str(int.from_bytes(data[8 + k * width : 8 + (k + 1) * width], "little", signed=True)).encode() for k in range(n)]


def ziplist(data: bytes) -> list[bytes]:
    at, out = 10, []
    while data[at] != 0xFF:
        at += 1 if data[at] < 254 else 5
        b = data[at]
        if b >> 6 < 3:
            n, at = ((b & 63, at + 1), ((b & 63) << 8 | data[at + 1], at + 2), (int.from_bytes(data[at + 1 : at + 5], "big"), at + 5))[b >> 6]
            out.append(data[at : at + n])
            at += n
            continue
        width = {0xC0: 2, 0xD0: 4, 0xE0: 8, 0xF0: 3, 0xFE: 1}.get(b, 0)
        out.append(str(int.from_bytes(data[at + 1 : at + 1 + width], "little", signed=True) if width else (b & 15) - 1).encode())
        at += 1 + width
    return out


def listpack(data: bytes) -> list[bytes]:
    at, out = 6, []
    while data[at] != 0xFF:
        b, start = data[at], at
        if b < 0x80:
            out.append(str(b).encode())
            at += 1
        elif b < 0xC0:
            out.append(data[at + 1 : at + 1 + (b & 63)])
            at += 1 + (b & 63)
        elif b < 0xE0:
            n = (b & 31) << 8 | data[at + 1]
            out.append(str(n - (1 << 13) if n >= 1 << 12 else n).encode())
            at += 2
        elif b < 0xF0:
            n = (b & 15) << 8 | data[at + 1]
            out.append(data[at + 2 : at + 2 + n])
            at += 2 + n
        elif b == 0xF0:
            n = int.from_bytes(data[at + 1 : at + 5], "little")
            out.append(data[at + 5 : at + 5 + n])
            at += 5 + n
        else:
            width = {0xF1: 2, 0xF2: 3, 0xF3: 4, 0xF4: 8}[b]
            out.append(str(int.from_bytes(data[at + 1 : at + 1 + width], "little", signed=True)).encode())
            at += 1 + width
        size = at - start
        at += 1 if size < 128 else 2 if size < 1 << 14 else 3 if size < 1 << 21 else 4 if size < 1 << 28 else 5
    return out


def zipmap(data: bytes) -> list[bytes]:
    at, out = 1, []

    def size() -> int:
        nonlocal at
        n = data[at]
        at += 1
        if n == 254:
            n = int.from_bytes(data[at : at + 4], "little")
            at += 4
        return n

    while data[at] != 0xFF:
        n = size()
        out.append(data[at : at + n])
        at += n
        n = size()
        free = data[at]
        at += 1
        out.append(data[at : at + n])
        at += n + free
    return out


Item = tuple[bytes | None, bytes | None, int | None]


def _pairs(flat: list[bytes]) -> list[Item]:
    return [(flat[k], flat[k + 1], None) for k in range(0, len(flat), 2)]


def _values(flat: list[bytes]) -> list[Item]:
    return [(None, x, None) for x in flat]


def _stream(c: Cursor, kind: int) -> list[Item]:
    entries: list[Item] = []
    for _ in range(c.count()):
        ms, seq = struct.unpack(">QQ", c.text())
        flat = [x for x in listpack(c.text())]
        at, (count, gone, n) = 3, (int(x) for x in flat[:3])
        names = flat[at : at + n]
        at += n + 1
        for _ in range(count + gone):
            flags, dms, dseq = (int(x) for x in flat[at : at + 3])
            at += 3
            if flags & 2:
                fields = list(zip(names, flat[at : at + n], strict=True))
                at += n
            else:
                m = int(flat[at])
                fields = [(flat[at + 1 + 2 * k], flat[at + 2 + 2 * k]) for k in range(m)]
                at += 1 + 2 * m
            at += 1
            if not flags & 1:
                body = json.dumps([[a.decode("utf-8", "backslashreplace"), b.decode("utf-8", "backslashreplace")] for a, b in fields], ensure_ascii=False)
                entries.append((f"{ms + dms}-{seq + dseq}".encode(), body.encode(), None))
    c.count(), c.count(), c.count()
    if kind >= STREAM2:
        for _ in range(5):
            c.count()
    for _ in range(c.count()):  # consumer groups: their state is not part of the rows
        c.text(), c.count(), c.count()
        if kind >= STREAM2:
            c.count()
        for _ in range(c.count()):
            c.take(16), c.take(8), c.count()
        for _ in range(c.count()):
            c.text(), c.take(8)
            if kind >= STREAM3:
                c.take(8)
            for _ in range(c.count()):
                c.take(16)
    return entries


def _skip_module(c: Cursor) -> None:
    c.count()
    while (op := c.count()) != 0:
        if op in (1, 2):
            c.count()
        elif op == 3:
            c.take(4)
        elif op == 4:
            c.take(8)
        else:
            c.text()


def _object(c: Cursor, kind: int) -> list[Item] | None:
    if kind == STRING:
        return _values([c.text()])
    if kind in (LIST, SET):
        return _values([c.text() for _ in range(c.count())])
    if kind == HASH:
        return [(c.text(), c.text(), None) for _ in range(c.count())]
    if kind in (ZSET, ZSET2):
        return [(c.text(), c.score() if kind == ZSET else _number(struct.unpack("<d", c.take(8))[0]), None) for _ in range(c.count())]
    if kind == INTSET:
        return _values(intset(c.text()))
    if kind == LIST_ZIP:
        return _values(ziplist(c.text()))
    if kind in (ZSET_ZIP, HASH_ZIP):
        return _pairs(ziplist(c.text()))
    if kind == ZIPMAP:
        return _pairs(zipmap(c.text()))
    if kind in (HASH_PACK, ZSET_PACK):
        return _pairs(listpack(c.text()))
    if kind == SET_PACK:
        return _values(listpack(c.text()))
    if kind == QUICKLIST:
        return _values([x for _ in range(c.count()) for x in ziplist(c.text())])
    if kind == QUICKLIST2:
        out: list[bytes] = []
        for _ in range(c.count()):
            plain = c.count() == 1
            node = c.text()
            out += [node] if plain else listpack(node)
        return _values(out)
    if kind in (STREAM, STREAM2, STREAM3):
        return _stream(c, kind)
    if kind == MODULE2:
        _skip_module(c)
        return None
    raise ValueError(f"objects of type {kind} are not known")


@dataclass
class Entry:
    db: int
    key: bytes
    type: str
    items: list[Item]
    expire_ms: int | None
    freq: int | None
    size: int


def entries(data: bytes) -> Iterator[Entry]:
    """The keys of a dump; ``expire_ms`` is the time (Unix) at which a key ends; ``size`` its bytes in the file."""
    if data[:5] != b"REDIS":
        raise ValueError("not a dump file")
    c = Cursor(data)
    c.at = 9
    db, expire, freq = 0, None, None
    while True:
        op = c.byte()
        if op == EOF:
            return
        if op == SELECT_DB:
            db = c.count()
        elif op == RESIZE:
            c.count(), c.count()
        elif op == AUX:
            c.text(), c.text()
        elif op == FUNCTION:
            c.text()
        elif op == MODULE_AUX:
            _skip_module(c)
        elif op == EXPIRE_MS:
            expire = int.from_bytes(c.take(8), "little", signed=True)
        elif op == EXPIRE_S:
            expire = int.from_bytes(c.take(4), "little", signed=True) * 1000
        elif op == FREQ:
            freq = c.byte()
        elif op == IDLE:
            c.count()
        else:
            start = c.at
            key = c.text()
            items = _object(c, op)
            # a module's own bytes mean nothing here: the key is known, its items are not
            yield Entry(db, key, "module" if items is None else NAMES[op], items or [], expire, freq, c.at - start)
            expire = freq = None


def read_dump(spark: SparkSession, path: str, batch: int = 1000) -> DataFrame:
    """The keys of one or more dump files."""
    item = pa.struct([("name", pa.binary()), ("value", pa.binary()), ("expires", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[Entry]) -> pa.RecordBatch:
            columns = [
                pa.array([e.db for e in held], pa.int32()), pa.array([e.key for e in held], pa.binary()), pa.array([e.type for e in held], pa.string()),
                pa.array([[{"name": n, "value": v, "expires": x} for n, v, x in e.items] for e in held], pa.list_(item)),
                pa.array([e.expire_ms for e in held], pa.int64()), pa.array([e.freq for e in held], pa.int64()), pa.array([e.size for e in held], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["db", "key", "type", "items", "expire_ms", "freq", "size"])

        for some in batches:
            for content in some.column(0):
                held: list[Entry] = []
                for entry in entries(content.as_py()):
                    held.append(entry)
                    if len(held) >= batch:
                        yield made(held)
                        held = []
                if held:
                    yield made(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)
