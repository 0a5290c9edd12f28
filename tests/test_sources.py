"""Sources and streams: dump files, change files, restarts, a database."""

import struct

import pytest

from driftwell.meta import TableMeta
from driftwell.sources import files, kafka, rdb_file
from driftwell.streaming import tables

META = TableMeta("s", "t", ("k", "v"), ("k",))


def _text(x: bytes) -> bytes:
    return bytes([len(x)]) + x


def _listpack(items: list[bytes]) -> bytes:
    body = b"".join((bytes([0x80 | len(x)]) + x + bytes([1 + len(x)])) for x in items)
    return struct.pack("<IH", 6 + len(body) + 1, len(items)) + body + b"\xff"


def _ziplist(items: list[bytes]) -> bytes:
    body, before = b"", 0
    for x in items:
        one = bytes([before, len(x)]) + x
        body, before = body + one, len(one)
    return struct.pack("<IIH", 10 + len(body) + 1, 10, len(items)) + body + b"\xff"


def _dump() -> bytes:
    out = b"REDIS0011" + b"\xfa" + _text(b"redis-ver") + _text(b"7.0") + b"\xfe\x00" + b"\xfb\x05\x00"
    out += b"\x00" + _text(b"str") + _text(b"value")
    out += b"\x00" + _text(b"num") + b"\xc1\x39\x30"  # 12345 in two bytes
    out += b"\xfc" + struct.pack("<q", 1234567890123) + b"\x01" + _text(b"list") + b"\x02" + _text(b"a") + _text(b"b")
    out += b"\x05" + _text(b"zset") + b"\x01" + _text(b"m") + struct.pack("<d", 1.5)
    out += b"\xfe\x03" + b"\xf9\x09" + b"\x10" + _text(b"hash") + _text(_listpack([b"f", b"v"]))
    out += b"\x0b" + _text(b"ints") + _text(struct.pack("<II", 2, 2) + struct.pack("<hh", -1, 300))
    out += b"\x0a" + _text(b"zip") + _text(_ziplist([b"x", b"yy"]))
    out += b"\x12" + _text(b"quick") + b"\x02" + b"\x02" + _text(_listpack([b"p"])) + b"\x01" + _text(b"plain")
    out += b"\x00" + _text(b"lzf") + b"\xc3\x05\x0a" + bytes([0x00, 0x61, 0xE0, 0x00, 0x00])  # a run of ten
    return out + b"\xff" + b"\0" * 8


def test_dump_file(spark, tmp_path):
    (tmp_path / "dump.rdb").write_bytes(_dump())
    found = {bytes(r.key).decode(): r for r in rdb_file.read_dump(spark, str(tmp_path / "dump.rdb"), batch=2).collect()}
    flat = lambda k: [tuple(bytes(x).decode() if isinstance(x, (bytes, bytearray)) else x for x in i) for i in found[k]["items"]]
    assert flat("str") == [(None, "value", None)] and flat("num") == [(None, "12345", None)]
    assert flat("list") == [(None, "a", None), (None, "b", None)] and found["list"].expire_ms == 1234567890123
    assert flat("zset") == [("m", "1.5", None)] and flat("hash") == [("f", "v", None)]
    assert found["hash"].db == 3 and found["hash"].freq == 9 and found["str"].db == 0 and found["str"].freq is None
    assert flat("ints") == [(None, "-1", None), (None, "300", None)] and flat("zip") == [(None, "x", None), (None, "yy", None)]
    assert flat("quick") == [(None, "p", None), (None, "plain", None)] and flat("lzf") == [(None, "a" * 10, None)]


def test_broken_dump():
    with pytest.raises(ValueError):
        list(rdb_file.entries(b"NOTADUMP"))
    with pytest.raises(ValueError):
        list(rdb_file.entries(_dump()[:40]))


def test_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"_id": 2, "a": 1}\n{"_id": "x"}\nnot json\n{"a": 3}\n')
    rows = files.read_documents(spark, str(tmp_path / "d.json")).collect()
    assert sorted(r._id for r in rows) == ["2", "x"]
    kinds = spark.createDataFrame([("number", "10"), ("number", "9"), ("string", "a"), ("bool", "true")], "kind string, value string")
    assert sorted(r.value for r in files.documents_after(kinds, "kind", "value", ("number", "9")).collect()) == ["10", "a", "true"]


def _changes(spark, items):
    kind = "struct<k:long,v:string>"
    return spark.createDataFrame(items, f"op string, seq long, before {kind}, after {kind}, unchanged array<string>")


def test_restarted_stream(spark, tmp_path):
    """Three files in three runs; a batch written twice counts once; folding changes nothing that is read."""
    at = str(tmp_path)
    parts = [
        [("insert", 1, None, (1, "a"), []), ("insert", 2, None, (2, "b"), [])],
        [("update", 3, (1, "a"), (1, "A"), []), ("delete", 4, (2, "b"), None, [])],
        [("insert", 5, None, (2, "again"), []), ("update", 6, (1, "A"), (3, "moved"), [])],
    ]
    columns = _changes(spark, parts[0]).schema["after"].dataType
    target = tables.ChangeTable(spark, f"{at}/table", META, columns)
    target.load(spark.createDataFrame([(9, "old")], "k long, v string"))
    want = [{9: "old", 1: "a", 2: "b"}, {9: "old", 1: "A"}, {9: "old", 2: "again", 3: "moved"}]
    for n, (part, expected) in enumerate(zip(parts, want, strict=True)):
        _changes(spark, part).coalesce(1).write.mode("append").json(f"{at}/in")
        stream = files.stream_changes(spark, f"{at}/in", columns, files_per_batch=1)
        target.follow(stream, f"{at}/checkpoint", once=True).awaitTermination()
        assert dict(map(tuple, target.read().collect())) == expected
        if n == 1:
            target.fold()
            target.append(_changes(spark, parts[1]), 1)
            assert dict(map(tuple, target.read().collect())) == expected


def test_messages(spark):
    rows = spark.createDataFrame([("1", "db", "t", "insert")], "key string, schema string, tb string, operation string")
    out = kafka.messages(rows, {("*", "*"): "all", ("db", "*"): "one"}).first()
    assert (out.topic, out.key) == ("one", "1") and out.value == '{"schema":"db","tb":"t","operation":"insert"}'
