"""Change rows in the envelope of message queues, and its Avro encoding.

The envelope: schema, tb, operation, fields (name, column_type, avro_type), before, after, extra.  Values are null, text, long,
double, bytes or boolean.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import canonical
from ..meta import TableMeta

_VALUE = ["null", "string", "long", "double", "bytes", "boolean"]
_MAP = ["null", {"type": "map", "values": _VALUE}]
_FIELD = {"name": "AvroFieldDef", "type": "record", "fields": [{"name": "name", "type": "string"}, {"name": "column_type", "type": "string", "default": "string"}, {"name": "avro_type", "type": "string", "default": "String"}]}
#: Fixed value: the record that consumers of such topics expect.
AVRO_SCHEMA = json.dumps({
    "type": "record", "name": "AvroData",
    "fields": [
        *[{"name": n, "type": "string", "default": ""} for n in ("schema", "tb", "operation")],
        {"name": "fields", "default": None, "type": ["null", {"type": "array", "items": _FIELD}]},
        *[{"name": n, "default": None, "type": _MAP} for n in ("before", "after", "extra")],
    ],
})


def avro_kind(kind: T.DataType) -> str:
    """The name of the member of the union that holds a column."""
    if isinstance(kind, T.IntegralType):
        return "Long"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "Double"
    if isinstance(kind, T.BooleanType):
        return "Boolean"
    return "Bytes" if isinstance(kind, T.BinaryType) else "String"


def envelope_key(meta: TableMeta) -> Column:
    """The text of the first ordering column: of the new image for an insert, else of the old one; empty without one."""
    if meta.is_bag:
        return F.lit("")
    c = meta.order_cols[0]
    image = F.when(F.col("op") == "insert", F.col("after")).otherwise(F.col("before"))
    return F.coalesce(image[c].cast("string"), F.lit(""))


def envelopes(changes: DataFrame, meta: TableMeta) -> DataFrame:
    """key, schema, tb, operation, fields, before, after: values as text in maps, their kinds in ``fields``, sorted by name."""
    columns = changes.schema["after"].dataType
    text = lambda image: F.when(F.col(image).isNotNull(), F.map_from_arrays(F.array(*[F.lit(f.name) for f in columns]), F.array(*[canonical(F.col(image)[f.name], f.dataType) for f in columns])))
    fields = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("column_type"), F.lit(avro_kind(f.dataType)).alias("avro_type")) for f in sorted(columns, key=lambda f: f.name)])
    return changes.select(envelope_key(meta).alias("key"), F.lit(meta.schema).alias("schema"), F.lit(meta.table).alias("tb"), F.col("op").alias("operation"), fields.alias("fields"), text("before").alias("before"), text("after").alias("after"))


# ---------------------------------------------------------------- Avro, one datum


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n & ~0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(data: bytes) -> bytes:
    return _long(len(data)) + data


def _value(kind: str, text: str | None) -> bytes:
    if text is None:
        return _long(0)
    if kind == "Long":
        return _long(2) + _long(int(text))
    if kind == "Double":
        return _long(3) + struct.pack("<d", float(text))
    if kind == "Bytes":
        return _long(4) + _bytes(bytes.fromhex(text))
    if kind == "Boolean":
        return _long(5) + (b"\x01" if text == "true" else b"\x00")
    return _long(1) + _bytes(text.encode())


def _map(image: list[tuple[str, str | None]] | None, kinds: dict[str, str]) -> bytes:
    if image is None:
        return _long(0)
    body = b"".join(_bytes(k.encode()) + _value(kinds.get(k, "String"), v) for k, v in sorted(image))
    return _long(1) + (_long(len(image)) + body if image else b"") + _long(0)


def encode(row: dict) -> bytes:
    kinds = {f["name"]: f["avro_type"] for f in row["fields"]}
    fields = b"".join(_bytes(f[k].encode()) for f in row["fields"] for k in ("name", "column_type", "avro_type"))
    head = b"".join(_bytes(row[k].encode()) for k in ("schema", "tb", "operation"))
    listed = _long(1) + (_long(len(row["fields"])) + fields if row["fields"] else b"") + _long(0)
    return head + listed + _map(row["before"], kinds) + _map(row["after"], kinds) + _long(0)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)

    def bytes(self) -> bytes:
        n = self.long()
        self.at += n
        return self.data[self.at - n : self.at]

    def blocks(self, item) -> list:
        out = []
        while n := self.long():
            if n < 0:
                self.long()
            out += [item() for _ in range(abs(n))]
        return out

    def value(self) -> str | None:
        kind = self.long()
        if kind == 1:
            return self.bytes().decode()
        if kind == 2:
            return str(self.long())
        if kind == 3:
            self.at += 8
            return repr(struct.unpack("<d", self.data[self.at - 8 : self.at])[0])
        if kind == 4:
            return self.bytes().hex()
        if kind == 5:
            self.at += 1
            return "true" if self.data[self.at - 1] else "false"
        return None


def decode(data: bytes) -> dict:
    r = _Reader(data)
    text = lambda: r.bytes().decode()
    row: dict = {k: text() for k in ("schema", "tb", "operation")}
    row["fields"] = r.blocks(lambda: {k: text() for k in ("name", "column_type", "avro_type")}) if r.long() else []
    for k in ("before", "after"):
        row[k] = r.blocks(lambda: (text(), r.value())) if r.long() else None
    return row


def to_avro(rows: DataFrame, named: bool = False) -> DataFrame:
    """``key`` and ``value``, the envelope as an Avro datum, and the table's ``schema`` and ``tb`` if asked for.

    Spark's own Avro functions are in a package that may be absent, so batches are encoded in Arrow workers.
    """
    names = ["key", "value", *(["schema", "tb"] if named else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode(x) for x in batch.select(batch.schema.names[1:]).to_pylist()]
            table = [batch.column(c) for c in names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), *table], names=names)

    kinds = "key string, value binary" + (", schema string, tb string" if named else "")
    return rows.select("key", "schema", "tb", "operation", "fields", "before", "after").mapInArrow(run, kinds)


def from_avro(rows: DataFrame, value: str = "value") -> DataFrame:
    """The envelopes of Avro data."""
    schema = "schema string, tb string, operation string, fields array<struct<name:string,column_type:string,avro_type:string>>, before map<string,string>, after map<string,string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        field = pa.struct([("name", text), ("column_type", text), ("avro_type", text)])
        kinds = [text, text, text, pa.list_(field), pa.map_(text, text), pa.map_(text, text)]
        names = ["schema", "tb", "operation", "fields", "before", "after"]
        for batch in batches:
            found = [decode(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return rows.select(value).mapInArrow(run, schema)


def changes_of(rows: DataFrame, columns: T.StructType, seq: Column) -> DataFrame:
    """Envelopes of one table back to typed change rows."""
    image = lambda name: F.when(F.col(name).isNotNull(), F.struct(*[(F.unhex(F.try_element_at(name, F.lit(f.name))) if isinstance(f.dataType, T.BinaryType) else F.try_element_at(name, F.lit(f.name)).try_cast(f.dataType)).alias(f.name) for f in columns]))
    return rows.select(F.col("operation").alias("op"), seq.cast("long").alias("seq"), image("before").alias("before"), image("after").alias("after"))
