"""Values as text, and when two values are the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_or_hex(raw: Column) -> Column:
    """Bytes of an unknown charset: the text if they are UTF-8, else lower-case hex."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.lower(F.hex(raw)))


def prefixed_hex(raw: Column) -> Column:
    """The text if the bytes are UTF-8, else ``0x`` and hex."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(raw))))


def without_utc_offset(time_text: Column) -> Column:
    """Times lose a trailing ``+00``, however often it stands there."""
    return F.regexp_replace(time_text, r"(\+00)+$", "")


def canonical(value: Column, kind: T.DataType) -> Column:
    """The text of a value in logs and keys; null stays null."""
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(value)
    return value.cast("string")


def network_text(address: Column) -> Column:
    """Host addresses with and without their full prefix length are the same."""
    return F.regexp_replace(address, r"/(32|128)$", "")


def same_value(a: Column, b: Column, network: bool = False) -> Column:
    """Null equals null, NaN equals NaN."""
    return network_text(a).eqNullSafe(network_text(b)) if network else a.eqNullSafe(b)


def set_labels(bits: Column, labels: Sequence[str]) -> Column:
    """The labels of a set: item k has bit ``1 << k``; comma-separated."""
    return F.when(bits.isNotNull(), F.concat_ws(",", *[F.when(F.getbit(bits.cast("long"), F.lit(k)) == 1, F.lit(x)) for k, x in enumerate(labels)]))


def enum_label(ordinal: Column, labels: Sequence[str]) -> Column:
    """Ordinals count from 1; 0 is the empty label of an invalid value, others are null."""
    return F.try_element_at(F.array(F.lit(""), *[F.lit(x) for x in labels]), (ordinal + 1).cast("int"))


def time_micros(time_text: Column) -> Column:
    """Signed times of any number of hours, ``-838:59:59.000001``, in microseconds; null if it isn't one."""
    part = lambda n: F.regexp_extract(time_text, r"^(-?)(\d+):(\d{1,2}):(\d{1,2})(?:\.(\d{1,6}))?$", n)
    seconds = part(2).try_cast("long") * 3600 + part(3).try_cast("long") * 60 + part(4).try_cast("long")
    micros = seconds * 1_000_000 + F.rpad(part(5), 6, "0").try_cast("long")
    return F.when(part(1) == "-", -micros).otherwise(micros)


def bit_text(raw: Column) -> Column:
    """A bit field of at most 64 bits as an unsigned number."""
    return F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")


def row_bytes(df_schema: T.StructType) -> Column:
    """The size of a row as accounted: fixed widths, the length of texts and bytes, nothing for nulls."""
    fixed = {"byte": 1, "boolean": 1, "short": 2, "integer": 4, "float": 4, "date": 4, "long": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}
    total = F.lit(0).cast("long")
    for f in df_schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif f.dataType.typeName() in fixed:
            size = F.lit(fixed[f.dataType.typeName()])
        else:
            size = F.octet_length(canonical(c, f.dataType))
        total = total + F.when(c.isNotNull(), size).otherwise(0)
    return total.cast("long")


def key_percent(*keys: Column) -> Column:
    """A number below 100 that depends on the key alone, the same in every run and engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("long"), F.lit(100))
