"""Cluster slots of keys: CRC-16 (polynomial 0x1021, no reflection) modulo 16384, over the hash tag if there is one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 16384
POLYNOMIAL = 0x1021


def nibble_table() -> list[int]:
    """The remainder of each half byte."""
    out = []
    for n in range(16):
        crc = n << 12
        for _ in range(4):
            crc = (crc << 1) ^ (POLYNOMIAL if crc & 0x8000 else 0)
        out.append(crc & 0xFFFF)
    return out


def hash_tag(key: Column) -> Column:
    """What stands between the first ``{`` and the next ``}``, unless that is nothing; else the whole key."""
    tag = F.regexp_extract(key, r"(?s)^[^{]*\{([^}]*)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def crc16(text: Column) -> Column:
    """Over the UTF-8 bytes, half a byte at a time; JVM-side."""
    table = F.array(*[F.lit(x) for x in nibble_table()])
    digits = F.filter(F.split(F.hex(text.cast("binary")), ""), lambda d: d != "")
    step = lambda crc, d: F.shiftleft(crc, 4).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(table[F.shiftright(crc, 12).bitwiseXOR(F.conv(d, 16, 10).cast("int"))])
    return F.aggregate(digits, F.lit(0), step)


def slot(key: Column) -> Column:
    return crc16(hash_tag(key)).bitwiseAND(F.lit(SLOTS - 1))
