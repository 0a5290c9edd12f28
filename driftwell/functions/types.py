"""Column types between systems, and CREATE TABLE texts for targets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..meta import TableMeta

# What each source type becomes in each target.  A type with "unsigned" has its own row.
_MYSQL_ROWS = """
tinyint              Int8           TINYINT       TINYINT
tinyint unsigned     UInt8          SMALLINT      SMALLINT
smallint             Int16          SMALLINT      SMALLINT
smallint unsigned    UInt16         INT           INT
mediumint            Int32          INT           INT
mediumint unsigned   UInt32         BIGINT        BIGINT
int                  Int32          INT           INT
int unsigned         UInt32         BIGINT        BIGINT
bigint               Int64          BIGINT        BIGINT
bigint unsigned      UInt64         LARGEINT      LARGEINT
float                Float32        FLOAT         FLOAT
double               Float64        DOUBLE        DOUBLE
time                 String         VARCHAR(255)  VARCHAR(255)
year                 Int32          INT           INT
date                 Date32         DATE          DATE
tinytext             String         STRING        STRING
text                 String         STRING        STRING
mediumtext           String         STRING        STRING
longtext             String         STRING        STRING
binary               String         VARBINARY     STRING
varbinary            String         VARBINARY     STRING
tinyblob             String         VARBINARY     STRING
blob                 String         VARBINARY     STRING
mediumblob           String         VARBINARY     STRING
longblob             String         VARBINARY     STRING
geometry             String         VARBINARY     STRING
point                String         VARBINARY     STRING
bit                  UInt64         BIGINT        BIGINT
set                  String         VARCHAR(255)  VARCHAR(255)
enum                 String         VARCHAR(255)  VARCHAR(255)
json                 String         JSON          JSON
"""
_PG_ROWS = """
boolean              Bool           BOOLEAN       BOOLEAN
int2                 Int16          SMALLINT      SMALLINT
int4                 Int32          INT           INT
int8                 Int64          BIGINT        BIGINT
float4               Float32        FLOAT         FLOAT
float8               Float64        DOUBLE        DOUBLE
numeric              Decimal128(9)  DECIMAL(38,9) DECIMAL(38,9)
char                 FixedString(1) CHAR          CHAR
varchar              String         STRING        STRING
text                 String         STRING        STRING
json                 String         JSON          JSON
jsonb                String         JSON          JSON
timestamp            DateTime64(6)  DATETIME      DATETIME(6)
timestamptz          DateTime64(6)  DATETIME      DATETIME(6)
date                 Date32         DATE          DATE
time                 String         VARCHAR(255)  VARCHAR(255)
timetz               String         VARCHAR(255)  VARCHAR(255)
interval             String         VARCHAR(255)  VARCHAR(255)
bytea                String         VARBINARY     STRING
uuid                 UUID           STRING        STRING
"""
TARGETS = ("clickhouse", "starrocks", "doris")
#: Most bytes of a text column in the targets that count bytes where the sources count characters of up to four.
MOST_CHAR, MOST_VARCHAR, BYTES_PER_CHAR, MOST_DIGITS = 255, 65533, 4, 38


def _table(rows: str) -> dict[str, dict[str, str]]:
    found = (re.split(r"\s{2,}|(?<=\S) (?=[A-Z])", line.strip()) for line in rows.strip().splitlines())
    return {r[0]: dict(zip(TARGETS, r[1:], strict=True)) for r in found}


MYSQL, PG = _table(_MYSQL_ROWS), _table(_PG_ROWS)


def target_type(source: str, kind: str, target: str) -> str:
    """``kind`` as the source writes it, e.g. ``varchar(20)`` or ``int unsigned``; unknown types are texts."""
    base, _, tail = kind.lower().partition("(")
    args = [int(x) for x in re.findall(r"\d+", tail.partition(")")[0])] if tail else []
    name = (base.strip() + (" unsigned" if "unsigned" in tail else "")).strip()
    if source == "pg":
        return PG.get(name, {}).get(target, "String" if target == "clickhouse" else "STRING")
    if name == "decimal":
        digits, scale = (args + [10, 0])[0], (args + [0, 0])[1]
        if target == "clickhouse":
            return f"Decimal({digits},{scale})"
        return f"DECIMAL({digits},{scale})" if digits <= MOST_DIGITS else "STRING"
    if name in ("datetime", "timestamp"):
        return {"clickhouse": "DateTime64(6)", "starrocks": "DATETIME"}.get(target, f"DATETIME({args[0] if args else 0})")
    if name in ("char", "varchar"):
        if target == "clickhouse":
            return "String"
        n = (args + [1])[0] * BYTES_PER_CHAR
        return f"CHAR({min(n, MOST_CHAR)})" if name == "char" else f"VARCHAR({min(n, MOST_VARCHAR)})"
    return MYSQL.get(name, {}).get(target, "String" if target == "clickhouse" else "STRING")


def target_type_column(kind: Column, kinds: Sequence[str], source: str, target: str) -> Column:
    """For types in a column; ``kinds`` are those that occur."""
    flat = [F.lit(x) for k in sorted(set(kinds)) for x in (k, target_type(source, k, target))]
    return F.try_element_at(F.create_map(*flat), kind)


def spark_type(source: str, kind: str) -> T.DataType:
    """The Spark type that holds a source's type: unsigned ones one step wider, decimals beyond 38 digits as text."""
    base, _, tail = kind.lower().partition("(")
    args = [int(x) for x in re.findall(r"\d+", tail.partition(")")[0])] if tail else []
    unsigned = "unsigned" in kind.lower()
    name = base.replace("unsigned", "").strip()
    whole = {"tinyint": 0, "int1": 0, "smallint": 1, "int2": 1, "mediumint": 2, "int": 2, "integer": 2, "int4": 2, "bigint": 3, "int8": 3}
    if name in whole:
        step = whole[name] + (1 if unsigned and name != "mediumint" else 0)
        return [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DecimalType(20, 0)][step]
    if name in ("decimal", "numeric"):
        digits, scale = (args + [38])[0], (args + [0, 0])[1] if args else 9
        return T.DecimalType(digits, scale) if digits <= 38 else T.StringType()
    plain = {
        "float": T.FloatType(), "float4": T.FloatType(), "double": T.DoubleType(), "float8": T.DoubleType(), "boolean": T.BooleanType(), "bool": T.BooleanType(),
        "date": T.DateType(), "datetime": T.TimestampNTZType(), "year": T.ShortType(), "bit": T.DecimalType(20, 0), "timestamptz": T.TimestampType(),
    }
    if name == "timestamp":
        return T.TimestampType() if source == "mysql" else T.TimestampNTZType()
    if name in ("bytea", "geometry", "point") or "blob" in name or "binary" in name:
        return T.BinaryType()
    return plain.get(name, T.StringType())


def create_table(meta: TableMeta, kinds: dict[str, str], source: str, target: str, comments: dict[str, str] | None = None) -> str:
    """The target's table for a source's: audit columns, and the identifying columns as its key."""
    from ..operators.apply import DELETED, STAMP

    cols = []
    for c in sorted(meta.columns, key=lambda c: (c not in meta.id_cols, meta.columns.index(c))) if target != "clickhouse" else meta.columns:
        kind = target_type(source, kinds[c], target)
        null = c in meta.nullable and c not in meta.id_cols
        text = f"`{c}` Nullable({kind})" if target == "clickhouse" and null else f"`{c}` {kind}"
        if target != "clickhouse" and not null:
            text += " NOT NULL"
        cols.append(text + (f" COMMENT '{comments[c]}'" if comments and comments.get(c) else ""))
    key = ",".join(f"`{c}`" for c in meta.order_cols)
    audit = [f"`{DELETED}` Int8", f"`{STAMP}` Int64"] if target == "clickhouse" else [f"`{DELETED}` SMALLINT NULL", f"`{STAMP}` BIGINT NULL"]
    head = f"CREATE TABLE IF NOT EXISTS `{meta.schema}`.`{meta.table}` ({', '.join([*cols, *audit])})"
    if target == "clickhouse":
        return f"{head} ENGINE = ReplacingMergeTree(`{STAMP}`)" + (f" PRIMARY KEY ({key}) ORDER BY ({key})" if key else "")
    if target == "starrocks":
        return f"{head} PRIMARY KEY ({key}) DISTRIBUTED BY HASH({key})" if key else f"{head} DUPLICATE KEY (`{meta.columns[0]}`)"
    return f"{head} UNIQUE KEY ({key}) DISTRIBUTED BY HASH({key}) BUCKETS AUTO" if key else f"{head} DUPLICATE KEY (`{meta.columns[0]}`)"


def spark_ddl(schema: T.StructType, table: str) -> str:
    """CREATE TABLE in Spark's own words."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" + ("" if f.nullable else " NOT NULL") for f in schema)
    return f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING PARQUET"
