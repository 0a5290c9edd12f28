"""Statements as text: what a change does, what undoes it, and what repairs a difference.

``kinds`` maps columns to Spark types.  Everything is a Column expression; no rows pass through Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..meta import TableMeta
from .values import canonical

QUOTE = {"mysql": "`", "pg": '"'}


def identifier(name: str, dialect: str = "mysql") -> str:
    q = QUOTE[dialect]
    return q + name.replace(q, q + q) + q


def table_name(meta: TableMeta, dialect: str = "mysql") -> str:
    return f"{identifier(meta.schema, dialect)}.{identifier(meta.table, dialect)}"


def literal(value: Column, kind: T.DataType, dialect: str = "mysql") -> Column:
    """Numbers are bare, NULL is a word, bytes are hex, all else is quoted; NaN and infinities are quoted where the dialect has them."""
    if isinstance(kind, T.BinaryType):
        out = F.concat(F.lit("x'" if dialect == "mysql" else r"'\x"), F.lower(F.hex(value)), F.lit("'"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        double = value.cast("double")
        odd = F.when(F.isnan(double), "'NaN'").when(double == F.lit(float("inf")), "'Infinity'").when(double == F.lit(float("-inf")), "'-Infinity'")
        out = odd.otherwise(F.regexp_replace(value.cast("string"), r"\.0$", ""))
    elif isinstance(kind, T.NumericType):
        out = value.cast("string")
    elif isinstance(kind, T.BooleanType) and dialect == "mysql":
        out = value.cast("int").cast("string")
    else:
        out = F.concat(F.lit("'"), F.replace(canonical(value, kind), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(out, F.lit("NULL"))


def _conditions(image: Column, columns: Sequence[str], kinds: Mapping[str, T.DataType], dialect: str) -> Column:
    parts = [F.when(image[c].isNull(), F.lit(f"{identifier(c, dialect)} IS NULL")).otherwise(F.concat(F.lit(f"{identifier(c, dialect)} = "), literal(image[c], kinds[c], dialect))) for c in columns]
    return F.concat_ws(" AND ", *parts)


def _one_row(meta: TableMeta, where: Column, dialect: str) -> Column:
    """A keyless table loses or changes one row of those that agree."""
    if not meta.is_bag:
        return F.concat(F.lit(" WHERE "), where, F.lit(";"))
    if dialect == "mysql":
        return F.concat(F.lit(" WHERE "), where, F.lit(" LIMIT 1;"))
    return F.concat(F.lit(f" WHERE ctid = (SELECT ctid FROM {table_name(meta, dialect)} WHERE "), where, F.lit(" LIMIT 1);"))


def insert_sql(meta: TableMeta, row: Column, kinds: Mapping[str, T.DataType], dialect: str = "mysql", replace: bool = False) -> Column:
    names = ",".join(identifier(c, dialect) for c in meta.columns)
    values = F.concat_ws(",", *[literal(row[c], kinds[c], dialect) for c in meta.columns])
    word = "REPLACE" if replace and dialect == "mysql" else "INSERT"
    tail = ";"
    if replace and dialect == "pg" and not meta.is_bag:
        key = ",".join(identifier(c, dialect) for c in meta.id_cols)
        sets = ",".join(f"{identifier(c, dialect)}=EXCLUDED.{identifier(c, dialect)}" for c in meta.value_cols)
        tail = f" ON CONFLICT ({key}) DO " + (f"UPDATE SET {sets};" if sets else "NOTHING;")
    return F.concat(F.lit(f"{word} INTO {table_name(meta, dialect)}({names}) VALUES("), values, F.lit(")" + tail))


def delete_sql(meta: TableMeta, row: Column, kinds: Mapping[str, T.DataType], dialect: str = "mysql") -> Column:
    return F.concat(F.lit(f"DELETE FROM {table_name(meta, dialect)}"), _one_row(meta, _conditions(row, meta.id_cols, kinds, dialect), dialect))


def update_sql(meta: TableMeta, before: Column, after: Column, kinds: Mapping[str, T.DataType], dialect: str = "mysql", columns: Sequence[str] | None = None, present: Column | None = None, match: Sequence[str] | None = None) -> Column:
    """SET names ``columns``, or those of them that are in the array ``present``; WHERE names ``match``, the identifying columns by default."""
    pieces = []
    for c in columns or meta.columns:
        one = F.concat(F.lit(f"{identifier(c, dialect)}="), literal(after[c], kinds[c], dialect))
        pieces.append(one if present is None else F.when(F.array_contains(present, c), one))
    where = _conditions(before, match or meta.id_cols, kinds, dialect)
    return F.concat(F.lit(f"UPDATE {table_name(meta, dialect)} SET "), F.concat_ws(",", *pieces), _one_row(meta, where, dialect))


def change_sql(meta: TableMeta, kinds: Mapping[str, T.DataType], dialect: str = "mysql", reverse: bool = False, replace: bool = False) -> Column:
    """The statement of a change row (``op``, ``before``, ``after``), or the one that undoes it."""
    before, after = (F.col("after"), F.col("before")) if reverse else (F.col("before"), F.col("after"))
    gone, new = ("insert", "delete") if reverse else ("delete", "insert")
    return (
        F.when(F.col("op") == new, insert_sql(meta, after, kinds, dialect, replace))
        .when(F.col("op") == gone, delete_sql(meta, before, kinds, dialect))
        .when(F.col("op") == "update", update_sql(meta, before, after, kinds, dialect))
    )


def revise_sql(meta: TableMeta, kinds: Mapping[str, T.DataType], dialect: str = "mysql", match_full_row: bool = False) -> Column:
    """The statement that repairs a row of a check's result (``kind``, ``src``, ``dst``, ``diff_cols``)."""
    update = update_sql(meta, F.col("dst"), F.col("src"), kinds, dialect, present=F.col("diff_cols"), match=meta.columns if match_full_row else None)
    return (
        F.when(F.col("kind") == "miss", insert_sql(meta, F.col("src"), kinds, dialect))
        .when(F.col("kind") == "diff", update)
        .when(F.col("kind") == "stale", delete_sql(meta, F.col("dst"), kinds, dialect))
    )


def kinds_of(schema: T.StructType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in schema}
