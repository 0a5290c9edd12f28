"""User code on change rows.

``transform_rows`` runs Python over batches where an expression can't say it; ``set_columns`` and ``drop_rows`` say the usual cases as
expressions, inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A row as user code sees it: schema, tb, row_type, before, after (dicts or None).  row_type "" drops it.
Row = dict


def set_columns(changes: DataFrame, columns: Mapping[str, Column | None], where: Column | None = None) -> DataFrame:
    """Columns of ``after`` set to expressions over ``after.*``, added, or (None) dropped.  ``where`` limits the rows whose values are set."""
    old = changes.schema["after"].dataType.names
    fields = []
    for name in [*old, *[c for c in columns if c not in old]]:
        if name not in columns:
            fields.append(F.col("after")[name].alias(name))
        elif (made := columns[name]) is not None:
            before = F.col("after")[name] if name in old else F.lit(None)
            fields.append((made if where is None else F.when(where, made).otherwise(before)).alias(name))
    return changes.withColumn("after", F.when(F.col("after").isNotNull(), F.struct(*fields)))


def drop_rows(changes: DataFrame, where: Column) -> DataFrame:
    return changes.filter(~F.coalesce(where, F.lit(False)))


def seen_type(kind: T.DataType) -> T.DataType | None:
    """What user code gets: whole numbers, floats, flags and texts; None: it sees null and the value comes back unless it set one."""
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(kind, T.BooleanType):
        return kind
    return None if isinstance(kind, (T.BinaryType, T.StructType, T.MapType, T.ArrayType, T.VariantType)) else T.StringType()


def transform_rows(changes: DataFrame, function: Callable[[Row], Row], schema: str, table: str, after: T.StructType | None = None) -> DataFrame:
    """``function`` over each row, in Arrow batches; the result has columns schema, tb, op, seq, before, after.

    ``after``: the columns that come out, if the function adds or drops some.  Values it can't see (bytes, nested) are restored
    where it leaves them null.
    """
    source = changes.schema["after"].dataType
    target = after or source
    hidden = [f.name for f in source if seen_type(f.dataType) is None]

    def shown(image: str) -> Column:
        fields = [F.lit(None).cast("string").alias(f.name) if f.name in hidden else F.col(image)[f.name].cast(seen_type(f.dataType)).alias(f.name) for f in source]
        return F.when(F.col(image).isNotNull(), F.struct(*fields))

    back = T.StructType([T.StructField(f.name, f.dataType if f.name in hidden else (seen_type(f.dataType) or f.dataType)) for f in target])
    src = changes.select("op", "seq", shown("before").alias("before"), shown("after").alias("after"), F.col("before").alias("_b"), F.col("after").alias("_a"))
    kept = T.StructType().add("schema", "string").add("tb", "string").add("op", "string").add("seq", "long").add("before", back).add("after", back).add("_b", source).add("_a", source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, picked = [], []
            for k, (op, before, new) in enumerate(zip(batch.column("op").to_pylist(), _dicts(batch.column("before")), _dicts(batch.column("after")), strict=True)):
                row = function({"schema": schema, "tb": table, "row_type": op, "before": before, "after": new})
                if row["row_type"]:
                    rows.append(row)
                    picked.append(k)
            some = batch.take(pa.array(picked, pa.int64()))
            text = lambda name: pa.array([r[name] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [text("schema"), text("tb"), text("row_type"), some.column("seq"), _structs([r["before"] for r in rows], back), _structs([r["after"] for r in rows], back), some.column("_b"), some.column("_a")],
                names=kept.names,
            )

    out = src.mapInArrow(run, kept)
    known = {f.name for f in source}

    def typed(image: str, original: str) -> Column:
        fields = [(F.coalesce(F.col(image)[f.name], F.col(original)[f.name]) if f.name in hidden and f.name in known else F.col(image)[f.name].cast(f.dataType)).alias(f.name) for f in target]
        return F.when(F.col(image).isNotNull(), F.struct(*fields))

    return out.select("schema", "tb", "op", "seq", typed("before", "_b").alias("before"), typed("after", "_a").alias("after"))


def _dicts(column: pa.StructArray) -> list[Row | None]:
    """Rows as dicts, a column at a time: values of a struct one by one cost several times as much."""
    names, columns = [f.name for f in column.type], [c.to_pylist() for c in column.flatten()]
    values = zip(*columns, strict=True) if columns else [()] * len(column)
    return [dict(zip(names, row, strict=True)) if there else None for there, row in zip(column.is_valid().to_pylist(), values, strict=True)]


def _structs(rows: list[Row | None], kind: T.StructType) -> pa.StructArray:
    fields = [pa.field(f.name, _arrow(f.dataType)) for f in kind]
    columns = [pa.array([None if r is None else r.get(f.name) for r in rows], f.type) for f in fields]
    return pa.StructArray.from_arrays(columns, fields=fields, mask=pa.array([r is None for r in rows], pa.bool_()))


def transform_batches(changes: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], after: T.StructType | None = None) -> DataFrame:
    """User code on whole Arrow batches with the columns op, seq, before, after; the result has the same, ``after`` naming the images' columns if they change.

    Where code can work on columns this costs a fraction of ``transform_rows``.
    """
    image = after or changes.schema["after"].dataType
    kind = T.StructType().add("op", "string").add("seq", "long").add("before", image).add("after", image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(function, batches)

    return changes.select("op", F.col("seq").cast("long").alias("seq"), "before", "after").mapInArrow(run, kind)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
