"""Catalogue objects as rows: what a structure check compares and a structure task creates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import spark_ddl
from ..operators.filters import Pair, TableFilter
from ..operators.routing import Router


def describe(spark: SparkSession, frames: Mapping[Pair, DataFrame], rule: TableFilter | None = None) -> DataFrame:
    """``key`` (``table.schema.name``) and ``ddl`` of each table that takes part; schemas are known without reading rows."""
    rows = [(f"table.{s}.{t}", spark_ddl(df.schema, f"{s}.{t}")) for (s, t), df in sorted(frames.items()) if rule is None or rule.keeps(s, t)]
    return spark.createDataFrame(rows, "key string, ddl string")


def catalogue(columns: DataFrame, constraints: DataFrame, indexes: DataFrame | None = None, dialect: str = "mysql") -> DataFrame:
    """``kind``, ``schema``, ``tb``, ``key`` and ``ddl`` of the tables, constraints and indexes of a database's own catalogue, which any source gives over JDBC.

    ``columns``: schema, tb, name, place, type, nullable, default (text or null).  ``constraints``: schema, tb, name, kind (PRIMARY KEY, UNIQUE,
    FOREIGN KEY, CHECK), columns (array), and for a foreign key ref_schema, ref_tb, ref_columns, for a check its text in ``condition``.
    ``indexes``: schema, tb, name, columns, is_unique.
    """
    mark = "`" if dialect == "mysql" else '"'
    q = lambda c: F.concat(F.lit(mark), F.replace(c, F.lit(mark), F.lit(mark * 2)), F.lit(mark))
    table, listed = F.concat_ws(".", q(F.col("schema")), q(F.col("tb"))), lambda c: F.array_join(F.transform(c, q), ", ")
    one = F.concat(q(F.col("name")), F.lit(" "), F.col("type"), F.when(F.col("nullable"), "").otherwise(" NOT NULL"), F.coalesce(F.concat(F.lit(" DEFAULT "), F.col("default")), F.lit("")))
    tables = columns.groupBy("schema", "tb").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", one.alias("text")))), lambda x: x["text"]), ", ").alias("body"))
    made = tables.select(F.lit("table").alias("kind"), "schema", "tb", F.concat_ws(".", F.lit("table"), "schema", "tb").alias("key"), F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), table, F.lit(" ("), F.col("body"), F.lit(")")).alias("ddl"))
    foreign = F.concat(F.lit(" REFERENCES "), F.concat_ws(".", q(F.col("ref_schema")), q(F.col("ref_tb"))), F.lit(" ("), listed(F.col("ref_columns")), F.lit(")"))
    what = F.when(F.col("kind") == "CHECK", F.concat(F.lit("CHECK ("), F.col("condition"), F.lit(")"))).otherwise(
        F.concat(F.col("kind"), F.lit(" ("), listed(F.col("columns")), F.lit(")"), F.when(F.col("kind") == "FOREIGN KEY", foreign).otherwise(F.lit("")))
    )
    rule = F.concat(F.lit("ALTER TABLE "), table, F.lit(" ADD CONSTRAINT "), q(F.col("name")), F.lit(" "), what)
    named = lambda kind: F.concat_ws(".", F.lit(kind), "schema", "tb", "name").alias("key")
    made = made.unionByName(constraints.select(F.lit("constraint").alias("kind"), "schema", "tb", named("constraint"), rule.alias("ddl")))
    if indexes is not None:
        text = F.concat(F.lit("CREATE "), F.when(F.col("is_unique"), "UNIQUE ").otherwise(""), F.lit("INDEX "), q(F.col("name")), F.lit(" ON "), table, F.lit(" ("), listed(F.col("columns")), F.lit(")"))
        made = made.unionByName(indexes.select(F.lit("index").alias("kind"), "schema", "tb", named("index"), text.alias("ddl")))
    return made


def routed(frames: Mapping[str, DataFrame], route: Router) -> dict[str, DataFrame]:
    """A catalogue (``columns``, ``constraints``, ``indexes``) under the target's names: schemas, tables, the tables that foreign keys point to, and columns."""
    names = [(s, t, old, new) for (s, t), renamed in route.columns.items() for old, new in renamed.items()]

    def placed(df: DataFrame, schema: str, table: str, *lists: str) -> DataFrame:
        to = route.routed_names(F.col(schema), F.col(table))
        renamed = lambda c: _renamed(c, schema, table, names)
        lists_ = {c: (F.transform(c, renamed) if df.schema[c].dataType.typeName() == "array" else renamed(F.col(c))) for c in lists if c in df.columns}
        new = F.when(F.col(table).isNotNull(), to)
        return df.withColumns({**lists_, "_to": new}).withColumns({schema: F.col("_to.schema"), table: F.col("_to.table")}).drop("_to")

    out = {"columns": placed(frames["columns"], "schema", "tb", "name"), "constraints": placed(placed(frames["constraints"], "ref_schema", "ref_tb", "ref_columns"), "schema", "tb", "columns")}
    if "indexes" in frames:
        out["indexes"] = placed(frames["indexes"], "schema", "tb", "columns")
    return out


def _renamed(c, schema: str, table: str, names):
    out = c
    for s, t, old, new in names:
        out = F.when((F.col(schema) == s) & (F.col(table) == t) & (c == old), new).otherwise(out)
    return out


def create(spark: SparkSession, structures: DataFrame, conflict: str = "interrupt") -> list[str]:
    """Runs the statements on the driver, a few per table; ``ignore`` goes on after one that fails.  Returns the keys that failed."""
    failed = []
    for key, text in structures.select("key", "ddl").orderBy("key").collect():
        try:
            spark.sql(text)
        except Exception:
            if conflict != "ignore":
                raise
            failed.append(key)
    return failed
