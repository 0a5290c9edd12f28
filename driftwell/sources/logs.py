"""Check logs as a source: the keys they name, and the rows of those keys as they are now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import TableMeta

SCHEMA = "schema string, tb string, target_schema string, target_tb string, id_col_values map<string,string>, diff_col_values map<string,struct<src:string,dst:string,src_type:string,dst_type:string>>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of miss and diff logs; ``kind`` is diff if columns are named, else miss.  Lines that are no JSON object are left out."""
    lines = spark.read.text(path)
    return parse_lines(lines, "value")


def parse_lines(lines: DataFrame, column: str) -> DataFrame:
    rows = lines.select(F.from_json(F.col(column), SCHEMA).alias("r")).filter("r.tb IS NOT NULL").select("r.*")
    return rows.withColumn("kind", F.when(F.size(F.coalesce("diff_col_values", F.create_map().cast(rows.schema["diff_col_values"].dataType))) > 0, "diff").otherwise("miss"))


def keys_of(log: DataFrame, meta: TableMeta, like: DataFrame) -> DataFrame:
    """The distinct keys of one table, cast to the types of ``like``; keys with a null or an unreadable part can't be looked up and are left out."""
    own = log.filter((F.col("schema") == meta.schema) & (F.col("tb") == meta.table))
    typed = own.select(*[F.try_element_at("id_col_values", F.lit(c)).try_cast(like.schema[c].dataType).alias(c) for c in meta.id_cols])
    return typed.dropna().distinct()


def rows_to_revise(log: DataFrame, source: DataFrame, meta: TableMeta) -> DataFrame:
    """The source's present rows of the logged keys."""
    return source.join(keys_of(log, meta, source), list(meta.id_cols), "left_semi")
