"""Change files, document files and snapshots, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def change_schema(columns: T.StructType) -> T.StructType:
    """Change rows of a table with these columns."""
    return T.StructType().add("op", "string").add("seq", "long").add("before", columns).add("after", columns).add("unchanged", T.ArrayType(T.StringType()))


def read_changes(spark: SparkSession, path: str, columns: T.StructType, kind: str = "json") -> DataFrame:
    return spark.read.schema(change_schema(columns)).format(kind).load(path)


def stream_changes(spark: SparkSession, path: str, columns: T.StructType, kind: str = "json", files_per_batch: int = 16) -> DataFrame:
    """As they arrive; ``files_per_batch`` bounds what one micro-batch takes in."""
    return spark.readStream.schema(change_schema(columns)).format(kind).option("maxFilesPerTrigger", files_per_batch).load(path)


def read_documents(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """Documents as ``_id`` (JSON text of the id) and ``doc`` (the whole line); lines that are no object with an id are left out."""
    lines = spark.read.text(path).select(F.col("value").alias("doc"))
    rows = lines.withColumn("_id", F.get_json_object("doc", "$._id")).filter("_id IS NOT NULL").select("_id", "doc")
    return rows.filter(where) if where else rows


def id_rank(kind: str, value: str):
    """Ids of mixed types sort by type first: numbers, texts, objects, binary, object ids, booleans, dates."""
    order = ["null", "number", "string", "object", "array", "binary", "objectId", "bool", "date"]
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(kind))
    return F.struct(rank.alias("rank"), F.when(F.col(kind) == "number", F.col(value).try_cast("double")).alias("number"), F.col(value).alias("text"))


def documents_after(docs: DataFrame, kind: str, value: str, after: tuple[str, str]) -> DataFrame:
    """Documents whose id comes after a given one: how a scan resumes."""
    last = docs.sparkSession.range(1).select(F.lit(after[0]).alias("k"), F.lit(after[1]).alias("v")).select(id_rank("k", "v").alias("r"))
    return docs.filter(id_rank(kind, value) > last.scalar())


def heartbeats(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A row now and then, so that positions advance while nothing changes."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("timestamp").alias("beat_at"), F.col("value").alias("beat"))
