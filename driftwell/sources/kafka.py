"""Message queues: envelopes in and out.  The connector is not part of Spark itself; without it Spark says so when these are called."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.envelopes import from_avro, to_avro
from ..operators.routing import topic


def read_envelopes(spark: SparkSession, servers: str, topics: str, schema=None, per_batch: int | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """Envelopes as a stream: Avro data, or JSON texts of the ``schema`` given; ``per_batch`` bounds a micro-batch."""
    reader = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topics, **(options or {})})
    if per_batch:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    if schema is None:
        return from_avro(reader.load())
    return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("e"), "topic", "partition", "offset").select("e.*", "topic", "partition", "offset")


def messages(envelopes: DataFrame, topics: Mapping[tuple[str, str], str]) -> DataFrame:
    """``topic``, ``key`` and ``value`` of each envelope (``schema``, ``tb``, ``key`` and the rest)."""
    body = F.to_json(F.struct(*[c for c in envelopes.columns if c != "key"]))
    return envelopes.select(topic(F.col("schema"), F.col("tb"), topics).alias("topic"), F.col("key").cast("string").alias("key"), body.alias("value"))


def avro_messages(envelopes: DataFrame, topics: Mapping[tuple[str, str], str]) -> DataFrame:
    """The same with the envelope (as ``operators.envelopes`` makes it) as an Avro datum."""
    return to_avro(envelopes, named=True).select(topic(F.col("schema"), F.col("tb"), topics).alias("topic"), "key", "value")


def write_envelopes(stream: DataFrame, servers: str, topics: Mapping[tuple[str, str], str], checkpoint: str, avro: bool = True):
    out = avro_messages(stream, topics) if avro else messages(stream, topics)
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()
