"""Change streams into tables, with restarts that neither lose nor repeat a batch.

``ChangeTable`` keeps a base and a log of changes, one folder per micro-batch: a batch writes what it changes, never the table,
and writing it again gives the same folder.  Changes that merge are written merged, a row per key; rows of a table without a key, rows with a
null in the key, and batches with columns not sent are written as they came.  Reads apply the log to the base; ``fold`` makes a new base now and then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..meta import TableMeta
from ..operators.apply import apply_changes
from ..operators.changes import last_positions, sends_all
from ..operators.merge import compact, has_null, images


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """Finished numbered folders: those with Spark's success mark."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    found = {}
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if "=" in name and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[int(name.split("=")[1])] = f"{path}/{name}"
    return found


class ChangeTable:
    """``path``: a shared folder.  ``columns``: the table's schema."""

    def __init__(self, spark: SparkSession, path: str, meta: TableMeta, columns: T.StructType):
        self.spark, self.path, self.meta, self.columns = spark, path.rstrip("/"), meta, columns

    def load(self, rows: DataFrame) -> None:
        """The snapshot that comes before all batches."""
        rows.select(*self.meta.columns).write.mode("overwrite").parquet(f"{self.path}/base/upto=-1")

    def append(self, changes: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: the net effect of a micro-batch and its last position; a repeated batch replaces its folder."""
        self._merged(changes).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def _merged(self, changes: DataFrame) -> DataFrame:
        """The batch as changes with the same effect, as few as can be."""
        none, no_image = F.array().cast("array<string>"), F.lit(None).cast(self.columns)
        whole = lambda name: F.when(F.col(name).isNotNull(), F.struct(*[F.col(name)[f.name].cast(f.dataType).alias(f.name) for f in self.columns]))
        unsent = F.coalesce("unchanged", none) if "unchanged" in changes.columns else none
        asis = changes.select("op", "seq", whole("before").alias("before"), whole("after").alias("after"), unsent.alias("unchanged"))
        if self.meta.is_bag or not sends_all(changes):
            return asis
        key = list(self.meta.id_cols)
        net = compact(changes.drop("unchanged"), self.meta)
        own = F.struct(*[(F.col(f.name) if f.name in key else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.columns])
        gone = F.col("op") == "delete"
        rows = net.select(
            F.when(gone, "delete").otherwise("insert").alias("op"), "seq", F.when(gone, own).otherwise(no_image).alias("before"),
            whole("after").alias("after"), none.alias("unchanged"),
        )
        if not self.meta.nullable.intersection(key):
            return rows
        flat = images(changes.drop("unchanged"), self.meta).filter(has_null(key))
        odd = flat.select("op", "seq", F.when(F.col("op") != "insert", own).otherwise(no_image).alias("before"), whole("after").alias("after"), none.alias("unchanged"))
        return rows.unionByName(odd)

    def _log(self, after: int) -> DataFrame | None:
        parts = [f for n, f in sorted(_folders(self.spark, f"{self.path}/log").items()) if n > after]
        return self.spark.read.parquet(*parts) if parts else None

    def read(self) -> DataFrame:
        """The table as of the last finished batch."""
        bases = _folders(self.spark, f"{self.path}/base")
        last = max(bases, default=-1)
        base = self.spark.read.schema(self.columns).parquet(bases[last]) if bases else self.spark.createDataFrame([], self.columns)
        log = self._log(last)
        if log is None:
            return base
        return apply_changes(base.select(*self.meta.columns), log, self.meta).select(*self.meta.columns)

    def fold(self) -> None:
        """A new base with all batches so far; older folders stay until they are removed, so running reads go on."""
        done = max(_folders(self.spark, f"{self.path}/log"), default=-1)
        if done >= 0:
            self.read().write.mode("overwrite").parquet(f"{self.path}/base/upto={done}")

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = False, every: str | None = None):
        """Starts applying a stream of changes."""
        writer = stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint)
        if once:
            writer = writer.trigger(availableNow=True)
        elif every:
            writer = writer.trigger(processingTime=every)
        return writer.start()


def record_positions(path: str, key: Sequence[str]):
    """For ``foreachBatch``: the last position of each key, a folder per batch; ``positions`` reads the newest by ``seq``."""

    def write(batch: DataFrame, number: int) -> None:
        last_positions(batch, key).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def positions(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """The last position of each key, by the order of commits: files that arrive together may be read in any order of batches."""
    parts = sorted(_folders(spark, path).items())
    rows = spark.read.parquet(*[f for _, f in parts])
    return rows.groupBy(*key).agg(F.max_by(F.struct("position", "seq"), "seq").alias("p")).select(*key, "p.*")
