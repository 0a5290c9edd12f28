"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def one_process(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's own process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder; on a cluster, where executors would write what others can't read, it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="driftwell-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
