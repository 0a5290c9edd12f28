"""What only shows where executors are other processes than the driver."""

import os
import subprocess
import sys

from .conftest import ROOT

SCRIPT = """
import datetime
import sys
from pyspark.sql import SparkSession
from driftwell import catalogue
from driftwell.meta import TableMeta
from driftwell.sources import jdbc

if __name__ == "__main__":
    at = "file://" + sys.argv[1]
    spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    spark = spark.config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", at).getOrCreate()
    trip = catalogue.QUERIES["jdbc_roundtrip"](spark, "/root/testdata/sf0.001")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").createOrReplaceTempView("nation")
    assert sorted(trip.collect()) == sorted(spark.sql(catalogue.SQL["jdbc_roundtrip"]).select(*trip.columns).collect())
    url, at = "jdbc:derby:memory:all;create=true", datetime.datetime(2024, 1, 2, 3, 4, 5, 678000)
    kinds = "k long, v string, d decimal(12,3), t timestamp, f double, n int, b boolean, x date"
    rows = [(k, f"v{k}", None, at, k / 2, k, k % 2 == 0, at.date()) for k in range(2500)] + [(None,) * 8]
    jdbc.write_rows(spark.createDataFrame(rows, kinds).repartition(3), url, "every", properties={"user": "app", "password": "x"})
    got = jdbc.read_table(spark, url, "every", properties={"user": "app", "password": "x"})
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows)), got.first()
    jdbc.PAGE_ROWS = 999
    assert jdbc.read_table(spark, url, "every").count() == 2501
    assert [(c.low, c.high) for c in jdbc.plan_reads(spark, url, "every", '"k"', 1000)]
    meta = TableMeta("s", "t", ("k", "v"), unique=(("k",),), nullable=frozenset("kv"))
    jdbc.run(spark, url, ['CREATE TABLE t ("k" BIGINT, "v" VARCHAR(20))'])
    assert jdbc.read_table(spark, url, "t").count() == 0
    jdbc.write_rows(spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string"), url, "t")
    kind = "struct<k:long,v:string>"
    batch = spark.createDataFrame([("update", 1, None, (1, None), ["v"]), ("insert", 2, None, (None, "m"), []), ("insert", 4, None, (3, "c"), [])], f"op string, seq long, before {kind}, after {kind}, unchanged array<string>")
    assert jdbc.apply_batch(batch, url, "t", meta, key_types={"v": "VARCHAR(20)"}) == []
    assert sorted(map(repr, map(tuple, jdbc.read_table(spark, url, "t").collect()))) == sorted(map(repr, [(1, "a"), (3, "c"), (None, "m"), (None, "n")]))
    spark.stop()
    print("all right")
"""


def test_a_database_of_the_driver(tmp_path):
    (tmp_path / "run.py").write_text(SCRIPT)
    (tmp_path / "shared").mkdir()
    done = subprocess.run([sys.executable, str(tmp_path / "run.py"), str(tmp_path / "shared")], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert "all right" in done.stdout, done.stderr[-3000:]
