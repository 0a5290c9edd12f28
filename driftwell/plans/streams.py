"""Queries that run a stream to its end, or go through a database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import table_meta
from ..operators import apply, check
from ..sources import files, jdbc
from ..sources.scan import Chunk
from ..sources.shared import scratch
from ..streaming import tables, unresolved
from . import task
from .fixtures import CUSTOMER_AFTER, KEYS, LAST_EVENTS, ORDERS_TARGET, USER_META, customer_changes, customer_target, event_changes, orders_target, table
from .merges import NAMES_TAKEN, name_takers


def _arriving(rows: DataFrame, order: str, at: str, parts: int = 4) -> None:
    """Files in the order of their arrival."""
    rows.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(at)


def stream_apply_batches(spark, d) -> DataFrame:
    """Changes arrive in files; each micro-batch's net effect is logged, half of them are folded, and the table is read."""
    at = scratch(spark, "stream")
    rows = event_changes(table(spark, d, "events"))
    _arriving(rows, "seq", f"{at}/in")
    columns = rows.schema["after"].dataType
    stream = files.stream_changes(spark, f"{at}/in", columns, "parquet", files_per_batch=1)
    target = tables.ChangeTable(spark, f"{at}/table", USER_META, columns)
    target.follow(stream, f"{at}/checkpoint", once=True).awaitTermination()
    target.fold()
    return target.read()


_STREAM = f"WITH {LAST_EVENTS} SELECT user_id, value, props FROM last WHERE op <> 'delete'"


def stream_unresolved_state(spark, d) -> DataFrame:
    at = scratch(spark, "unresolved")
    kind = F.when(F.col("event_type") == "error", "miss").when(F.col("event_type") == "view", "diff").otherwise("same")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), kind.alias("kind"), F.col("event_id").alias("seq"))
    _arriving(rows, "seq", f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    unresolved.follow(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return unresolved.current(spark.read.schema(unresolved.OUT).parquet(f"{at}/out/*"))


_UNRESOLVED = """SELECT CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'error' THEN 'miss' ELSE 'diff' END AS kind, event_id AS seq
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type IN ('error', 'view')"""


def stream_positions(spark, d) -> DataFrame:
    at = scratch(spark, "positions")
    rows = table(spark, d, "events").select("event_type", F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("position"))
    _arriving(rows, "seq", f"{at}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    stream.writeStream.foreachBatch(tables.record_positions(f"{at}/positions", ["event_type"])).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return tables.positions(spark, f"{at}/positions", ["event_type"])


def jdbc_roundtrip(spark, d) -> DataFrame:
    """A table in an embedded database: written, changed by a batch, read by chunks."""
    nation = table(spark, d, "nation")
    url = f"jdbc:derby:memory:{scratch(spark, 'db').rsplit('/', 1)[1].replace('-', '')};create=true"
    meta = table_meta(nation, "nation", ["n_nationkey"], nullable=())
    jdbc.write_rows(nation, url, "nation", "overwrite")
    key = F.col("n_nationkey")
    image = lambda name: F.struct("n_nationkey", name.alias("n_name"), "n_regionkey")
    none = F.lit(None).cast(nation.schema)
    op = F.when(key % 5 == 0, "delete").when(key % 3 == 0, "update")
    rows = nation.withColumn("op", op).filter("op IS NOT NULL").select("op", F.lit(1).cast("long").alias("seq"), image(F.col("n_name")).alias("before"), F.when(F.col("op") == "update", image(F.lower("n_name"))).otherwise(none).alias("after"))
    jdbc.apply_batch(rows, url, "nation", meta)
    return jdbc.read_table(spark, url, "nation", "n_nationkey", [Chunk(1, None, 8), Chunk(2, 8, 16), Chunk(3, 16, None)])


_JDBC = "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey % 5 <> 0"


def audited_stream_view(spark, d) -> DataFrame:
    """An append-only table of every change and its live rows."""
    log = apply.append_audited(event_changes(table(spark, d, "events")), USER_META)
    return apply.latest_view(log, USER_META).select("user_id", "value", "props")


_TASK = """
[filter]
do_tbs=main.orders,main.cust*
ignore_cols=json:[{"db":"main","tb":"customer","ignore_cols":["c_mktsegment"]}]
where_conditions=json:[{"db":"main","tb":"orders","condition":"o_orderkey % 2 = 0"}]
[router]
tb_map=main.customer:dw.clients
col_map=json:[{"db":"main","tb":"customer","col_map":{"c_acctbal":"balance"}}]
[checker]
output_revise_sql=true
"""


def _task(spark, d):
    read = lambda schema, name: table(spark, d, name)
    metas = [table_meta(read("main", n), n, KEYS[n], nullable=()) for n in ("orders", "customer", "part")]
    return task.TaskSpec.read(_TASK), read, metas


def task_check(spark, d) -> DataFrame:
    """Three tables, of which a task file leaves out one, renames one and takes a part of one."""
    spec, read, metas = _task(spark, d)
    orders, clients = orders_target(read("main", "orders")), customer_target(read("main", "customer")).withColumnRenamed("c_acctbal", "balance")
    found = task.check_tables(spec, read, lambda schema, name: {"orders": orders, "clients": clients}[name], metas)
    shown = found.groupBy("schema", "tb").agg(F.count("line").cast("long").alias("lines"), F.count_if(F.col("statement").isNotNull() & (F.col("kind") != "same")).alias("statements"))
    return check.summary(found, total=False).join(shown, ["schema", "tb"]).select("schema", "tb", "checked_count", "miss_count", "diff_count", "skip_count", "lines", "statements")


_TASK_SQL = f"""WITH {ORDERS_TARGET}, o AS (SELECT d.o_orderkey IS NULL AS miss, d.o_orderkey IS NOT NULL AND (s.o_orderstatus <> d.o_orderstatus OR s.o_totalprice <> d.o_totalprice) AS diff
  FROM orders s LEFT JOIN dst d ON s.o_orderkey = d.o_orderkey WHERE s.o_orderkey % 2 = 0),
c AS (SELECT c_custkey % 13 = 0 AS miss, c_custkey % 13 <> 0 AND c_custkey % 17 = 0 AS diff FROM customer), a AS (SELECT 'orders' AS tb, * FROM o UNION ALL SELECT 'customer', * FROM c)
SELECT 'main' AS schema, tb, count(*) AS checked_count, count(*) FILTER (WHERE miss) AS miss_count, count(*) FILTER (WHERE diff) AS diff_count, CAST(0 AS BIGINT) AS skip_count,
  count(*) FILTER (WHERE miss OR diff) AS lines, count(*) FILTER (WHERE miss OR diff) AS statements FROM a GROUP BY tb"""


def task_cdc(spark, d) -> DataFrame:
    """A table's changes under the target's names."""
    spec, read, metas = _task(spark, d)
    customer = read("main", "customer")
    target = customer.drop("c_mktsegment").withColumnRenamed("c_acctbal", "balance")
    out = task.cdc(spec, lambda s, t: customer_changes(customer), lambda s, t: target, [m for m in metas if m.table == "customer"])
    return out["dw", "clients"]


def task_cdc_unique(spark, d) -> DataFrame:
    """Suppliers take each other's unique names, through a task whose target writes by REPLACE."""
    supplier = table(spark, d, "supplier")
    meta = table_meta(supplier, "supplier", KEYS["supplier"], [("s_name",)], nullable=())
    spec = task.TaskSpec.read("[filter]\ndo_tbs=main.supplier\n[sinker]\ndb_type=mysql\nreplace=true\n")
    return task.cdc(spec, lambda s, t: name_takers(supplier), lambda s, t: supplier, [meta])["main", "supplier"]


QUERIES = {f.__name__: f for f in (task_check, task_cdc, task_cdc_unique, stream_apply_batches, stream_unresolved_state, stream_positions, jdbc_roundtrip, audited_stream_view)}
SQL = {
    "task_check": _TASK_SQL, "task_cdc_unique": NAMES_TAKEN, "task_cdc": f"SELECT c_custkey, c_name, c_nationkey, c_acctbal AS balance FROM ({CUSTOMER_AFTER})",
    "stream_apply_batches": _STREAM, "stream_unresolved_state": _UNRESOLVED, "audited_stream_view": _STREAM, "jdbc_roundtrip": _JDBC,
    "stream_positions": "SELECT event_type, CAST(max(event_id) AS VARCHAR) AS position, max(event_id) AS seq FROM events GROUP BY event_type",
}
