"""Deterministic targets and change streams made from the tables, as frames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import TableMeta, table_meta


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}


def meta_of(df: DataFrame, name: str) -> TableMeta:
    return table_meta(df, name, KEYS[name], nullable=())


def orders_target(orders: DataFrame) -> DataFrame:
    """Orders with rows lost, changed in one or two columns, and left over."""
    key = F.col("o_orderkey")
    kept = orders.filter(key % 97 != 0).withColumns({
        "o_totalprice": F.when(key % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        "o_orderstatus": F.when(key % 83 == 0, "X").otherwise(F.col("o_orderstatus")),
    })
    return kept.unionByName(orders.filter(key % 101 == 0).withColumn("o_orderkey", key + 1_000_000))


ORDERS_TARGET = """dst AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 83 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 101 = 0)"""


def customer_target(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.filter(key % 13 != 0).withColumn("c_acctbal", F.when(key % 17 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))


def _change(op: str, seq: int, before, after):
    return F.struct(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), before.alias("before"), after.alias("after"), F.array().cast("array<string>").alias("unchanged"))


def customer_changes(customer: DataFrame, moves: bool = True) -> DataFrame:
    """Updates of every fifth customer (1), deletes of every seventh (2), some written again as new (3), some under another key (4)."""
    columns = customer.columns
    image = lambda **new: F.struct(*[new.get(c, F.col(c)).alias(c) for c in columns])
    none = F.lit(None).cast(customer.schema)
    key, richer = F.col("c_custkey"), F.col("c_acctbal") + 10
    now = F.when(key % 5 == 0, richer).otherwise(F.col("c_acctbal"))
    made = [
        F.when(key % 5 == 0, _change("update", 1, image(), image(c_acctbal=richer))),
        F.when(key % 7 == 0, _change("delete", 2, image(c_acctbal=now), none)),
        F.when(key % 35 == 0, _change("insert", 3, none, image(c_mktsegment=F.lit("NEW")))),
    ]
    if moves:
        made.append(F.when((key % 11 == 0) & (key % 7 != 0), _change("update", 4, image(c_acctbal=now), image(c_custkey=key + 1_000_000, c_acctbal=now))))
    return customer.select(F.inline(F.array_compact(F.array(*made))))


#: The customers after ``customer_changes`` with moves.
CUSTOMER_AFTER = """
SELECT CASE WHEN c_custkey % 11 = 0 AND c_custkey % 7 <> 0 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey, c_name, c_nationkey,
       CASE WHEN c_custkey % 5 = 0 AND c_custkey % 35 <> 0 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 35 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 35 = 0"""

OP_OF_EVENT = {"signup": "insert", "error": "delete"}


def event_changes(events: DataFrame) -> DataFrame:
    """Events as changes of a user's row (user_id, value, props): sign-ups insert, errors delete, the rest update."""
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    image = F.struct("user_id", "value", "props")
    key_only = F.struct("user_id", F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props"))
    return events.select(op.alias("op"), F.col("event_id").alias("seq"), F.when(op != "insert", key_only).alias("before"), F.when(op != "delete", image).alias("after"), F.array().cast("array<string>").alias("unchanged"))


USER_META = TableMeta("main", "users", ("user_id", "value", "props"), ("user_id",))

#: Each user's last event.
LAST_EVENTS = """last AS (
  SELECT user_id, event_id, event_type, value, props,
         CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)"""


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"
