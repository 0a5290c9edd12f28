"""Queries of the check family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import kinds_of, revise_sql
from ..functions.values import network_text, same_value
from ..meta import table_meta
from ..operators import check
from ..sources import logs, structures
from .fixtures import KEYS, ORDERS_TARGET, customer_target, literal_rows, meta_of, orders_target, sql_values, table

_names = lambda c="diff_cols": F.concat_ws(",", c)


def _orders(spark, d):
    src = table(spark, d, "orders")
    return src, orders_target(src), meta_of(src, "orders")


def _case(columns: list[str], a: str = "s", b: str = "d") -> str:
    return ", ".join(f"CASE WHEN {a}.{c} IS DISTINCT FROM {b}.{c} THEN '{c}' END" for c in sorted(columns))


_ORDER_COLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_CHECKED = f"""checked AS (
  SELECT s.o_orderkey, d.o_orderkey IS NULL AS miss, CASE WHEN d.o_orderkey IS NULL THEN '' ELSE concat_ws(',', {_case(_ORDER_COLS)}) END AS diff_cols
  FROM orders s LEFT JOIN dst d ON s.o_orderkey = d.o_orderkey)"""


def check_diff_orders(spark, d) -> DataFrame:
    src, dst, meta = _orders(spark, d)
    out = check.compared(src, dst, meta).filter("kind IN ('miss', 'diff')")
    return out.select("o_orderkey", "kind", _names().alias("diff_cols"))


_DIFF = f"WITH {ORDERS_TARGET}, {_CHECKED} SELECT o_orderkey, CASE WHEN miss THEN 'miss' ELSE 'diff' END AS kind, diff_cols FROM checked WHERE miss OR diff_cols <> ''"


def check_diff_by_digest(spark, d) -> DataFrame:
    src, dst, meta = _orders(spark, d)
    return check.by_digest(src, dst, meta).select("o_orderkey", "kind", _names().alias("diff_cols"))


def check_miss_orders(spark, d) -> DataFrame:
    src, dst, meta = _orders(spark, d)
    return check.missing(src, dst, meta).select("o_orderkey", "o_custkey", "o_totalprice")


def check_stale_orders(spark, d) -> DataFrame:
    src, dst, meta = _orders(spark, d)
    return check.stale(src, dst, meta).select("o_orderkey", "o_custkey", "o_totalprice")


def check_deleted_still_there(spark, d) -> DataFrame:
    src, dst, meta = _orders(spark, d)
    return check.deleted_still_there(src.filter("o_orderkey % 41 = 0"), dst, meta).select("o_orderkey", "o_orderstatus")


def check_missing_target(spark, d) -> DataFrame:
    src, _, meta = _orders(spark, d)
    return check.missing_target(src, meta).groupBy("kind").agg(F.count("*").alias("n"))


def check_summary_by_table(spark, d) -> DataFrame:
    found = None
    for name, change in (("orders", orders_target), ("customer", customer_target), ("part", lambda x: x)):
        src = table(spark, d, name)
        one = check.compared(src, change(src), meta_of(src, name)).select(F.lit(name).alias("tb"), "kind")
        found = one if found is None else found.unionByName(one)
    return check.summary(found, ["tb"], total=True).select("tb", "checked_count", "miss_count", "diff_count", "skip_count", "is_consistent")


_SUMMARY = f"""WITH {ORDERS_TARGET}, {_CHECKED},
t AS (SELECT 'orders' AS tb, count(*) AS checked_count, count(*) FILTER (WHERE miss) AS miss_count, count(*) FILTER (WHERE diff_cols <> '') AS diff_count, 0 AS skip_count FROM checked
  UNION ALL SELECT 'customer', count(*), count(*) FILTER (WHERE c_custkey % 13 = 0), count(*) FILTER (WHERE c_custkey % 13 <> 0 AND c_custkey % 17 = 0), 0 FROM customer
  UNION ALL SELECT 'part', count(*), 0, 0, 0 FROM part)
SELECT tb, CAST(sum(checked_count) AS BIGINT) AS checked_count, CAST(sum(miss_count) AS BIGINT) AS miss_count, CAST(sum(diff_count) AS BIGINT) AS diff_count,
       CAST(sum(skip_count) AS BIGINT) AS skip_count, sum(miss_count + diff_count + skip_count) = 0 AS is_consistent FROM t GROUP BY ROLLUP (tb)"""


def check_null_key_skip(spark, d) -> DataFrame:
    src, dst, _ = _orders(spark, d)
    part = lambda df: df.withColumn("part_key", F.nullif(F.col("o_custkey") % 11, F.lit(7)))
    meta = table_meta(src, "orders", unique=[("o_orderkey", "part_key")], nullable=["part_key"])
    return check.compared(part(src), part(dst), meta).groupBy("kind").agg(F.count("*").alias("n"))


_SKIP = f"""WITH {ORDERS_TARGET},
s AS (SELECT *, nullif(o_custkey % 11, 7) AS k FROM orders), t AS (SELECT *, nullif(o_custkey % 11, 7) AS k FROM dst)
SELECT CASE WHEN s.k IS NULL THEN 'skip' WHEN d.o_orderkey IS NULL THEN 'miss' WHEN concat_ws(',', {_case(_ORDER_COLS)}) <> '' THEN 'diff' ELSE 'same' END AS kind, count(*) AS n
FROM s LEFT JOIN t d ON s.o_orderkey = d.o_orderkey AND s.k = d.k GROUP BY 1"""

_LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def check_diff_cols_capped(spark, d) -> DataFrame:
    src = table(spark, d, "lineitem")
    key = F.col("l_orderkey")
    new = {c: F.when(key % 50 == 0, F.col(c) + 1).otherwise(F.col(c)) for c in _LINE_COLS[:4]}
    new |= {c: F.when((key % 50 == 0) | (key % 51 == 0), "?").otherwise(F.col(c)) for c in _LINE_COLS[4:6]}
    new["l_shipdate"] = F.when(key % 50 == 0, F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("l_shipdate"))
    out = check.compared(src, src.withColumns(new), meta_of(src, "lineitem"), consume=True).filter("kind = 'diff'")
    return out.select(*KEYS["lineitem"], F.size("diff_cols").cast("long").alias("n_diff_cols"), F.concat_ws(",", check.capped(F.col("diff_cols"), 5)).alias("diff_cols"))


_CAPPED = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CASE WHEN l_orderkey % 50 = 0 THEN 7 ELSE 2 END AS BIGINT) AS n_diff_cols,
       CASE WHEN l_orderkey % 50 = 0 THEN 'l_discount,l_extendedprice,l_linestatus,l_quantity,l_returnflag' ELSE 'l_linestatus,l_returnflag' END AS diff_cols
FROM lineitem WHERE l_orderkey % 50 = 0 OR l_orderkey % 51 = 0"""


def check_sampled_by_key(spark, d) -> DataFrame:
    src, dst, meta = _orders(spark, d)
    return check.compared(check.sampled(src, meta, 25), dst, meta).groupBy("kind").agg(F.count("*").alias("n"))


_SAMPLED = f"""WITH {ORDERS_TARGET}, {_CHECKED}
SELECT CASE WHEN miss THEN 'miss' WHEN diff_cols <> '' THEN 'diff' ELSE 'same' END AS kind, count(*) AS n
FROM checked WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 < 25 GROUP BY 1"""


def _exact(df: DataFrame) -> DataFrame:
    return df.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))


def check_log_json(spark, d) -> DataFrame:
    src, dst, meta = _orders(spark, d)
    out = check.compared(_exact(src), _exact(dst), meta).filter("kind IN ('miss', 'diff')")
    return out.select("o_orderkey", check.log_lines(out, meta).alias("line"))


_LOG = f"""WITH {ORDERS_TARGET},
j AS (SELECT s.o_orderkey, d.o_orderkey IS NULL AS miss, s.o_orderstatus AS s1, d.o_orderstatus AS d1,
        CAST(CAST(s.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS s2, CAST(CAST(d.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS d2
      FROM orders s LEFT JOIN dst d ON s.o_orderkey = d.o_orderkey)
SELECT o_orderkey, '{{"schema":"main","tb":"orders","id_col_values":{{"o_orderkey":"' || CAST(o_orderkey AS VARCHAR) || '"}}' ||
  CASE WHEN miss THEN '' ELSE ',"diff_col_values":{{' || concat_ws(',', CASE WHEN s1 <> d1 THEN '"o_orderstatus":{{"src":"' || s1 || '","dst":"' || d1 || '"}}' END,
    CASE WHEN s2 <> d2 THEN '"o_totalprice":{{"src":"' || s2 || '","dst":"' || d2 || '"}}' END) || '}}' END || '}}' AS line
FROM j WHERE miss OR s1 <> d1 OR s2 <> d2"""


def recheck_truth_table(spark, d) -> DataFrame:
    src, dst, meta = _orders(spark, d)
    logged = src.filter("o_orderkey % 7 = 0").select("o_orderkey")
    keys = logged.unionByName(logged.select((F.col("o_orderkey") + 1_000_000).alias("o_orderkey")))
    return check.recheck(keys, src, dst, meta).select("o_orderkey", "outcome")


_RECHECK = f"""WITH {ORDERS_TARGET}, k AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 UNION SELECT o_orderkey + 1000000 FROM orders WHERE o_orderkey % 7 = 0)
SELECT k.o_orderkey, CASE WHEN s.o_orderkey IS NULL AND d.o_orderkey IS NULL THEN 'clear' WHEN d.o_orderkey IS NULL THEN 'miss' WHEN s.o_orderkey IS NULL THEN 'stale'
  WHEN concat_ws(',', {_case(_ORDER_COLS)}) <> '' THEN 'diff' ELSE 'clear' END AS outcome
FROM k LEFT JOIN orders s ON k.o_orderkey = s.o_orderkey LEFT JOIN dst d ON k.o_orderkey = d.o_orderkey"""


def check_bag_lineitem(spark, d) -> DataFrame:
    src = table(spark, d, "lineitem")
    key = F.col("l_orderkey")
    dst = src.filter(~((key % 13 == 0) & (F.col("l_linenumber") == 1))).withColumn("l_quantity", F.when(key % 17 == 0, F.col("l_quantity") + 100).otherwise(F.col("l_quantity")))
    meta = table_meta(src, "lineitem", unique=[("l_orderkey", "l_linenumber")], nullable=())
    out = check.compared(src, dst, meta, consume=True).filter("kind <> 'same'")
    return out.groupBy("l_orderkey", "l_linenumber", "kind").agg(F.count("*").alias("n"))


_REST = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_BAG = f"""WITH t AS (SELECT * REPLACE (CASE WHEN l_orderkey % 17 = 0 THEN l_quantity + 100 ELSE l_quantity END AS l_quantity) FROM lineitem WHERE NOT (l_orderkey % 13 = 0 AND l_linenumber = 1)),
s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_REST}) AS rn FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_REST}) AS rn FROM t),
j AS (SELECT s.l_orderkey, s.l_linenumber, CASE WHEN d.rn IS NULL THEN 'miss' WHEN concat_ws(',', {_case(_REST.split(', '))}) <> '' THEN 'diff' ELSE 'same' END AS kind
      FROM s LEFT JOIN d ON s.l_orderkey = d.l_orderkey AND s.l_linenumber = d.l_linenumber AND s.rn = d.rn)
SELECT l_orderkey, l_linenumber, kind, count(*) AS n FROM j WHERE kind <> 'same' GROUP BY ALL"""

_STRUCT_SRC = [("table.main.a", "CREATE TABLE a (x INT)"), ("table.main.b", "CREATE TABLE b (x INT)"), ("index.main.a.i", "CREATE INDEX i ON a (x)"), ("table.main.c", "CREATE TABLE c (x INT)")]
_STRUCT_DST = [("table.main.a", "CREATE TABLE a (x INT)"), ("table.main.b", "CREATE TABLE b (x BIGINT)"), ("table.main.d", "CREATE TABLE d (x INT)")]


def struct_diff(spark, d) -> DataFrame:
    out = check.structures(literal_rows(spark, _STRUCT_SRC, "key string, ddl string"), literal_rows(spark, _STRUCT_DST, "key string, ddl string"))
    return out.filter("kind <> 'same'").select("key", "kind", "src_ddl", "dst_ddl")


_STRUCT = f"""WITH s AS (SELECT * FROM {sql_values(_STRUCT_SRC, 'key, ddl')}), d AS (SELECT * FROM {sql_values(_STRUCT_DST, 'key, ddl')})
SELECT coalesce(s.key, d.key) AS key, CASE WHEN d.key IS NULL THEN 'miss' ELSE 'diff' END AS kind, s.ddl AS src_ddl, d.ddl AS dst_ddl
FROM s FULL JOIN d ON s.key = d.key WHERE s.ddl IS DISTINCT FROM d.ddl"""

def structure_source(spark, d) -> DataFrame:
    """The tables' own structures against those of a target that lacks one and has another type in one."""
    frames = {("main", t): table(spark, d, t) for t in ("region", "nation", "supplier")}
    other = {("main", "region"): frames["main", "region"], ("main", "nation"): frames["main", "nation"].withColumn("n_regionkey", F.col("n_regionkey").cast("long"))}
    return check.structures(structures.describe(spark, frames), structures.describe(spark, other)).select("key", "kind")


_NETS = [(1, "10.0.0.1", "10.0.0.1/32"), (2, "10.0.0.0/8", "10.0.0.0/8"), (3, "::1/128", "::1"), (4, "10.0.0.1", "10.0.0.2"), (5, None, None), (6, "10.0.0.1/32", None), (7, "10.0.0.0/24", "10.0.0.0")]


def network_equal(spark, d) -> DataFrame:
    rows = literal_rows(spark, _NETS, "id long, a string, b string")
    return rows.select("id", network_text(F.col("a")).alias("a_text"), same_value(F.col("a"), F.col("b"), network=True).alias("same"))


_NETWORK = f"""SELECT CAST(id AS BIGINT) AS id, regexp_replace(a, '/(32|128)$', '') AS a_text,
  regexp_replace(a, '/(32|128)$', '') IS NOT DISTINCT FROM regexp_replace(b, '/(32|128)$', '') AS same FROM {sql_values(_NETS, 'id, a, b')}"""


def doc_diff(spark, d) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "props", F.when(F.col("event_id") % 7 == 0, F.lit('{"k": 0, "z": "new"}')).otherwise(F.col("props")).alias("now"))
    return events.select("event_id", F.explode(check.documents(F.col("props"), F.col("now"))).alias("field", "v")).select("event_id", "field", "v.src", "v.dst")


_DOC = """WITH e AS (SELECT event_id, props, CASE WHEN event_id % 7 = 0 THEN '{"k": 0, "z": "new"}' ELSE props END AS now FROM events),
f AS (SELECT event_id, k.field, json_extract_string(props, '$.' || k.field) AS src, json_extract_string(now, '$.' || k.field) AS dst FROM e, (VALUES ('k'), ('z')) AS k(field))
SELECT event_id, field, src, dst FROM f WHERE src IS DISTINCT FROM dst"""


def revise_statements(spark, d) -> DataFrame:
    src, dst, meta = _orders(spark, d)
    pick = lambda df: _exact(df).select("o_orderkey", "o_orderstatus", "o_totalprice")
    small = table_meta(pick(src), "orders", KEYS["orders"], nullable=())
    out = check.compared(pick(src), pick(dst), small, "full").filter("kind <> 'same'")
    return out.select("o_orderkey", revise_sql(small, kinds_of(pick(src).schema)).alias("statement"))


_REVISE = f"""WITH {ORDERS_TARGET},
j AS (SELECT s.o_orderkey AS sk, d.o_orderkey AS dk, s.o_orderstatus AS s1, d.o_orderstatus AS d1, CAST(s.o_totalprice AS DECIMAL(18,2)) AS s2, CAST(d.o_totalprice AS DECIMAL(18,2)) AS d2
      FROM orders s FULL JOIN dst d ON s.o_orderkey = d.o_orderkey)
SELECT coalesce(sk, dk) AS o_orderkey, CASE
  WHEN dk IS NULL THEN 'INSERT INTO `main`.`orders`(`o_orderkey`,`o_orderstatus`,`o_totalprice`) VALUES(' || CAST(sk AS VARCHAR) || ',''' || s1 || ''',' || CAST(s2 AS VARCHAR) || ');'
  WHEN sk IS NULL THEN 'DELETE FROM `main`.`orders` WHERE `o_orderkey` = ' || CAST(dk AS VARCHAR) || ';'
  ELSE 'UPDATE `main`.`orders` SET ' || concat_ws(',', CASE WHEN s1 <> d1 THEN '`o_orderstatus`=''' || s1 || '''' END, CASE WHEN s2 <> d2 THEN '`o_totalprice`=' || CAST(s2 AS VARCHAR) END)
       || ' WHERE `o_orderkey` = ' || CAST(dk AS VARCHAR) || ';' END AS statement
FROM j WHERE sk IS NULL OR dk IS NULL OR s1 <> d1 OR s2 <> d2"""


def review_from_log(spark, d) -> DataFrame:
    """The log of a check is read back, and its keys are compared again against a target that has been repaired in part."""
    src, dst, meta = _orders(spark, d)
    found = check.compared(src, dst, meta).filter("kind IN ('miss', 'diff')")
    lines = found.select(check.log_lines(found, meta).alias("line"))
    again = logs.rows_to_revise(logs.parse_lines(lines, "line"), src, meta)
    repaired = dst.filter("o_orderkey % 2 = 1").unionByName(src.filter("o_orderkey % 2 = 0"))
    return check.compared(again, repaired, meta).groupBy("kind").agg(F.count("*").alias("n"))


_REVIEW = f"""WITH {ORDERS_TARGET}, {_CHECKED}
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'same' WHEN miss THEN 'miss' ELSE 'diff' END AS kind, count(*) AS n FROM checked WHERE miss OR diff_cols <> '' GROUP BY 1"""


def newest_lines(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type")).alias("line"))
    return check.newest_lines(rows, "event_id", "line", 500, 4000)


_NEWEST = """WITH t AS (SELECT event_id, 'event ' || CAST(event_id AS VARCHAR) || ' ' || event_type AS line FROM events ORDER BY event_id DESC LIMIT 500)
SELECT event_id, line FROM (SELECT *, sum(octet_length(encode(line)) + 1) OVER (ORDER BY event_id DESC) AS size FROM t) WHERE size <= 4000"""

QUERIES = {f.__name__: f for f in (
    check_diff_orders, check_diff_by_digest, check_miss_orders, check_stale_orders, check_deleted_still_there, check_missing_target, check_summary_by_table, check_null_key_skip,
    check_diff_cols_capped, check_sampled_by_key, check_log_json, recheck_truth_table, check_bag_lineitem, struct_diff, structure_source, network_equal, doc_diff, review_from_log, newest_lines,
)} | {"revise_sql": revise_statements}
SQL = {
    "check_diff_orders": _DIFF, "check_diff_by_digest": _DIFF,
    "check_miss_orders": f"WITH {ORDERS_TARGET} SELECT o_orderkey, o_custkey, o_totalprice FROM orders s WHERE NOT EXISTS (SELECT 1 FROM dst WHERE dst.o_orderkey = s.o_orderkey)",
    "check_stale_orders": f"WITH {ORDERS_TARGET} SELECT o_orderkey, o_custkey, o_totalprice FROM dst WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE dst.o_orderkey = s.o_orderkey)",
    "check_deleted_still_there": f"WITH {ORDERS_TARGET} SELECT o_orderkey, o_orderstatus FROM dst WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 41 = 0)",
    "check_missing_target": "SELECT 'miss' AS kind, count(*) AS n FROM orders", "check_summary_by_table": _SUMMARY, "check_null_key_skip": _SKIP, "check_diff_cols_capped": _CAPPED,
    "check_sampled_by_key": _SAMPLED, "check_log_json": _LOG, "recheck_truth_table": _RECHECK, "check_bag_lineitem": _BAG, "struct_diff": _STRUCT, "structure_source": "SELECT * FROM (VALUES ('table.main.region', 'same'), ('table.main.nation', 'diff'), ('table.main.supplier', 'miss')) AS v(key, kind)", "network_equal": _NETWORK,
    "doc_diff": _DOC, "revise_sql": _REVISE, "review_from_log": _REVIEW, "newest_lines": _NEWEST,
}
