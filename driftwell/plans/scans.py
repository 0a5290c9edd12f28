"""Queries over snapshot scans, filters, routes and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import slots, sqltext, types, values

from ..operators import changes, ddl, documents, envelopes, filters, keyvalue, metrics, routing, rows
from ..sources import scan
from .fixtures import customer_changes, literal_rows, meta_of, sql_values, table


def snapshot_scan(spark, d) -> DataFrame:
    """A table under a row condition and without some columns, its columns renamed for the target."""
    where = filters.TableFilter(ignore_columns={("main", "orders"): frozenset({"o_orderpriority", "o_orderdate"})}, conditions={("main", "orders"): "o_totalprice > 250000 AND o_orderstatus = 'F'"})
    route = routing.Router(tables={("main", "orders"): ("dw", "sales")}, columns={("main", "orders"): {"o_orderkey": "order_id", "o_totalprice": "price"}})
    return route.rename(where.prune(table(spark, d, "orders"), "main", "orders"), "main", "orders")


def split_even_chunks(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    chunks = scan.plan_chunks(orders, "o_orderkey", 1000)
    return scan.with_chunk(orders, "o_orderkey", chunks).groupBy("chunk").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.count("*").alias("n"))


_EVEN = """WITH s AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders), w AS (SELECT lo, greatest(CAST(floor((hi - lo + 1) / n * 1000) AS BIGINT), 1) AS step, n FROM s)
SELECT CASE WHEN n <= 1000 THEN 1 ELSE greatest((o_orderkey - lo + step - 1) // step, 1) END AS chunk, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders, w GROUP BY 1"""


def split_uneven_chunks(spark, d) -> DataFrame:
    return scan.uneven_chunks(table(spark, d, "events").filter("event_id % 7 <> 3"), "event_id", 3000)


_UNEVEN = """WITH n AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 3000 + 1 AS chunk FROM events WHERE event_id % 7 <> 3),
c AS (SELECT chunk, max(event_id) AS high, count(*) AS r FROM n GROUP BY chunk) SELECT CAST(chunk AS BIGINT) AS chunk, lag(high) OVER (ORDER BY chunk) AS low, high, r AS rows FROM c"""


def chunk_row_counts(spark, d) -> DataFrame:
    return scan.with_row_chunks(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], 10_000).groupBy("chunk").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))


_ROW_CHUNKS = """WITH p AS (SELECT l_orderkey, (row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1) // 10000 + 1 AS chunk FROM lineitem)
SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n, min(l_orderkey) AS first FROM p GROUP BY 1"""

_DONE = [(1, 2, 20), (2, 3, None), (3, 1, 10), (4, 5, 50), (5, 7, 70), (6, 4, None), (7, 9, 90), (8, 6, None)]


def checkpoint_prefix(spark, d) -> DataFrame:
    return scan.checkpoints(literal_rows(spark, _DONE, "done_order long, chunk long, last_key long"))


_PREFIX = f"""WITH done AS (SELECT CAST(done_order AS BIGINT) AS done_order, CAST(chunk AS BIGINT) AS chunk, CAST(last_key AS BIGINT) AS last_key FROM {sql_values(_DONE, 'done_order, chunk, last_key')}),
r AS (SELECT *, max(done_order) OVER (ORDER BY chunk) AS ready, count(*) OVER (ORDER BY chunk) AS c FROM done)
SELECT ready AS done_order, max(chunk) AS chunk, arg_max(last_key, chunk) FILTER (WHERE last_key IS NOT NULL) AS last_key FROM r WHERE c = chunk GROUP BY ready HAVING count(last_key) > 0"""


def null_pass_union(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 11, F.lit(7)).alias("k"))
    return scan.keyed_and_null(rows, ["k"])


def sample_topn(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return scan.top_sample(docs, ["doc_id"], 7)


_TOPN = "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT (SELECT greatest(1, (count(*) * 7 + 99) // 100) FROM documents)"


def keyset_page(spark, d) -> DataFrame:
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return scan.page(table(spark, d, "lineitem").select(*key, "l_quantity"), key, [700, 100, 5, 3], 250)


_PAGE = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_partkey, l_suppkey, l_linenumber) > (700, 100, 5, 3)
ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 250"""

_TABLES = [("db_1", "orders"), ("db_1", "orders_bak"), ("db_1", "a.b"), ("db_2", "t1"), ("db_2", "t12"), ("db_2", "t123"), ("Db_3", "Upper_Case"), ("x", "log_2024"), ("x", "log_old"), ("x*", "y")]
_SETTINGS = {"do_dbs": "db_1,`x*`", "ignore_dbs": "", "do_tbs": "db_2.t1?,x.r#log_\\d+#,Db_?.Upper_*", "ignore_tbs": "db_1.*_bak"}


def filter_tables_pattern(spark, d) -> DataFrame:
    rule = filters.TableFilter.read(_SETTINGS)
    names = literal_rows(spark, _TABLES, "schema string, tb string")
    return names.select("schema", "tb", rule.table_kept(F.col("schema"), F.col("tb")).alias("kept"), rule.schema_kept(F.col("schema")).alias("schema_kept"))


_PATTERN = rf"""SELECT schema, tb, (schema = 'db_1' OR schema = 'x*' OR (schema = 'db_2' AND regexp_full_match(tb, 't1.?')) OR (schema = 'x' AND regexp_full_match(tb, 'log_\d+')) OR (regexp_full_match(schema, 'Db_.?') AND regexp_full_match(tb, 'Upper_.*')))
  AND NOT (schema = 'db_1' AND regexp_full_match(tb, '.*_bak')) AS kept,
  schema IN ('db_1', 'x*', 'db_2', 'x') OR regexp_full_match(schema, 'Db_.?') AS schema_kept FROM {sql_values(_TABLES, 'schema, tb')}"""


def route_columns(spark, d) -> DataFrame:
    """Changes of nations under the target's names, tables too."""
    route = routing.Router.read({"db_map": "main:dw", "tb_map": "main.nation:geo.countries", "col_map": 'json:[{"db":"main","tb":"nation","col_map":{"n_name":"label","n_regionkey":"region"}}]'})
    back = route.reverse()
    rows = route.rename_images(changes.snapshot_changes(table(spark, d, "nation")), "main", "nation")
    names = route.routed_names(F.lit("main"), F.when(F.col("after.region") == 1, "other").otherwise("nation"))
    origin = back.routed_names(F.col("t.schema"), F.col("t.table"))
    return rows.select("after.*", names.alias("t")).select("n_nationkey", "label", "region", F.col("t.schema").alias("schema"), F.col("t.table").alias("tb"), F.concat_ws(".", origin["schema"], origin["table"]).alias("origin"))


_ROUTE = """SELECT n_nationkey, n_name AS label, n_regionkey AS region, CASE WHEN n_regionkey = 1 THEN 'dw' ELSE 'geo' END AS schema, CASE WHEN n_regionkey = 1 THEN 'other' ELSE 'countries' END AS tb,
  CASE WHEN n_regionkey = 1 THEN 'main.other' ELSE 'main.nation' END AS origin FROM nation"""


def route_topics(spark, d) -> DataFrame:
    topics = routing.read_topics("*.*:all,db_1.*:one,db_1.orders:orders")
    return literal_rows(spark, _TABLES, "schema string, tb string").withColumn("topic", routing.topic(F.col("schema"), F.col("tb"), topics))


_TOPICS = f"SELECT schema, tb, CASE WHEN schema = 'db_1' AND tb = 'orders' THEN 'orders' WHEN schema = 'db_1' THEN 'one' ELSE 'all' END AS topic FROM {sql_values(_TABLES, 'schema, tb')}"

_KINDS = ["int unsigned", "bigint unsigned", "decimal(10,4)", "decimal(65,30)", "char(30)", "char(100)", "varchar(255)", "varchar(20000)", "datetime(6)", "blob", "json", "bit(64)", "year", "mediumint", "geometry"]
_EXPECTED = [  # clickhouse, starrocks, doris
    ("int unsigned", "UInt32", "BIGINT", "BIGINT"), ("bigint unsigned", "UInt64", "LARGEINT", "LARGEINT"), ("decimal(10,4)", "Decimal(10,4)", "DECIMAL(10,4)", "DECIMAL(10,4)"),
    ("decimal(65,30)", "Decimal(65,30)", "STRING", "STRING"), ("char(30)", "String", "CHAR(120)", "CHAR(120)"), ("char(100)", "String", "CHAR(255)", "CHAR(255)"),
    ("varchar(255)", "String", "VARCHAR(1020)", "VARCHAR(1020)"), ("varchar(20000)", "String", "VARCHAR(65533)", "VARCHAR(65533)"), ("datetime(6)", "DateTime64(6)", "DATETIME", "DATETIME(6)"),
    ("blob", "String", "VARBINARY", "STRING"), ("json", "String", "JSON", "JSON"), ("bit(64)", "UInt64", "BIGINT", "BIGINT"), ("year", "Int32", "INT", "INT"),
    ("mediumint", "Int32", "INT", "INT"), ("geometry", "String", "VARBINARY", "STRING"),
]


def target_type_map(spark, d) -> DataFrame:
    rows = literal_rows(spark, [(k,) for k in _KINDS], "kind string")
    return rows.select("kind", *[types.target_type_column(F.col("kind"), _KINDS, "mysql", t).alias(t) for t in types.TARGETS])


def redis_hash_rows(spark, d) -> DataFrame:
    supplier = table(spark, d, "supplier").withColumn("s_acctbal", F.col("s_acctbal").cast("decimal(18,2)"))
    out = keyvalue.row_commands(changes.snapshot_changes(supplier), meta_of(supplier, "supplier"))
    return out.select("key", F.array_join("args", " ").alias("command"))


_REDIS = """SELECT 'main.supplier.' || CAST(s_suppkey AS VARCHAR) AS key, 'hset main.supplier.' || CAST(s_suppkey AS VARCHAR) || ' s_suppkey ' || CAST(s_suppkey AS VARCHAR) || ' s_name ' || s_name ||
  ' s_nationkey ' || CAST(s_nationkey AS VARCHAR) || ' s_acctbal ' || CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS command FROM supplier"""


def redis_slot(spark, d) -> DataFrame:
    key = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("a{"), F.col("c_mktsegment"), F.lit("}"), F.col("c_name"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", slots.slot(key).cast("long").alias("slot"))


_SLOT = f"""WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS key FROM customer),
d AS (SELECT c_custkey, list_prepend(0, list_transform(string_split(hex(encode(key)), ''), lambda x: strpos('0123456789ABCDEF', x) - 1)) AS digits FROM k)
SELECT c_custkey, CAST(list_reduce(digits, lambda c, x: xor((c << 4) & 65535, {slots.nibble_table()}[xor(c >> 12, x) + 1])) & 16383 AS BIGINT) AS slot FROM d"""


def redis_route(spark, d) -> DataFrame:
    """Sets to the node of their key; every hundredth command has no key and goes to all three nodes."""
    name = F.when(F.col("c_custkey") % 100 == 0, F.array(F.lit("PING"))).otherwise(F.array(F.lit("SET"), F.col("c_name"), F.lit("1")))
    rows = table(spark, d, "customer").select(name.alias("args"))
    return keyvalue.route_commands(rows, [(0, 5460), (5461, 10922), (10923, 16383)]).groupBy("node").agg(F.count("*").alias("n")).withColumn("node", F.col("node").cast("long"))


_NODE = f"""WITH d AS (SELECT c_custkey, list_prepend(0, list_transform(string_split(hex(encode(c_name)), ''), lambda x: strpos('0123456789ABCDEF', x) - 1)) AS digits FROM customer),
s AS (SELECT c_custkey, list_reduce(digits, lambda c, x: xor((c << 4) & 65535, {slots.nibble_table()}[xor(c >> 12, x) + 1])) & 16383 AS slot FROM d),
n AS (SELECT CASE WHEN slot <= 5460 THEN 0 WHEN slot <= 10922 THEN 1 ELSE 2 END AS node FROM s WHERE c_custkey % 100 <> 0 UNION ALL SELECT unnest([0, 1, 2]) FROM s WHERE c_custkey % 100 = 0)
SELECT CAST(node AS BIGINT) AS node, count(*) AS n FROM n GROUP BY 1"""


def _samples(spark, d):
    return table(spark, d, "events").select("event_type", "user_id", "ts", F.floor("value").cast("long").alias("value"))


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def metrics_per_second(spark, d) -> DataFrame:
    return metrics.per_second(_samples(spark, d), ["event_type"]).select("event_type", _stamp("second"), "total", "n", "largest", "least")


_SECOND = """SELECT event_type, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS second, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, count(*) AS n,
  max(CAST(floor(value) AS BIGINT)) AS largest, min(CAST(floor(value) AS BIGINT)) AS least FROM events GROUP BY event_type, date_trunc('second', ts)"""


def metrics_rt(spark, d) -> DataFrame:
    out = metrics.window_statistics(_samples(spark, d), ["event_type"], "1 hour")
    return out.select("event_type", _stamp("window_start"), *[c for c in out.columns if c not in ("event_type", "window_start")])


_STATS = f"""WITH s AS (SELECT event_type, date_trunc('second', ts) AS second, sum(CAST(floor(value) AS BIGINT)) AS total, count(*) AS n, max(CAST(floor(value) AS BIGINT)) AS largest,
  min(CAST(floor(value) AS BIGINT)) AS least FROM events GROUP BY ALL)
SELECT event_type, strftime(date_trunc('hour', second), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(sum(total) AS BIGINT) AS sum, CAST(sum(n) AS BIGINT) AS count, max(largest) AS max, min(least) AS min,
  CAST(max(total) AS BIGINT) AS max_by_sec, CAST(min(total) AS BIGINT) AS min_by_sec, CAST(sum(total) // sum(n) AS BIGINT) AS avg, CAST(sum(total) // count(*) AS BIGINT) AS avg_by_sec
FROM s GROUP BY event_type, date_trunc('hour', second)"""


def metrics_members(spark, d) -> DataFrame:
    """Statistics of each user's events as those of members, over each kind of event."""
    own = _samples(spark, d).groupBy("event_type", "user_id").agg(F.max("value").alias("top"), F.min("value").alias("low"), F.count("*").alias("n"), F.max_by("value", "ts").alias("last"), F.max("ts").alias("at"))
    return metrics.over_members(own, ["event_type"], {"top": "max", "low": "min", "n": "add", "last": "latest"})


_MEMBERS = """SELECT event_type, max(CAST(floor(value) AS BIGINT)) AS top, min(CAST(floor(value) AS BIGINT)) AS low, count(*) AS n, arg_max(CAST(floor(value) AS BIGINT), ts) AS last FROM events GROUP BY event_type"""


def progress(spark, d) -> DataFrame:
    done = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("event_id") % 3 == 0).alias("finished"), F.count("*").alias("total"))
    return done.withColumn("progress", scan.progress(F.col("finished"), F.col("total")))


_PROGRESS = "SELECT event_type, count(*) FILTER (WHERE event_id % 3 = 0) AS finished, count(*) AS total, count(*) FILTER (WHERE event_id % 3 = 0) * 100 // count(*) AS progress FROM events GROUP BY event_type"


def row_sizes(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.groupBy("o_orderstatus").agg(F.sum(values.row_bytes(orders.schema)).alias("bytes"))


_SIZES = "SELECT o_orderstatus, CAST(sum(8 + 8 + octet_length(encode(o_orderstatus)) + 8 + 8 + octet_length(encode(o_orderpriority))) AS BIGINT) AS bytes FROM orders GROUP BY 1"


def avro_envelope(spark, d) -> DataFrame:
    customer = table(spark, d, "customer")
    out = envelopes.envelopes(customer_changes(customer), meta_of(customer, "customer"))
    kinds = F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["avro_type"])), ",")
    return out.select("key", "schema", "tb", "operation", kinds.alias("fields"), F.col("before")["c_name"].alias("before_name"), F.col("after")["c_mktsegment"].alias("after_segment"))


_FIELDS = "c_acctbal:Double,c_custkey:Long,c_mktsegment:String,c_name:String,c_nationkey:Long"
_AVRO = f"""WITH c AS (SELECT *, CAST(c_custkey AS VARCHAR) AS key FROM customer)
SELECT key, 'main' AS schema, 'customer' AS tb, 'update' AS operation, '{_FIELDS}' AS fields, c_name AS before_name, c_mktsegment AS after_segment FROM c WHERE c_custkey % 5 = 0
UNION ALL SELECT key, 'main', 'customer', 'delete', '{_FIELDS}', c_name, NULL FROM c WHERE c_custkey % 7 = 0
UNION ALL SELECT key, 'main', 'customer', 'insert', '{_FIELDS}', NULL, 'NEW' FROM c WHERE c_custkey % 35 = 0
UNION ALL SELECT key, 'main', 'customer', 'update', '{_FIELDS}', c_name, c_mktsegment FROM c WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0"""


def avro_round_trip(spark, d) -> DataFrame:
    """Customers' changes as Avro data and back."""
    customer = table(spark, d, "customer")
    data = envelopes.to_avro(envelopes.envelopes(changes.snapshot_changes(customer), meta_of(customer, "customer")))
    return envelopes.changes_of(envelopes.from_avro(data), customer.schema, F.lit(0)).select("after.*")


def precheck_tables(spark, d) -> DataFrame:
    """A table for each nation: some with a primary key, some with a unique one, some with neither; foreign keys to tables of regions, one of which takes no part."""
    nation = table(spark, d, "nation").select(F.lit("db").alias("schema"), F.col("n_name").alias("tb"), "n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("to"), "n_regionkey")
    k, none = F.col("n_nationkey") % 3, F.lit(None).cast("string")
    rule = lambda kind, schema, ref: F.struct(F.lit(kind).alias("kind"), schema.alias("ref_schema"), ref.alias("ref_tb"))
    foreign = rule("FOREIGN KEY", F.when(F.col("n_regionkey") == 2, "other").otherwise("db"), F.col("to"))
    keys = nation.select("schema", "tb", F.inline(F.array_compact(F.array(F.when(k == 0, rule("PRIMARY KEY", none, none)), F.when(k == 1, rule("UNIQUE", none, none)), foreign))))
    return ddl.precheck(nation.select("schema", "tb"), keys, filters.TableFilter(do_schemas=frozenset({"db"})).table_kept)


_PRECHECK = """SELECT 'db.' || n_name AS item, 'warning' AS level FROM nation WHERE n_nationkey % 3 = 2
UNION ALL SELECT DISTINCT 'other.r2', 'error' FROM nation WHERE n_regionkey = 2"""


_LITERALS = T.StructType().add("id", "long").add("t", "string").add("f", "double").add("b", "binary").add("d", "date")


def sql_literals(spark, d) -> DataFrame:
    import datetime

    day = datetime.date(2024, 2, 29)
    made = spark.createDataFrame([(1, "it's", 1.5, b"\x00\xff", day), (2, None, float("nan"), None, None), (3, "", float("-inf"), b"", day), (4, "a\\b", float("inf"), b"ab", day)], _LITERALS)
    return made.select("id", *[sqltext.literal(F.col(f.name), f.dataType, q).alias(f"{q}_{f.name}") for q in ("mysql", "pg") for f in _LITERALS if f.name != "id"])


_LIT = r"""SELECT CAST(id AS BIGINT) AS id, t AS mysql_t, f AS mysql_f, mb AS mysql_b, dd AS mysql_d, t AS pg_t, f AS pg_f, pb AS pg_b, dd AS pg_d FROM (VALUES
  (1, '''it''''s''', '1.5', 'x''00ff''', '''\x00ff''', '''2024-02-29'''), (2, 'NULL', '''NaN''', 'NULL', 'NULL', 'NULL'),
  (3, '''''', '''-Infinity''', 'x''''', '''\x''', '''2024-02-29'''), (4, '''a\b''', '''Infinity''', 'x''6162''', '''\x6162''', '''2024-02-29''')) AS v(id, t, f, mb, pb, dd)"""


def _export(spark, d, reverse):
    customer = table(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")).select("c_custkey", "c_name", "c_acctbal")
    meta = meta_of(customer, "customer")
    image = lambda bal: F.struct("c_custkey", "c_name", bal.cast("decimal(18,2)").alias("c_acctbal"))
    key, none = F.col("c_custkey"), F.lit(None).cast(customer.schema)
    made = [
        F.when(key % 5 == 0, F.struct(F.lit("update").alias("op"), F.lit(1).alias("seq"), image(F.col("c_acctbal")).alias("before"), image(F.col("c_acctbal") + 10).alias("after"))),
        F.when(key % 7 == 0, F.struct(F.lit("delete").alias("op"), F.lit(2).alias("seq"), image(F.col("c_acctbal")).alias("before"), none.alias("after"))),
        F.when(key % 35 == 0, F.struct(F.lit("insert").alias("op"), F.lit(3).alias("seq"), none.alias("before"), image(F.col("c_acctbal")).alias("after"))),
    ]
    rows_ = customer.select(F.inline(F.array_compact(F.array(*made))))
    return rows_.select(F.coalesce("before.c_custkey", "after.c_custkey").alias("c_custkey"), F.col("seq").cast("long").alias("seq"), sqltext.change_sql(meta, sqltext.kinds_of(customer.schema), reverse=reverse).alias("statement"))


def sql_export_forward(spark, d) -> DataFrame:
    return _export(spark, d, False)


def sql_export_reverse(spark, d) -> DataFrame:
    return _export(spark, d, True)


_C = "CAST(c_custkey AS VARCHAR)"
_BAL, _MORE = "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)", "CAST(CAST(c_acctbal AS DECIMAL(18,2)) + 10 AS VARCHAR)"
_INS = f"'INSERT INTO `main`.`customer`(`c_custkey`,`c_name`,`c_acctbal`) VALUES(' || {_C} || ',''' || c_name || ''',' || {_BAL} || ');'"
_DEL = f"'DELETE FROM `main`.`customer` WHERE `c_custkey` = ' || {_C} || ';'"


def _export_sql(new: str, second: str, third: str) -> str:
    update = f"'UPDATE `main`.`customer` SET `c_custkey`=' || {_C} || ',`c_name`=''' || c_name || ''',`c_acctbal`=' || {new} || ' WHERE `c_custkey` = ' || {_C} || ';'"
    return f"""SELECT c_custkey, CAST(1 AS BIGINT) AS seq, {update} AS statement FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey, 2, {second} FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 3, {third} FROM customer WHERE c_custkey % 35 = 0"""


def lua_like_transform(spark, d) -> DataFrame:
    """A column added, one changed, one dropped, one renamed, rows left out: as expressions."""
    orders = table(spark, d, "orders")
    rows_ = changes.snapshot_changes(orders)
    out = rows.set_columns(rows_, {"added": F.lit(1000), "o_orderpriority": F.upper(F.substring("after.o_orderpriority", 3, 20)), "o_orderdate": None, "status": F.col("after.o_orderstatus"), "o_orderstatus": None})
    return rows.drop_rows(out, F.col("after.o_totalprice") < 200_000).select("after.*")


def row_hook(spark, d) -> DataFrame:
    """The same through user code on each row."""
    orders = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))

    def hook(row):
        after = row["after"]
        if after["o_totalprice"] < 200_000:
            row["row_type"] = ""
        after["added"] = 1000
        after["o_orderpriority"] = after["o_orderpriority"][2:].upper()
        after["status"] = after.pop("o_orderstatus")
        del after["o_orderdate"]
        return row

    target = T.StructType().add("o_orderkey", "long").add("o_custkey", "long").add("o_totalprice", "double").add("o_orderpriority", "string").add("added", "integer").add("status", "string")
    return rows.transform_rows(changes.snapshot_changes(orders), hook, "main", "orders", target).select("after.*")


def batch_hook(spark, d) -> DataFrame:
    """The same through user code on whole batches."""
    import pyarrow as pa
    import pyarrow.compute as pc

    target = T.StructType().add("o_orderkey", "long").add("o_custkey", "long").add("o_totalprice", "double").add("o_orderpriority", "string").add("added", "integer").add("status", "string")

    def hook(batch: pa.RecordBatch) -> pa.RecordBatch:
        after = batch.column("after")
        old = dict(zip([f.name for f in after.type], after.flatten(), strict=True))
        priority = pc.utf8_upper(pc.utf8_slice_codeunits(old["o_orderpriority"], 2))
        names = target.names
        new = pa.StructArray.from_arrays([old["o_orderkey"], old["o_custkey"], old["o_totalprice"], priority, pa.repeat(pa.scalar(1000, pa.int32()), len(after)), old["o_orderstatus"]], names)
        out = pa.RecordBatch.from_arrays([batch.column("op"), batch.column("seq"), pa.nulls(len(after), new.type), new], names=["op", "seq", "before", "after"])
        return out.filter(pc.greater_equal(old["o_totalprice"], 200_000))

    return rows.transform_batches(changes.snapshot_changes(table(spark, d, "orders")), hook, target).select("after.*")


_LUA = """SELECT o_orderkey, o_custkey, o_totalprice, upper(substr(o_orderpriority, 3, 20)) AS o_orderpriority, 1000 AS added, o_orderstatus AS status FROM orders WHERE o_totalprice >= 200000"""


def bigkey_stats(spark, d) -> DataFrame:
    stats = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size"), (F.col("doc_id") % 100).alias("freq"))
    return keyvalue.large_or_hot(stats, 5000, 99)


def document_updates(spark, d) -> DataFrame:
    """Log entries made of events: nested differences, plain updates, entries that say nothing, and texts that are none."""
    number, kind, k = F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id")
    diff = F.concat(F.lit('{"diff":{"u":{"a":'), number, F.lit('},"i":{"t":"'), kind, F.lit('"},"d":{"c":false},"sdeep":{"u":{"k":2},"sx":{"d":{"y":false}}},"a":true}}'))
    entry = F.when(k % 5 == 0, diff).when(k % 5 == 1, F.concat(F.lit('{"$set":{"a":'), number, F.lit('},"$unset":{"b":true}}'))).when(k % 5 == 2, '{"diff":{}}').when(k % 5 == 3, "not json")
    return documents.with_updates(table(spark, d, "events").select(k.alias("id"), entry.alias("entry"))).select("id", "update")


_UPDATES = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '{"$set":{"t":"' || event_type || '","a":' || CAST(user_id AS VARCHAR) || ',"deep.k":2},"$unset":{"c":false,"deep.x.y":false}}'
  WHEN 1 THEN '{"$set":{"a":' || CAST(user_id AS VARCHAR) || '},"$unset":{"b":true}}' END AS update FROM events"""


def ddl_statements(spark, d) -> DataFrame:
    """Statements made of events' numbers: several tables in one, comments, quotes, and texts that are no statements."""
    k, n = F.col("event_id"), F.col("user_id").cast("string")
    made = [
        F.concat(F.lit("CREATE TABLE IF NOT EXISTS `db"), n, F.lit("`.`a b` (id INT)")), F.concat(F.lit("drop table if exists x"), n, F.lit(".y, z")), F.concat(F.lit("RENAME TABLE a.b"), n, F.lit(" TO a.c, d TO e")),
        F.concat(F.lit("/* c */ alter /* d */ table t"), n, F.lit(" add column x int")), F.lit("SELECT 1"), F.concat(F.lit("create unique index i on s.t"), n, F.lit(" (a)")), F.lit(None).cast("string"),
        F.concat(F.lit("create database if not exists d"), n), F.concat(F.lit("truncate db.t"), n),
    ]
    rows = table(spark, d, "events").select(k.alias("id"), F.get(F.array(*made), (k % len(made)).cast("int")).alias("sql"))
    return ddl.with_ddl(rows).select("id", "ddl_kind", "ddl_schema", "ddl_table")


_STATED = """WITH e AS (SELECT event_id AS id, event_id % 9 AS k, CAST(user_id AS VARCHAR) AS n FROM events)
SELECT id, 'create_table' AS ddl_kind, 'db' || n AS ddl_schema, 'a b' AS ddl_table FROM e WHERE k = 0 UNION ALL SELECT id, 'drop_table', 'x' || n, 'y' FROM e WHERE k = 1 UNION ALL SELECT id, 'drop_table', '', 'z' FROM e WHERE k = 1
UNION ALL SELECT id, 'rename_table', 'a', 'b' || n FROM e WHERE k = 2 UNION ALL SELECT id, 'rename_table', '', 'd' FROM e WHERE k = 2 UNION ALL SELECT id, 'alter_table', '', 't' || n FROM e WHERE k = 3
UNION ALL SELECT id, 'create_index', 's', 't' || n FROM e WHERE k = 5 UNION ALL SELECT id, 'create_database', 'd' || n, '' FROM e WHERE k = 7 UNION ALL SELECT id, 'truncate_table', 'db', 't' || n FROM e WHERE k = 8"""


def value_texts(spark, d) -> DataFrame:
    """Signed times of many hours, sets, enums and bytes of unknown charset as text, made of events' numbers."""
    k = F.col("event_id")
    hours, part = k % 839, F.lpad((k % 60).cast("string"), 2, "0")
    at = F.concat(F.when(k % 2 == 1, "-").otherwise(""), hours.cast("string"), F.lit(":"), part, F.lit(":"), part, F.when(k % 3 == 0, ".5").otherwise(""))
    raw = F.when(k % 4 == 0, F.unhex(F.concat(F.lit("FF"), F.hex(F.col("event_type").cast("binary"))))).otherwise(F.col("event_type").cast("binary"))
    labels = ["a", "b", "c"]
    rows_ = table(spark, d, "events").select(k.alias("id"), F.when(k % 7 == 0, "bad").otherwise(at).alias("t"), (k % 8).alias("bits"), (k % 6).alias("e"), raw.alias("raw"))
    return rows_.select("id", values.time_micros(F.col("t")).alias("micros"), values.set_labels(F.col("bits"), labels).alias("labels"), values.enum_label(F.col("e"), labels).alias("label"), values.text_or_hex(F.col("raw")).alias("raw_text"))


_TEXTS = """SELECT event_id AS id,
  CASE WHEN event_id % 7 <> 0 THEN CAST((CASE WHEN event_id % 2 = 1 THEN -1 ELSE 1 END) * (1000000 * (3600 * (event_id % 839) + 61 * (event_id % 60)) + CASE WHEN event_id % 3 = 0 THEN 500000 ELSE 0 END) AS BIGINT) END AS micros,
  concat_ws(',', CASE WHEN event_id & 1 = 1 THEN 'a' END, CASE WHEN event_id & 2 = 2 THEN 'b' END, CASE WHEN event_id & 4 = 4 THEN 'c' END) AS labels,
  CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END AS label, CASE WHEN event_id % 4 = 0 THEN 'ff' || lower(hex(event_type)) ELSE event_type END AS raw_text FROM events"""

QUERIES = {f.__name__: f for f in (
    snapshot_scan, split_even_chunks, split_uneven_chunks, chunk_row_counts, checkpoint_prefix, null_pass_union, sample_topn, keyset_page, filter_tables_pattern, route_columns, route_topics,
    target_type_map, redis_hash_rows, redis_slot, redis_route, metrics_per_second, metrics_rt, metrics_members, progress, row_sizes, avro_envelope, avro_round_trip, precheck_tables, sql_literals,
    sql_export_forward, sql_export_reverse, lua_like_transform, row_hook, batch_hook, bigkey_stats, document_updates, ddl_statements, value_texts,
)}
SQL = {
    "snapshot_scan": "SELECT o_orderkey AS order_id, o_custkey, o_orderstatus, o_totalprice AS price FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'",
    "split_even_chunks": _EVEN, "split_uneven_chunks": _UNEVEN, "chunk_row_counts": _ROW_CHUNKS, "checkpoint_prefix": _PREFIX,
    "null_pass_union": "SELECT o_orderkey, nullif(o_custkey % 11, 7) AS k, CASE WHEN nullif(o_custkey % 11, 7) IS NULL THEN 'null' ELSE 'keyed' END AS scan_pass FROM orders",
    "sample_topn": _TOPN, "keyset_page": _PAGE, "filter_tables_pattern": _PATTERN, "route_columns": _ROUTE, "route_topics": _TOPICS,
    "target_type_map": f"SELECT * FROM {sql_values(_EXPECTED, 'kind, clickhouse, starrocks, doris')}", "redis_hash_rows": _REDIS, "redis_slot": _SLOT, "redis_route": _NODE,
    "metrics_per_second": _SECOND, "metrics_rt": _STATS, "metrics_members": _MEMBERS, "progress": _PROGRESS, "row_sizes": _SIZES, "avro_envelope": _AVRO, "avro_round_trip": "SELECT * FROM customer",
    "precheck_tables": _PRECHECK, "sql_literals": _LIT,
    "sql_export_forward": _export_sql(_MORE, _DEL, _INS), "sql_export_reverse": _export_sql(_BAL, _INS, _DEL), "lua_like_transform": _LUA, "row_hook": _LUA, "batch_hook": _LUA,
    "bigkey_stats": "SELECT doc_id, n_chars AS size, doc_id % 100 AS freq FROM documents WHERE n_chars >= 5000 OR doc_id % 100 >= 99",
    "document_updates": _UPDATES, "ddl_statements": _STATED,
    "value_texts": _TEXTS,
}
