"""Queries over what connects the engine to other systems: documents, queues, statements, restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..operators import changes, check, ddl, documents, envelopes, filters, keyvalue, partition
from ..operators.routing import Router
from ..sources import kafka, structures
from ..streaming import unresolved
from .fixtures import ORDERS_TARGET, customer_changes, meta_of, orders_target, table


def documents_applied(spark, d) -> DataFrame:
    """Customers as documents: some replaced, some changed in parts, one field taken away, some removed, and some that only an update makes."""
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", key.cast("string").alias("_id"), F.col("c_nationkey").alias("n"), "c_mktsegment")
    target = rows.select("_id", F.to_json(F.struct(key.alias("_id"), F.struct("n", F.col("c_mktsegment").alias("seg")).alias("at"))).alias("doc"))
    one = lambda op, seq, doc=None, update=None, name=F.col("_id"): F.struct(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), name.alias("_id"), (F.lit(None).cast("string") if doc is None else doc).alias("doc"), (F.lit(None).cast("string") if update is None else update).alias("update"))
    whole = F.to_json(F.struct(key.alias("_id"), F.struct((F.col("n") + 100).alias("n")).alias("at")))
    far = (key + 1_000_000).cast("string")
    made = [
        F.when(key % 3 == 0, one("update", 1, update=F.concat(F.lit('{"$set":{"at.n":'), (F.col("n") + 1).cast("string"), F.lit("}}")))),
        F.when(key % 5 == 0, one("replace", 2, doc=whole)), F.when(key % 7 == 0, one("update", 3, update=F.lit('{"$set":{"more":{"x":1}},"$unset":{"at.seg":""}}'))),
        F.when(key % 11 == 0, one("delete", 4)), F.when(key % 13 == 0, one("update", 5, update=F.lit('{"$set":{"at.n":7}}'), name=far)),
    ]
    out = documents.apply_documents(target, rows.select(F.inline(F.array_compact(F.array(*made)))))
    get = lambda path: F.get_json_object("doc", path)
    return out.select("_id", get("$._id").cast("long").alias("inner_id"), get("$.at.n").cast("long").alias("n"), get("$.at.seg").alias("seg"), get("$.more.x").cast("long").alias("x"))


_DOCUMENTS = """SELECT CAST(c_custkey AS VARCHAR) AS _id, c_custkey AS inner_id,
  CAST(c_nationkey + CASE WHEN c_custkey % 5 = 0 THEN 100 WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n,
  CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN c_mktsegment END AS seg, CASE WHEN c_custkey % 7 = 0 THEN CAST(1 AS BIGINT) END AS x
FROM customer WHERE c_custkey % 11 <> 0
UNION ALL SELECT CAST(c_custkey + 1000000 AS VARCHAR), c_custkey + 1000000, 7, NULL, NULL FROM customer WHERE c_custkey % 13 = 0"""


def queue_round_trip(spark, d) -> DataFrame:
    """Changes as Avro data under their topic, and back."""
    customer = table(spark, d, "customer")
    rows = customer_changes(customer).drop("unchanged").filter("op = 'update'")
    sent = kafka.avro_messages(envelopes.envelopes(rows, meta_of(customer, "customer")), {("*", "*"): "all", ("main", "*"): "main", ("main", "customer"): "clients"})
    back = envelopes.changes_of(envelopes.from_avro(sent), customer.schema, F.lit(0))
    topics = sent.agg(F.concat_ws(",", F.collect_set("topic"))), sent.agg(F.count("*"))
    return back.select("op", F.col("before.c_custkey").alias("old_key"), F.col("after.c_custkey").alias("new_key"), F.col("after.c_acctbal").alias("balance"), topics[0].scalar().alias("topic"), topics[1].scalar().alias("sent"))


_QUEUE = """WITH u AS (SELECT c_custkey AS old_key, c_custkey AS new_key, c_acctbal + 10 AS balance FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, c_custkey + 1000000, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 10 ELSE c_acctbal END FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0)
SELECT 'update' AS op, old_key, new_key, balance, 'clients' AS topic, (SELECT count(*) FROM u) AS sent FROM u"""


def database_route(spark, d) -> DataFrame:
    """Commands under other database numbers."""
    rows = table(spark, d, "events").select((F.col("event_id") % 6).cast("int").alias("db"))
    return keyvalue.with_db(rows, {0: 9, 1: 0, 5: 5}).groupBy("db").agg(F.count("*").alias("n"))


_DB = "SELECT CAST(CASE event_id % 6 WHEN 0 THEN 9 WHEN 1 THEN 0 ELSE event_id % 6 END AS INTEGER) AS db, count(*) AS n FROM events GROUP BY 1"


def check_retries(spark, d) -> DataFrame:
    """Orders against a target that catches up between looks: what still disagrees at the last one."""
    orders = table(spark, d, "orders")
    meta = meta_of(orders, "orders")
    late = orders_target(orders)
    looks = iter([late] + [late.join(orders.filter(f"o_orderkey % {m} = 0").select("o_orderkey"), "o_orderkey", "left_anti").unionByName(orders.filter(f"o_orderkey % {m} = 0")) for m in (2, 3)])
    return check.with_retries(lambda: (orders, next(looks)), meta, 2).select("o_orderkey", "kind")


_RETRIES = f"""WITH {ORDERS_TARGET} SELECT s.o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'miss' ELSE 'diff' END AS kind FROM orders s LEFT JOIN dst t ON s.o_orderkey = t.o_orderkey
WHERE s.o_orderkey % 2 <> 0 AND s.o_orderkey % 3 <> 0 AND (t.o_orderkey IS NULL OR t.o_orderstatus <> s.o_orderstatus OR t.o_totalprice <> s.o_totalprice)"""


def statements_kept(spark, d) -> DataFrame:
    """Kinds of statements that pass a filter, by schema."""
    kinds = ["create_table", "drop_table", "alter_table", "truncate_table"]
    rows = table(spark, d, "events").select(F.get(F.array(*map(F.lit, kinds)), (F.col("event_id") % 4).cast("int")).alias("kind"), F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("s"), F.col("event_type").alias("t"))
    rule = filters.TableFilter.read({"do_dbs": "db0,db1", "ignore_tbs": "db1.click", "do_ddls": "create_table,alter_table", "do_dcls": "*", "ignore_cmds": "FLUSHALL"})
    return rows.filter(rule.ddl_kept(F.col("kind"), F.col("s"), F.col("t"))).groupBy("kind", "s").agg(F.count("*").alias("n"))


_KEPT = """SELECT CASE event_id % 4 WHEN 0 THEN 'create_table' ELSE 'alter_table' END AS kind, 'db' || CAST(user_id % 3 AS VARCHAR) AS s, count(*) AS n FROM events
WHERE event_id % 4 IN (0, 2) AND user_id % 3 IN (0, 1) AND NOT (user_id % 3 = 1 AND event_type = 'click') GROUP BY 1, 2"""


def statements_by_trigger(spark, d) -> DataFrame:
    """Inserts into the table that a trigger logs statements in are statements; its other changes are nothing."""
    rows = table(spark, d, "events").select("event_id", F.lit("s").alias("schema"), F.when(F.col("event_type") == "error", "log").otherwise(F.col("event_type")).alias("table"), F.when(F.col("event_id") % 3 == 0, "delete").otherwise("insert").alias("op"))
    kept, said = changes.without_statements(rows, "log")
    return kept.groupBy("table").agg(F.count("*").alias("n")).unionByName(said.groupBy("table").agg(F.count("*").alias("n")))


_TRIGGER = """SELECT event_type AS "table", count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1
UNION ALL SELECT 'log', count(*) FROM events WHERE event_type = 'error' AND event_id % 3 <> 0 HAVING count(*) > 0"""


def schema_history(spark, d) -> DataFrame:
    """The last known schema of each table before a position."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("schema"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tb"), F.col("props").alias("ddl"))
    return ddl.schema_at(rows, 700)


_HISTORY = """SELECT event_type AS schema, 't' || CAST(user_id % 5 AS VARCHAR) AS tb, arg_max(props, event_id) AS ddl FROM events WHERE event_id <= 700 GROUP BY 1, 2"""


def values_for_targets(spark, d) -> DataFrame:
    """Bytes as prefixed hex and times without an offset of zero."""
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.unhex(F.concat(F.lit("FF"), F.hex(F.col("c_name").cast("binary"))))).otherwise(F.col("c_name").cast("binary")).alias("raw"), F.concat(F.lit("2024-01-01 00:00:00"), F.when(F.col("c_custkey") % 3 == 0, "+00+00").otherwise("+01")).alias("at"))
    return rows.select("c_custkey", values.prefixed_hex(F.col("raw")).alias("raw"), values.without_utc_offset(F.col("at")).alias("at"))


_VALUES = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '0xff' || lower(hex(c_name)) ELSE c_name END AS raw, '2024-01-01 00:00:00' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '+01' END AS at FROM customer"""


def restart_recheck(spark, d) -> DataFrame:
    """Unresolved keys of a check, looked up again on both sides after a restart."""
    orders = table(spark, d, "orders")
    meta = meta_of(orders, "orders")
    dst = orders_target(orders)
    wrong = check.compared(orders, dst, meta, "full").filter("kind <> 'same'")
    state = wrong.select(unresolved.key_text(meta).alias("key"), "kind", F.lit(1).cast("long").alias("seq"))
    healed = dst.filter("o_orderkey % 2 = 1").unionByName(orders.filter("o_orderkey % 2 = 0"))
    found = unresolved.rechecked(state, orders, healed, meta, 2)
    return unresolved.current(state.unionByName(found)).select(F.get_json_object("key", "$.o_orderkey").cast("long").alias("o_orderkey"), "kind", "seq")


_RESTART = f"""WITH {ORDERS_TARGET} SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'miss' WHEN s.o_orderkey IS NULL THEN 'stale' ELSE 'diff' END AS kind, CAST(2 AS BIGINT) AS seq
FROM orders s FULL JOIN dst t ON s.o_orderkey = t.o_orderkey
WHERE coalesce(s.o_orderkey, t.o_orderkey) % 2 = 1 AND (t.o_orderkey IS NULL OR s.o_orderkey IS NULL OR t.o_orderstatus <> s.o_orderstatus OR t.o_totalprice <> s.o_totalprice)"""


def structure_events(spark, d) -> DataFrame:
    """Change events that define collections, made of events' numbers, under the target's names."""
    k, n = F.col("event_id"), F.col("user_id").cast("string")
    head = lambda op: F.concat(F.lit(f'{{"operationType":"{op}","ns":{{"db":"a","coll":"c'), n, F.lit('"}'))
    made = [
        F.concat(head("create"), F.lit("}")), F.concat(head("rename"), F.lit(',"to":{"db":"b","coll":"d'), n, F.lit('"}}')), F.concat(head("insert"), F.lit(',"fullDocument":{}}')),
        F.concat(head("createIndexes"), F.lit(',"operationDescription":{"indexes":['), n, F.lit("]}}")), F.lit('{"operationType":"dropDatabase","ns":{"db":"a"}}'), F.lit("no json"),
    ]
    rows = table(spark, d, "events").select(k.alias("id"), F.get(F.array(*made), (k % len(made)).cast("int")).alias("event"))
    out = documents.structure_events(rows, route=Router({"a": "x"}, {("b", "d1"): ("y", "e")}))
    return out.select("id", "ddl_kind", "db", "coll", "to_db", "to_coll", "detail")


_STRUCTURES = """WITH e AS (SELECT event_id AS id, event_id % 6 AS k, CAST(user_id AS VARCHAR) AS n FROM events)
SELECT id, CASE k WHEN 0 THEN 'create_collection' WHEN 1 THEN 'rename_collection' WHEN 3 THEN 'create_indexes' ELSE 'drop_database' END AS ddl_kind, 'x' AS db, CASE WHEN k <> 4 THEN 'c' || n END AS coll,
  CASE WHEN k = 1 THEN CASE n WHEN '1' THEN 'y' ELSE 'b' END END AS to_db, CASE WHEN k = 1 THEN CASE n WHEN '1' THEN 'e' ELSE 'd' || n END END AS to_coll,
  CASE WHEN k = 3 THEN '{"indexes":[' || n || ']}' END AS detail FROM e WHERE k NOT IN (2, 5)"""


def catalogue_structures(spark, d) -> DataFrame:
    """A catalogue with a table for each nation, some with keys, references and indexes, under other schemas, tables and columns."""
    nation = table(spark, d, "nation").select("n_nationkey", F.lit("a").alias("schema"), F.col("n_name").alias("tb"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("ref"))
    one = lambda name, place, kind, nullable, default: F.struct(F.lit(name).alias("name"), F.lit(place).alias("place"), F.lit(kind).alias("type"), F.lit(nullable).alias("nullable"), default.alias("default"))
    none = F.lit(None).cast("string")
    columns = nation.select("schema", "tb", F.inline(F.array(one("id", 2, "int", False, none), one("name", 1, "varchar(9)", True, F.concat(F.lit("'"), F.col("tb"), F.lit("'"))))))
    rule = lambda name, kind, cols, ref, to, cond: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), cols.alias("columns"), F.when(ref.isNotNull(), "a").alias("ref_schema"), ref.alias("ref_tb"), to.alias("ref_columns"), cond.alias("condition"))
    ids, no_list, k = F.array(F.lit("id")), F.lit(None).cast("array<string>"), F.col("n_nationkey")
    made = [
        F.when(k % 2 == 0, rule("pk", "PRIMARY KEY", ids, none, no_list, none)), F.when(k % 3 == 0, rule("fk", "FOREIGN KEY", F.array(F.lit("name")), F.col("ref"), ids, none)),
        F.when(k % 5 == 0, rule("c", "CHECK", no_list, none, no_list, F.lit("id > 0"))),
    ]
    constraints = nation.select("schema", "tb", F.inline(F.array_compact(F.array(*made))))
    indexes = nation.filter("n_nationkey % 4 = 1").select("schema", "tb", F.lit("i").alias("name"), F.array(F.lit("name"), F.lit("id")).alias("columns"), (F.col("n_nationkey") % 8 == 1).alias("is_unique"))
    route = Router({"a": "b"}, {("a", "r1"): ("c", "one")}, {("a", "r1"): {"id": "key"}})
    out = structures.routed({"columns": columns, "constraints": constraints, "indexes": indexes}, route)
    return structures.catalogue(out["columns"], out["constraints"], out["indexes"], "pg").select("kind", "key", "ddl")


_CATALOGUE = """SELECT 'table' AS kind, 'table.b.' || n_name AS key, 'CREATE TABLE IF NOT EXISTS "b"."' || n_name || '" ("name" varchar(9) DEFAULT ' || chr(39) || n_name || chr(39) || ', "id" int NOT NULL)' AS ddl FROM nation
UNION ALL SELECT 'constraint', 'constraint.b.' || n_name || '.pk', 'ALTER TABLE "b"."' || n_name || '" ADD CONSTRAINT "pk" PRIMARY KEY ("id")' FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'constraint', 'constraint.b.' || n_name || '.fk', 'ALTER TABLE "b"."' || n_name || '" ADD CONSTRAINT "fk" FOREIGN KEY ("name") REFERENCES ' ||
  CASE n_regionkey WHEN 1 THEN '"c"."one" ("key")' ELSE '"b"."r' || CAST(n_regionkey AS VARCHAR) || '" ("id")' END FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'constraint', 'constraint.b.' || n_name || '.c', 'ALTER TABLE "b"."' || n_name || '" ADD CONSTRAINT "c" CHECK (id > 0)' FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT 'index', 'index.b.' || n_name || '.i', 'CREATE ' || CASE WHEN n_nationkey % 8 = 1 THEN 'UNIQUE ' ELSE '' END || 'INDEX "i" ON "b"."' || n_name || '" ("name", "id")' FROM nation WHERE n_nationkey % 4 = 1"""


def tables_together(spark, d) -> DataFrame:
    """Rows dealt out by table: each table's rows are in one partition."""
    rows = table(spark, d, "events").select(F.lit("s").alias("schema"), F.col("event_type").alias("tb"))
    return partition.by_table(rows).withColumn("p", F.spark_partition_id()).groupBy("tb").agg(F.countDistinct("p").alias("partitions"), F.count("*").alias("n"))


_TOGETHER = "SELECT event_type AS tb, CAST(1 AS BIGINT) AS partitions, count(*) AS n FROM events GROUP BY 1"

QUERIES = {f.__name__: f for f in (
    documents_applied, queue_round_trip, database_route, check_retries, statements_kept, statements_by_trigger, schema_history, values_for_targets, restart_recheck, structure_events, catalogue_structures, tables_together,
)}
SQL = {
    "documents_applied": _DOCUMENTS, "queue_round_trip": _QUEUE, "database_route": _DB, "check_retries": _RETRIES, "statements_kept": _KEPT, "statements_by_trigger": _TRIGGER,
    "schema_history": _HISTORY, "values_for_targets": _VALUES, "restart_recheck": _RESTART, "structure_events": _STRUCTURES, "catalogue_structures": _CATALOGUE, "tables_together": _TOGETHER,
}
