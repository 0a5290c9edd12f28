"""Queries that merge changes and apply them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import table_meta
from ..operators import apply, changes, check, filters, merge, partition
from .fixtures import CUSTOMER_AFTER, KEYS, LAST_EVENTS, USER_META, customer_changes, event_changes, meta_of, orders_target, table


def merge_lww_events(spark, d) -> DataFrame:
    net = merge.compact(event_changes(table(spark, d, "events")), USER_META)
    return net.select("user_id", "op", F.col("after.value").alias("value"), F.col("after.props").alias("props"), F.col("seq").alias("event_id"))


_LWW = f"""WITH {LAST_EVENTS} SELECT user_id, CASE op WHEN 'delete' THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN op <> 'delete' THEN value END AS value,
  CASE WHEN op <> 'delete' THEN props END AS props, event_id FROM last"""


def merge_net_ops(spark, d) -> DataFrame:
    net = merge.compact(event_changes(table(spark, d, "events")), USER_META)
    deletes, inserts = merge.phases(net, USER_META)
    return deletes.select("user_id", F.lit("delete").alias("phase")).unionByName(inserts.select("user_id", F.lit("insert").alias("phase")))


_NET = f"""WITH {LAST_EVENTS} SELECT user_id, 'delete' AS phase FROM events WHERE event_type <> 'signup' GROUP BY user_id
UNION ALL SELECT user_id, 'insert' FROM last WHERE op <> 'delete'"""


def merge_key_change(spark, d) -> DataFrame:
    customer = table(spark, d, "customer")
    net = merge.compact(customer_changes(customer), meta_of(customer, "customer"))
    return net.select("c_custkey", "op", "seq", "clears", F.col("after.c_acctbal").alias("c_acctbal"))


_KEY_CHANGE = """WITH i AS (
  SELECT c_custkey, 1 AS seq, 'update' AS op, c_acctbal + 10 AS bal FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, 2, 'delete', NULL FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT c_custkey, 3, 'insert', c_acctbal FROM customer WHERE c_custkey % 35 = 0
  UNION ALL SELECT c_custkey, 4, 'delete', NULL FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0
  UNION ALL SELECT c_custkey + 1000000, 4, 'insert', CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 10 ELSE c_acctbal END FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0)
SELECT c_custkey, CASE WHEN op = 'delete' THEN 'delete' ELSE 'upsert' END AS op, CAST(seq AS BIGINT) AS seq, clears, bal AS c_acctbal
FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY seq DESC) AS rn, bool_or(op <> 'insert') OVER (PARTITION BY c_custkey) AS clears FROM i) WHERE rn = 1"""


def _flagged(spark, d):
    rows = event_changes(table(spark, d, "events")).withColumns({"tb": F.col("seq") % 20, "unchanged": F.when(F.col("seq") % 997 == 996, F.array(F.lit("props"))).otherwise(F.array().cast("array<string>"))})
    return rows


def merge_unmerged_flag(spark, d) -> DataFrame:
    rows = _flagged(spark, d)
    out = merge.with_unmerged(rows, merge.unmergeable(rows, USER_META), per=["tb"])
    return out.select(F.col("seq").alias("event_id"), "tb", "unmerged")


_UNMERGED = """WITH f AS (SELECT event_id % 20 AS tb, min(event_id) AS first FROM events WHERE event_id % 997 = 996 GROUP BY 1)
SELECT event_id, event_id % 20 AS tb, coalesce(event_id >= f.first, false) AS unmerged FROM events LEFT JOIN f ON event_id % 20 = f.tb"""


def merge_documents(spark, d) -> DataFrame:
    """Of a document store: from its first update on a table is replayed."""
    rows = _flagged(spark, d)
    out = merge.with_unmerged(rows, merge.unmergeable(rows, USER_META, update_ends=True), per=["tb"])
    return out.groupBy("tb").agg(F.count_if("unmerged").alias("unmerged"), F.count_if(~F.col("unmerged")).alias("merged"))


_DOCS = """WITH f AS (SELECT event_id % 20 AS tb, min(event_id) AS first FROM events WHERE event_id % 997 = 996 OR event_type NOT IN ('signup', 'error') GROUP BY 1)
SELECT event_id % 20 AS tb, count(*) FILTER (WHERE event_id >= f.first) AS unmerged, count(*) FILTER (WHERE coalesce(event_id < f.first, true)) AS merged
FROM events LEFT JOIN f ON event_id % 20 = f.tb GROUP BY 1"""


def merge_toast_fill(spark, d) -> DataFrame:
    rows = event_changes(table(spark, d, "events").withColumn("event_type", F.lit("view")))
    hole = F.col("seq") % 3 == 0
    gone = F.struct(F.col("after.user_id"), F.col("after.value"), F.when(~hole, F.col("after.props")).alias("props"))
    rows = rows.withColumns({"after": gone, "unchanged": F.when(hole, F.array(F.lit("props"))).otherwise(F.array().cast("array<string>"))})
    out = changes.fill_unchanged(rows, USER_META)
    return out.select(F.col("seq").alias("event_id"), F.col("after.props").alias("props"), F.size("unchanged").cast("long").alias("n_unchanged"))


_TOAST = """WITH f AS (SELECT event_id, last_value(CASE WHEN event_id % 3 <> 0 THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS props FROM events)
SELECT event_id, props, CAST(props IS NULL AS BIGINT) AS n_unchanged FROM f"""


def apply_replace(spark, d) -> DataFrame:
    customer = table(spark, d, "customer")
    return apply.apply_changes(customer, customer_changes(customer), meta_of(customer, "customer"))


def apply_update_only(spark, d) -> DataFrame:
    customer = table(spark, d, "customer")
    lost = customer_changes(customer, moves=False).filter("op = 'update'").withColumns({
        "before": F.col("before").withField("c_custkey", F.col("before.c_custkey") + 5_000_000), "after": F.col("after").withField("c_custkey", F.col("after.c_custkey") + 5_000_000)})
    both = customer_changes(customer).unionByName(lost)
    return apply.apply_changes(customer, both, meta_of(customer, "customer"), "update_only")


def _log(spark, d):
    customer = table(spark, d, "customer")
    meta = meta_of(customer, "customer")
    first = changes.snapshot_changes(customer)
    log = apply.append_audited(first, meta).unionByName(apply.append_audited(customer_changes(customer), meta))
    return log, meta


def apply_soft_delete_latest(spark, d) -> DataFrame:
    log, meta = _log(spark, d)
    return apply.latest_view(log, meta, with_deleted=True).select("c_custkey", "c_mktsegment", apply.DELETED, apply.STAMP)


_SOFT = """SELECT c_custkey, CASE WHEN c_custkey % 35 = 0 THEN 'NEW' WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
  CAST(c_custkey % 35 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 11 = 0) AS INTEGER) AS _is_deleted,
  CAST(CASE WHEN c_custkey % 35 = 0 THEN 7 WHEN c_custkey % 7 = 0 THEN 4 WHEN c_custkey % 11 = 0 THEN 8 WHEN c_custkey % 5 = 0 THEN 3 ELSE 1 END AS BIGINT) AS _sync_ts FROM customer
UNION ALL SELECT c_custkey + 1000000, c_mktsegment, 0, 9 FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0"""


def apply_hard_delete(spark, d) -> DataFrame:
    customer = table(spark, d, "customer")
    gone = customer_changes(customer).filter("op = 'delete'").select("before.*")
    return apply.delete_rows(customer, gone, meta_of(customer, "customer"))


def name_takers(supplier: DataFrame) -> DataFrame:
    """Changes by which every fourth supplier takes the name of the next one."""
    names = supplier.select(F.col("s_suppkey").alias("_k"), F.col("s_name").alias("_name"))
    takers = supplier.filter("s_suppkey % 4 = 1").join(names, F.col("_k") == F.col("s_suppkey") + 1, "left")
    new = F.struct("s_suppkey", F.coalesce("_name", "s_name").alias("s_name"), "s_nationkey", "s_acctbal")
    return takers.select(F.lit("update").alias("op"), F.col("s_suppkey").alias("seq"), F.struct(*supplier.columns).alias("before"), new.alias("after"))


def apply_replace_multi_unique(spark, d) -> DataFrame:
    """Suppliers take each other's names: whoever had the name goes."""
    supplier = table(spark, d, "supplier")
    return apply.replace_rows(supplier, name_takers(supplier), table_meta(supplier, "supplier", KEYS["supplier"], [("s_name",)], nullable=()))


NAMES_TAKEN = """SELECT s.s_suppkey, CASE WHEN s.s_suppkey % 4 = 1 THEN coalesce(n.s_name, s.s_name) ELSE s.s_name END AS s_name, s.s_nationkey, s.s_acctbal
FROM supplier s LEFT JOIN supplier n ON n.s_suppkey = s.s_suppkey + 1 WHERE s.s_suppkey % 4 <> 2"""


def load_rows(spark, d) -> DataFrame:
    """Users' last states as JSON rows, their JSON text nested."""
    return apply.load_rows(event_changes(table(spark, d, "events").withColumn("value", F.floor("value").cast("double"))), USER_META, hard_delete=True, json_columns=["props"])


_LOAD = f"""WITH {LAST_EVENTS} SELECT '{{"user_id":' || CAST(user_id AS VARCHAR) || CASE WHEN op = 'delete' THEN ',"__op":"delete"}}' ELSE ',"value":' || CAST(floor(value) AS VARCHAR) || ',"props":' ||
  replace(props, ' ', '') || ',"__op":"upsert"}}' END AS row, event_id AS seq FROM last"""


def inline_check(spark, d) -> DataFrame:
    """A batch held against a target that took part of it."""
    customer = table(spark, d, "customer")
    meta = meta_of(customer, "customer")
    batch = customer_changes(customer)
    target = apply.apply_changes(customer, batch.filter("coalesce(after.c_custkey, before.c_custkey) % 10 <> 0"), meta)
    return check.applied(batch, target, meta).groupBy("kind").agg(F.count("*").alias("n"))


_INLINE = """WITH k AS (
  SELECT CASE WHEN c_custkey % 35 = 0 THEN CASE WHEN c_custkey % 10 = 0 THEN 'diff' ELSE 'same' END
    WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 10 = 0 THEN 'stale' END
    WHEN c_custkey % 11 = 0 THEN CASE WHEN c_custkey % 10 = 0 THEN 'stale' END
    WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 10 = 0 THEN 'diff' ELSE 'same' END END AS kind FROM customer
  UNION ALL SELECT CASE WHEN c_custkey % 10 = 0 THEN 'miss' ELSE 'same' END FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0)
SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY kind"""


def apply_insert_or_update_values(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    return apply.insert_or_update_values(orders, orders_target(orders), meta_of(orders, "orders")).select("o_orderkey", "o_orderstatus", "o_totalprice")


_VALUES = """SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0 AND o_orderkey % 83 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 97 <> 0 AND o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL SELECT o_orderkey + 1000000, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 101 = 0"""


def apply_bag_delete_one(spark, d) -> DataFrame:
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    gone = pairs.filter("l_orderkey % 13 = 0").distinct()
    return apply.bag_delete(pairs, gone).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


_BAG_DELETE = """SELECT l_orderkey, l_linenumber, count(*) - CAST(l_orderkey % 13 = 0 AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber
HAVING count(*) - CAST(l_orderkey % 13 = 0 AS BIGINT) > 0"""


def apply_bag_update_one(spark, d) -> DataFrame:
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    image = lambda n: F.struct("l_orderkey", n.alias("l_linenumber"))
    rows = pairs.filter("l_orderkey % 13 = 0").distinct().select(image(F.col("l_linenumber")).alias("before"), image(F.col("l_linenumber") + 100).alias("after"), F.lit(1).alias("seq"))
    return apply.bag_update(pairs, rows).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


_BAG_UPDATE = f"""{_BAG_DELETE} UNION ALL SELECT l_orderkey, l_linenumber + 100, 1 FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 13 = 0)"""


def snapshot_plus_cdc(spark, d) -> DataFrame:
    """A snapshot taken after the second of four steps, and all steps: the first two are not applied again."""
    customer = table(spark, d, "customer")
    meta = meta_of(customer, "customer")
    steps = customer_changes(customer)
    snapshot = apply.apply_changes(customer, steps.filter("seq <= 2"), meta)
    return apply.snapshot_plus_changes(snapshot, steps, meta, 2)


def undo_log(spark, d) -> DataFrame:
    customer = table(spark, d, "customer")
    back = changes.reversed_changes(customer_changes(customer, moves=False))
    return back.select("op", "seq", F.coalesce("before.c_custkey", "after.c_custkey").alias("c_custkey"), F.col("before.c_acctbal").alias("before_acctbal"), F.col("after.c_acctbal").alias("after_acctbal"))


_UNDO = """SELECT 'update' AS op, CAST(1 AS BIGINT) AS seq, c_custkey, c_acctbal + 10 AS before_acctbal, c_acctbal AS after_acctbal FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'insert', 2, c_custkey, NULL, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 10 ELSE c_acctbal END FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT 'delete', 3, c_custkey, c_acctbal, NULL FROM customer WHERE c_custkey % 35 = 0"""


def split_updates(spark, d) -> DataFrame:
    out = changes.split_updates(customer_changes(table(spark, d, "customer")))
    return out.groupBy("op", "part", "is_origin").agg(F.count("*").alias("n")).withColumn("part", F.col("part").cast("long"))


_SPLIT = """WITH u AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 5 = 0), m AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0)
SELECT 'delete' AS op, CAST(0 AS BIGINT) AS part, false AS is_origin, u.n + m.n AS n FROM u, m UNION ALL SELECT 'insert', 1, false, u.n + m.n FROM u, m
UNION ALL SELECT 'delete', 0, true, count(*) FROM customer WHERE c_custkey % 7 = 0 HAVING count(*) > 0 UNION ALL SELECT 'insert', 0, true, count(*) FROM customer WHERE c_custkey % 35 = 0 HAVING count(*) > 0"""


def before_from_key(spark, d) -> DataFrame:
    """Updates whose old image was not sent."""
    customer = table(spark, d, "customer")
    rows = customer_changes(customer).filter("op = 'update'").withColumn("before", F.when(F.col("seq") == 4, F.col("before")))
    out = changes.with_before(rows, meta_of(customer, "customer"))
    return out.select("seq", F.col("after.c_custkey").alias("c_custkey"), F.col("before.c_custkey").alias("before_key"), F.col("before.c_name").alias("before_name"))


_BEFORE = """SELECT CAST(1 AS BIGINT) AS seq, c_custkey, c_custkey AS before_key, NULL::VARCHAR AS before_name FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 4, c_custkey + 1000000, c_custkey, c_name FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0"""


def drain_segments(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, "ddl").otherwise("dml").alias("kind"), (F.col("event_id") / F.lit(700)).cast("int").alias("origin"))
    return changes.drain_segments(rows, "event_id").select("event_id", "kind", "segment")


_DRAIN = """WITH e AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'ddl' ELSE 'dml' END AS kind, event_id // 700 AS origin FROM events),
c AS (SELECT *, CASE WHEN lag(kind) OVER o IS NOT NULL AND (lag(kind) OVER o <> kind OR lag(origin) OVER o <> origin) THEN 1 ELSE 0 END AS changed FROM e WINDOW o AS (ORDER BY event_id))
SELECT event_id, kind, CAST(sum(changed) OVER (ORDER BY event_id) + 1 AS BIGINT) AS segment FROM c"""


def replay_runs(spark, d) -> DataFrame:
    rows = event_changes(table(spark, d, "events"))
    return merge.replay_runs(rows).groupBy("segment", "op").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


_RUNS = """WITH e AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op FROM events),
c AS (SELECT *, CASE WHEN lag(op) OVER (ORDER BY event_id) <> op THEN 1 ELSE 0 END AS changed FROM e),
s AS (SELECT *, CAST(sum(changed) OVER (ORDER BY event_id) + 1 AS BIGINT) AS segment FROM c) SELECT segment, op, count(*) AS n, min(event_id) AS first FROM s GROUP BY segment, op"""


def loop_filter(spark, d) -> DataFrame:
    txn = F.expr("event_id div 10")
    rows = table(spark, d, "events").select("event_id", txn.alias("txn"), F.when((F.col("event_id") % 10 == 0) & (txn % 4 != 3), F.concat(F.lit("n"), (txn % 3).cast("string"))).alias("marker_origin"))
    return changes.drop_loops(rows, "here", ["n0", "n1"], ["n1"], seq="event_id").select("event_id", "data_origin")


_LOOP = """WITH e AS (SELECT event_id, event_id // 10 AS txn, CASE WHEN event_id % 10 = 0 AND (event_id // 10) % 4 <> 3 THEN 'n' || CAST((event_id // 10) % 3 AS VARCHAR) END AS m FROM events),
o AS (SELECT *, first_value(m) OVER w AS origin, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY txn ORDER BY event_id))
SELECT event_id, coalesce(origin, 'here') AS data_origin FROM o WHERE NOT (rn = 1 AND m IS NOT NULL) AND (origin IS NULL OR origin = 'n0')"""


def filter_events_time(spark, d) -> DataFrame:
    """Whole transactions of ten events within a window of time, and two kinds of events of them."""
    rows = table(spark, d, "events").withColumn("txn", F.expr("event_id div 10"))
    out = filters.within(rows, "2024-01-05 00:00:00", "2024-01-20 12:00:00", seq="event_id")
    kept = filters.TableFilter(do_events=frozenset({"click", "view"}))
    return out.filter(kept.event_kept(F.col("event_type"))).select("event_id", "txn", "event_type")


_TIME = """WITH b AS (SELECT event_id // 10 AS txn, min(event_id) AS first_id, arg_min(ts, event_id) AS begun FROM events GROUP BY 1)
SELECT event_id, event_id // 10 AS txn, event_type FROM events WHERE event_type IN ('click', 'view')
AND event_id >= (SELECT min(first_id) FROM b WHERE begun >= TIMESTAMP '2024-01-05 00:00:00') AND event_id < (SELECT coalesce(min(first_id), 9223372036854775807) FROM b WHERE begun >= TIMESTAMP '2024-01-20 12:00:00')"""


def last_positions(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.col("event_id").alias("seq"), F.concat(F.lit("binlog.1:"), F.col("event_id").cast("string")).alias("position"))
    return changes.last_positions(rows, ["event_type"])


def partition_hash_counts(spark, d) -> DataFrame:
    return partition.key_bucket(table(spark, d, "events"), 8, "user_id").groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


_HASH = """SELECT ('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 8 AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1"""


def _made(rows: DataFrame, *changes) -> DataFrame:
    """(condition, op, seq, before, after, unsent) for each row that meets the condition, as changes."""
    kind = rows.schema
    none = F.lit(None).cast(kind)
    image = lambda new: none if new is None else F.struct(*[new.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in kind])
    one = lambda op, seq, before, after, unsent: F.struct(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), image(before).alias("before"), image(after).alias("after"), F.array(*map(F.lit, unsent)).cast("array<string>").alias("unchanged"))
    return rows.select(F.inline(F.array_compact(F.array(*[F.when(F.expr(cond), one(*rest)) for cond, *rest in changes]))))


def apply_bag_stream(spark, d) -> DataFrame:
    """A table without a key, with nulls: copies added, one of a value removed, one changed, more removed than there are."""
    pairs = table(spark, d, "lineitem").select("l_orderkey", F.expr("nullif(l_linenumber, 3)").alias("n"))
    up = {"n": F.coalesce("n", F.lit(0)) + 100}
    rows = _made(
        pairs.distinct(), ("l_orderkey % 13 = 0", "insert", 1, None, {}, ()), ("l_orderkey % 7 = 0", "delete", 2, {}, None, ()), ("l_orderkey % 11 = 0", "update", 3, {}, up, ()),
        ("l_orderkey % 17 = 0", "delete", 4, {}, None, ()), ("l_orderkey % 17 = 0", "delete", 5, {}, None, ()), ("l_orderkey % 34 = 0", "insert", 6, None, {}, ()),
    )
    out = apply.apply_changes(pairs, rows, table_meta(pairs, "pairs"))
    return out.groupBy("l_orderkey", "n").agg(F.count("*").alias("copies"))


_BAG_STREAM = """WITH p AS (SELECT l_orderkey, nullif(l_linenumber, 3) AS n, count(*) AS c FROM lineitem GROUP BY 1, 2),
a AS (SELECT *, greatest(c + CAST(l_orderkey % 13 = 0 AS BIGINT) - CAST(l_orderkey % 7 = 0 AS BIGINT), 0) AS c2 FROM p),
b AS (SELECT *, greatest(c2 - CAST(l_orderkey % 11 = 0 AS BIGINT), 0) AS c3 FROM a),
e AS (SELECT l_orderkey, n, greatest(c3 - 2 * CAST(l_orderkey % 17 = 0 AS BIGINT), 0) + CAST(l_orderkey % 34 = 0 AS BIGINT) AS copies FROM b)
SELECT l_orderkey, n, copies FROM e WHERE copies > 0 UNION ALL SELECT l_orderkey, coalesce(n, 0) + 100, 1 FROM p WHERE l_orderkey % 11 = 0"""


def apply_null_key(spark, d) -> DataFrame:
    """A nullable key of two columns: rows with a null in it are added, changed and removed by what their key has."""
    source = table(spark, d, "supplier")
    rows = source.select(F.expr("CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    meta = table_meta(rows, "t", unique=[("k", "nation")], nullable=("k", "nation", "name", "bal"))
    gone = {"name": F.lit("?"), "bal": F.lit(0.0)}
    made = _made(
        rows, ("k IS NULL AND nation % 2 = 0", "insert", 1, None, {"name": F.concat("name", F.lit("+"))}, ()), ("k % 4 = 0", "update", 2, {}, {"bal": F.col("bal") + 1}, ()),
        ("k IS NULL AND nation % 5 = 1", "update", 3, {}, gone, ("bal",)), ("k IS NULL AND nation % 7 = 2", "delete", 4, {}, None, ()), ("k IS NULL AND nation % 7 = 2", "insert", 5, None, {}, ()),
    )
    return apply.apply_changes(rows, made, meta)


_NULL_KEY = """WITH t AS (SELECT CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS k, s_nationkey AS nation, s_name AS name, s_acctbal AS bal FROM supplier),
n AS (SELECT * FROM t WHERE k IS NULL UNION ALL SELECT k, nation, name || '+', bal FROM t WHERE k IS NULL AND nation % 2 = 0)
SELECT k, nation, name, bal + CAST(k % 4 = 0 AS INT) AS bal FROM t WHERE k IS NOT NULL
UNION ALL SELECT k, nation, CASE WHEN nation % 5 = 1 THEN '?' ELSE name END, bal FROM n WHERE nation % 7 <> 2 UNION ALL SELECT k, nation, name, bal FROM t WHERE k IS NULL AND nation % 7 = 2"""


def apply_unsent_columns(spark, d) -> DataFrame:
    """Updates that leave columns out, of rows that stay, that go, and that move to another key."""
    customer = table(spark, d, "customer")
    gap, more = {"c_name": F.lit(None)}, F.col("c_acctbal") + 10
    rows = _made(
        customer, ("c_custkey % 5 = 0", "update", 1, gap, {**gap, "c_acctbal": more}, ("c_name",)),
        ("c_custkey % 15 = 0", "update", 2, gap, {**gap, "c_acctbal": F.lit(None), "c_mktsegment": F.lit("S")}, ("c_name", "c_acctbal")),
        ("c_custkey % 11 = 0", "update", 3, {c: F.lit(None) for c in customer.columns[1:]}, {**gap, "c_custkey": F.col("c_custkey") + 1_000_000, "c_acctbal": F.lit(None)}, ("c_name", "c_acctbal")),
        ("c_custkey % 25 = 0", "delete", 4, {}, None, ()),
    )
    return apply.apply_changes(customer, rows, meta_of(customer, "customer")).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


_UNSENT = """SELECT c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 1000000 ELSE 0 END AS c_custkey, c_name, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 10 ELSE 0 END AS c_acctbal,
  CASE WHEN c_custkey % 15 = 0 AND c_custkey % 11 <> 0 THEN 'S' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 25 <> 0 OR c_custkey % 11 = 0"""


def _sizes(spark, d, chunk=1000):
    rows = table(spark, d, "events").select(F.col("event_type").alias("tb"), F.expr(f"event_id div {chunk}").alias("chunk"), F.octet_length("props").alias("b"))
    return partition.group_sizes(rows, size="b")


def partition_table_even(spark, d) -> DataFrame:
    sizes = _sizes(spark, d).groupBy("tb").agg(F.sum("rows").alias("rows"))
    return partition.even_parts(sizes, 4, 100)


_EVEN = """WITH RECURSIVE s AS (SELECT event_type AS tb, count(*) AS r FROM events GROUP BY 1),
c AS (SELECT tb, r, 4 AS n, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM s WHERE r >= 400
  UNION ALL SELECT tb, r, n, part + 1, b, CAST(CASE WHEN part = 3 THEN r ELSE b + CASE
      WHEN share - share % 100 >= 1 AND share - share % 100 <= most AND (share % 100 <= 50 OR share - share % 100 + 100 > most) THEN share - share % 100
      WHEN share - share % 100 + 100 <= most THEN share - share % 100 + 100 ELSE greatest(1, least(share, most)) END END AS BIGINT)
    FROM (SELECT *, CAST(ceil((r - b) / (n - part)) AS BIGINT) AS share, r - b - (n - part - 1) AS most FROM c WHERE part < 4)),
p AS (SELECT tb, r, part, a, b FROM c WHERE part > 0 UNION ALL SELECT tb, r, 1, 0, r FROM s WHERE r < 400)
SELECT tb, part, a AS start_row, b AS end_row, row_number() OVER (ORDER BY r DESC, tb, part) AS place FROM p"""


def partition_auto_split(spark, d) -> DataFrame:
    """Plans of every strategy over chunk sizes; sizes are a row per chunk, and the plan is made of those."""
    groups = partition.to_groups(_sizes(spark, d).orderBy("tb", "chunk").collect())
    rows = []
    for strategy in ("none", "chunk_largest_first", "auto_split", "table_min_rows", "table_even"):
        plan = partition.plan_parts(groups, 8, partition.Rebalance(strategy, "rows", 50))
        rows += [(strategy, k, p.table, p.chunk, p.start, p.end) for k, p in enumerate(plan)]
    return spark.createDataFrame(rows, "strategy string, place long, tb string, chunk long, start_row long, end_row long")


#: Chunks of 1000 events by type; plans for 8 workers, parts of 50 rows at least.
_PLANS = """WITH RECURSIVE g AS (SELECT event_type AS tb, event_id // 1000 AS chunk, count(*) AS r FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY tb, chunk) AS i FROM g),
tot AS (SELECT sum(r) AS total, greatest(8, least(greatest(1, sum(r) // 50), 32)) AS most, greatest(sum(r) // 8, 50) AS fair FROM g),
h AS (SELECT list({'tb': tb, 'chunk': chunk, 's': CAST(0 AS BIGINT), 'e': CAST(r AS BIGINT)} ORDER BY i) AS l, false AS done FROM o
  UNION ALL SELECT CASE WHEN stop THEN l ELSE list_concat(list_concat(l[1:k - 1], [{'tb': p.tb, 'chunk': p.chunk, 's': p.s, 'e': p.s + lft}]), list_concat(l[k + 1:], [{'tb': p.tb, 'chunk': p.chunk, 's': p.s + lft, 'e': p.e}])) END, stop
  FROM (SELECT *, CAST(CASE WHEN half % 50 <= 25 AND half - half % 50 >= 50 AND half - half % 50 <= m - 50 OR half - half % 50 + 50 > m - 50 THEN half - half % 50 ELSE half - half % 50 + 50 END AS BIGINT) AS lft
    FROM (SELECT *, l[k] AS p, (m + 1) // 2 AS half, len(l) >= most OR m < 100 OR (len(l) >= 8 AND m <= fair * 2) AS stop
      FROM (SELECT *, len(l) + 1 - list_position(list_reverse(list_transform(l, lambda x: x.e - x.s)), m) AS k
        FROM (SELECT l, total, most, fair, list_max(list_transform(l, lambda x: x.e - x.s)) AS m FROM h, tot WHERE NOT done))))),
f AS (SELECT unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM h WHERE done),
n AS (SELECT *, CASE WHEN lag(chunk) OVER (PARTITION BY tb ORDER BY chunk) >= chunk - 1 THEN 0 ELSE 1 END AS fresh FROM g),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY tb ORDER BY chunk) AS run FROM n),
t AS (SELECT tb, min(chunk) AS chunk, CAST(sum(r) AS BIGINT) AS r FROM q GROUP BY tb, run),
c AS (SELECT tb, chunk, r, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM t WHERE r >= 400
  UNION ALL SELECT tb, chunk, r, part + 1, b, CAST(CASE WHEN part = 7 THEN r ELSE b + CASE
      WHEN share - share % 50 >= 1 AND share - share % 50 <= hi AND (share % 50 <= 25 OR share - share % 50 + 50 > hi) THEN share - share % 50
      WHEN share - share % 50 + 50 <= hi THEN share - share % 50 + 50 ELSE greatest(1, least(share, hi)) END END AS BIGINT)
    FROM (SELECT *, CAST(ceil((r - b) / (8 - part)) AS BIGINT) AS share, r - b - (7 - part) AS hi FROM c WHERE part < 8)),
e AS (SELECT tb, chunk, r, part, a, b FROM c WHERE part > 0 UNION ALL SELECT tb, chunk, r, 1, 0, r FROM t WHERE r < 400),
m AS (SELECT tb, chunk, unnest(range(0, r, 50)) AS a, r FROM t)
SELECT 'none' AS strategy, i - 1 AS place, tb, chunk, CAST(0 AS BIGINT) AS start_row, r AS end_row FROM o
UNION ALL SELECT 'chunk_largest_first', row_number() OVER (ORDER BY r DESC, i) - 1, tb, chunk, 0, r FROM o
UNION ALL SELECT 'auto_split', row_number() OVER (ORDER BY x.e - x.s DESC, i) - 1, x.tb, x.chunk, x.s, x.e FROM f
UNION ALL SELECT 'table_min_rows', row_number() OVER (ORDER BY tb, chunk, a) - 1, tb, chunk, a, least(a + 50, r) FROM m
UNION ALL SELECT 'table_even', row_number() OVER (ORDER BY r DESC, tb, chunk, part) - 1, tb, chunk, a, b FROM e"""

_SNAP = CUSTOMER_AFTER
QUERIES = {f.__name__: f for f in (
    merge_lww_events, merge_net_ops, merge_key_change, merge_unmerged_flag, merge_documents, merge_toast_fill, apply_replace, apply_update_only, apply_soft_delete_latest, apply_hard_delete,
    apply_replace_multi_unique, load_rows, inline_check, apply_insert_or_update_values, apply_bag_delete_one, apply_bag_update_one, snapshot_plus_cdc, undo_log, split_updates, before_from_key, drain_segments, replay_runs,
    loop_filter, filter_events_time, last_positions, partition_hash_counts, partition_table_even, partition_auto_split, apply_bag_stream, apply_null_key, apply_unsent_columns,
)}
SQL = {
    "merge_lww_events": _LWW, "merge_net_ops": _NET, "merge_key_change": _KEY_CHANGE, "merge_unmerged_flag": _UNMERGED, "merge_documents": _DOCS, "merge_toast_fill": _TOAST,
    "apply_replace": CUSTOMER_AFTER, "apply_update_only": CUSTOMER_AFTER, "apply_soft_delete_latest": _SOFT, "apply_hard_delete": "SELECT * FROM customer WHERE c_custkey % 7 <> 0",
    "apply_replace_multi_unique": NAMES_TAKEN, "load_rows": _LOAD, "inline_check": _INLINE, "apply_insert_or_update_values": _VALUES, "apply_bag_delete_one": _BAG_DELETE, "apply_bag_update_one": _BAG_UPDATE, "snapshot_plus_cdc": _SNAP,
    "undo_log": _UNDO, "split_updates": _SPLIT, "before_from_key": _BEFORE, "drain_segments": _DRAIN, "replay_runs": _RUNS, "loop_filter": _LOOP, "filter_events_time": _TIME,
    "last_positions": "SELECT event_type, 'binlog.1:' || CAST(max(event_id) AS VARCHAR) AS position, max(event_id) AS seq FROM events GROUP BY event_type",
    "apply_bag_stream": _BAG_STREAM, "apply_null_key": _NULL_KEY, "apply_unsent_columns": _UNSENT, "partition_auto_split": _PLANS, "partition_hash_counts": _HASH, "partition_table_even": _EVEN,
}
