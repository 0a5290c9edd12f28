"""Documents, queues, rates, structures, restarts, databases: small made-up inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.meta import TableMeta
from driftwell.operators import check, documents, envelopes, partition, routing
from driftwell.sources import jdbc, kafka, shared, structures
from driftwell.streaming import limits, unresolved

META = TableMeta("s", "t", ("k", "v"), ("k",))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_documents_against_replay(spark):
    rng = random.Random(1)
    state = {str(k): {"_id": k, "a": {"b": k}} for k in range(6)}
    target = spark.createDataFrame([(k, json.dumps(d)) for k, d in state.items()], "_id string, doc string")
    items = []
    for seq in range(120):
        key, op = str(rng.randrange(9)), rng.choice(["insert", "replace", "delete", "update", "update", "update"])
        doc, update = None, None
        if op in ("insert", "replace"):
            doc = {"_id": int(key), "n": seq}
            state[key] = doc
        elif op == "delete":
            state.pop(key, None)
        else:
            update = rng.choice([{"$set": {f"a.x{rng.randrange(3)}": seq}}, {"$unset": {"n": ""}}, {"$set": {"n": seq}, "$unset": {"a.b": ""}}])
            state[key] = documents.applied(state.get(key, {"_id": int(key)}), update)
        items.append((op, seq, key, doc and json.dumps(doc), update and json.dumps(update)))
    rows = spark.createDataFrame(items, "op string, seq long, _id string, doc string, update string")
    out = {r._id: json.loads(r.doc) for r in documents.apply_documents(target, rows).collect()}
    assert out == state
    assert documents.apply_documents(target.limit(0), rows.limit(0)).count() == 0


def test_avro_messages_come_back(spark):
    kind = "struct<k:long,v:string>"
    rows = spark.createDataFrame([("insert", 1, None, (1, "a")), ("delete", 2, (2, None), None)], f"op string, seq long, before {kind}, after {kind}")
    sent = kafka.avro_messages(envelopes.envelopes(rows, META), {("*", "*"): "all", ("s", "*"): "mine"})
    assert sorted((r.topic, r.key) for r in sent.collect()) == [("mine", "1"), ("mine", "2")]
    back = envelopes.changes_of(envelopes.from_avro(sent), T.StructType().add("k", "long").add("v", "string"), F.lit(1))
    assert got(back) == got(rows.withColumn("seq", F.lit(1).cast("long")))


def test_rates_hold_batches_back(spark):
    now, waits, seen = [0.0], [], []

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    def write(batch, number):
        seen.append((number, batch.count()))
        now[0] += 0.5

    batch = spark.range(100).select(F.lit("12345678").alias("text"))
    limits.limited(write, rows_per_second=50, clock=lambda: now[0], sleep=sleep)(batch, 1)
    limits.limited(write, rows_per_second=1000, clock=lambda: now[0], sleep=sleep)(batch, 2)
    limits.limited(write, bytes_per_second=400, size="octet_length(text)", clock=lambda: now[0], sleep=sleep)(batch, 3)
    assert seen == [(1, 100), (2, 100), (3, 100)] and waits == [1.5, 1.5]
    assert limits.per_batch(200, 0.5) == 100 and limits.per_batch(1, 0.1) == 1


def test_catalogue_and_its_routes(spark):
    columns = spark.createDataFrame([("a", "t", "id", 1, "int", False, None), ("a", "t", "ref", 2, "int", True, "7"), ("a", "u", "id", 1, "int", False, None)], "schema string, tb string, name string, place int, type string, nullable boolean, default string")
    rules = "schema string, tb string, name string, kind string, columns array<string>, ref_schema string, ref_tb string, ref_columns array<string>, condition string"
    constraints = spark.createDataFrame([
        ("a", "t", "pk", "PRIMARY KEY", ["id"], None, None, None, None), ("a", "t", "fk", "FOREIGN KEY", ["ref"], "a", "u", ["id"], None), ("a", "t", "c", "CHECK", None, None, None, None, "id > 0"),
    ], rules)
    indexes = spark.createDataFrame([("a", "t", "i", ["ref", "id"], True)], "schema string, tb string, name string, columns array<string>, is_unique boolean")
    route = routing.Router({"a": "b"}, {("a", "u"): ("c", "w")}, {("a", "t"): {"ref": "link"}, ("a", "u"): {"id": "key"}})
    out = structures.routed({"columns": columns, "constraints": constraints, "indexes": indexes}, route)
    made = {r.key: r.ddl for r in structures.catalogue(out["columns"], out["constraints"], out["indexes"], "pg").collect()}
    assert made == {
        "table.b.t": 'CREATE TABLE IF NOT EXISTS "b"."t" ("id" int NOT NULL, "link" int DEFAULT 7)', "table.c.w": 'CREATE TABLE IF NOT EXISTS "c"."w" ("key" int NOT NULL)',
        "constraint.b.t.pk": 'ALTER TABLE "b"."t" ADD CONSTRAINT "pk" PRIMARY KEY ("id")', "constraint.b.t.c": 'ALTER TABLE "b"."t" ADD CONSTRAINT "c" CHECK (id > 0)',
        "constraint.b.t.fk": 'ALTER TABLE "b"."t" ADD CONSTRAINT "fk" FOREIGN KEY ("link") REFERENCES "c"."w" ("key")', "index.b.t.i": 'CREATE UNIQUE INDEX "i" ON "b"."t" ("link", "id")',
    }
    plain = {r.key for r in structures.catalogue(columns, constraints).collect()}
    assert plain == {"table.a.t", "table.a.u", "constraint.a.t.pk", "constraint.a.t.fk", "constraint.a.t.c"}


def test_a_restart_looks_again(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    dst = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k long, v string")
    keys = src.unionByName(dst).select("k").distinct().unionByName(spark.createDataFrame([(9,)], "k long"))
    state = keys.select(unresolved.key_text(META).alias("key"), F.lit("miss").alias("kind"), F.lit(5).cast("long").alias("seq"))
    found = unresolved.rechecked(state, src, dst, META, 7)
    assert {(json.loads(r.key)["k"], r.kind, r.seq) for r in found.collect()} == {(1, "same", 7), (2, "diff", 7), (3, "miss", 7), (4, "stale", 7), (9, "same", 7)}
    left = unresolved.current(state.unionByName(found))
    assert sorted(json.loads(r.key)["k"] for r in left.collect()) == [2, 3, 4]


def test_serial_rows(spark):
    out = partition.serially(spark.range(20).repartition(4), "id")
    assert [r.id for r in out.collect()] == list(range(20)) and out.rdd.getNumPartitions() == 1


def test_a_cluster_needs_a_shared_folder(spark):
    class Session:
        class sparkContext:  # noqa: N801
            master = "yarn"

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        shared.scratch(Session(), "x")


def test_a_key_with_a_right_and_a_wrong_row_stays_unresolved(spark, tmp_path):
    src = spark.createDataFrame([(k, "a") for k in range(20)], "k long, v string")
    dst = src.unionByName(src.filter("k < 12").withColumn("v", F.lit("b")))
    state = src.select(unresolved.key_text(META).alias("key"), F.lit("diff").alias("kind"), F.lit(1).cast("long").alias("seq"))
    want = sorted((f'{{"k":{k}}}', "diff", 2) for k in range(12))
    found = unresolved.rechecked(state, src, dst, META, 2)
    for rows in (found.orderBy("kind"), found.orderBy(F.desc("kind"))):
        assert got(unresolved.current(state.unionByName(rows.coalesce(1)))) == want
    for n, order in enumerate([F.col("kind"), F.desc("kind")]):
        at = f"{tmp_path}/{n}"
        found.coalesce(1).sortWithinPartitions(order).write.parquet(f"{at}/in")
        stream = unresolved.follow(spark.readStream.schema(found.schema).parquet(f"{at}/in"))
        put = lambda batch, k, at=at: batch.write.mode("append").parquet(f"{at}/out")
        stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        assert got(unresolved.current(spark.read.parquet(f"{at}/out"))) == want


class TestDatabase:
    KIND = "struct<k:long,v:string>"

    @pytest.fixture
    def url(self):
        import uuid

        return f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"

    def changes(self, spark, items):
        return spark.createDataFrame(items, f"op string, seq long, before {self.KIND}, after {self.KIND}, unchanged array<string>")

    def test_null_keys_and_columns_not_sent(self, spark, url):
        meta = TableMeta("s", "t", ("k", "v"), unique=(("k",),), nullable=frozenset("kv"))
        rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
        jdbc.run(spark, url, ['CREATE TABLE t ("k" BIGINT, "v" VARCHAR(20))'], {"user": "app", "password": "x"})
        jdbc.write_rows(rows, url, "t", properties={"user": "app", "password": "x"})
        batch = self.changes(spark, [("update", 1, None, (1, None), ["v"]), ("insert", 2, None, (None, "m"), []), ("delete", 3, (2, None), None, []), ("insert", 4, None, (3, "c"), [])])
        assert jdbc.apply_batch(batch, url, "t", meta, properties={"user": "app", "password": "x"}, key_types={"v": "VARCHAR(20)"}) == []
        assert got(jdbc.read_table(spark, url, "t")) == sorted([(1, "a"), (3, "c"), (None, "m"), (None, "n")], key=repr)

    def test_bags(self, spark, url):
        meta = TableMeta("s", "t", ("k", "v"))
        jdbc.run(spark, url, ['CREATE TABLE t ("k" BIGINT, "v" VARCHAR(20))'])
        jdbc.write_rows(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k long, v string"), url, "t")
        batch = self.changes(spark, [("delete", 1, (1, "a"), None, []), ("insert", 2, None, (None, "b"), []), ("insert", 3, None, (5, "e"), [])])
        jdbc.apply_batch(batch, url, "t", meta, key_types={"v": "VARCHAR(20)"})
        assert got(jdbc.read_table(spark, url, "t")) == sorted([(1, "a"), (None, "b"), (None, "b"), (5, "e")], key=repr)

    def test_rows_that_a_database_refuses(self, spark, url):
        jdbc.run(spark, url, ['CREATE TABLE t ("k" BIGINT PRIMARY KEY, "v" VARCHAR(3))'])
        batch = self.changes(spark, [("insert", 1, None, (1, "ok"), []), ("insert", 2, None, (2, "too long"), []), ("insert", 3, None, (3, "yes"), [])])
        with pytest.raises(Exception):
            jdbc.apply_batch(batch, url, "t", META)
        assert jdbc.read_table(spark, url, "t").count() == 0
        assert jdbc.apply_batch(batch, url, "t", META, row_by_row=True) == [(2,)]
        assert got(jdbc.read_table(spark, url, "t")) == [(1, "ok"), (3, "yes")]


def test_digest_of_wide_rows_agrees(spark):
    src = spark.range(200).select("id", *[(F.col("id") * n).alias(f"c{n}") for n in range(30)])
    dst = src.withColumn("c7", F.when(F.col("id") % 50 == 0, -1).otherwise(F.col("c7")))
    meta = TableMeta("s", "t", tuple(src.columns), ("id",))
    assert [r.id for r in check.by_digest(src, dst, meta).orderBy("id").collect()] == [0, 50, 100, 150]
