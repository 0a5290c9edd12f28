"""Documents: updates from logs of changes, as ``$set`` and ``$unset``."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .routing import Router


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def diff_update(entry: dict) -> dict:
    """The update of a log entry.

    A ``diff`` nests: ``i`` and ``u`` hold fields to set, ``d`` fields to unset, ``s<field>`` the diff of a sub-document, whose
    fields get dotted names; array marks are ignored.  Without a diff, ``$set`` and ``$unset`` stand as they are.
    """
    put: dict = {}
    gone: dict = {}
    if isinstance(entry.get("diff"), dict):
        work = [("", entry["diff"])]
        while work:
            path, diff = work.pop(0)
            dotted = lambda name, path=path: f"{path}.{name}" if path else name
            for mark, into in (("i", put), ("u", put), ("d", gone)):
                into.update({dotted(k): v for k, v in (diff.get(mark) or {}).items()})
            work += [(dotted(k[1:]), v) for k, v in diff.items() if k[:1] == "s" and len(k) > 1 and isinstance(v, dict)]
    else:
        put.update(entry.get("$set") or {})
        gone.update(entry.get("$unset") or {})
    return {k: v for k, v in (("$set", put), ("$unset", gone)) if v}


def _at(document, path: str):
    for name in path.split("."):
        if not isinstance(document, dict) or name not in document:
            return None
        document = document[name]
    return document


def stream_update(description: dict, full: dict | None) -> dict:
    """The update of a change event: updated and removed fields; a truncated array is set whole from the full document."""
    put = dict(description.get("updatedFields") or {})
    gone = {k: "" for k in description.get("removedFields") or () if isinstance(k, str)}
    for cut in description.get("truncatedArrays") or ():
        if isinstance(cut, dict) and isinstance(cut.get("field"), str) and (value := _at(full, cut["field"])) is not None:
            put[cut["field"]] = value
    return {k: v for k, v in (("$set", put), ("$unset", gone)) if v}


def needs_full(description: dict) -> bool:
    """Whether a path is ambiguous: a component that is text with a dot, or neither text nor a whole number."""
    paths = (description.get("disambiguatedPaths") or {}).values()
    odd = lambda c: "." in c if isinstance(c, str) else isinstance(c, bool) or not isinstance(c, int)
    return any(not isinstance(p, list) or not p or any(map(odd, p)) for p in paths)


def applied(document: dict, update: dict) -> dict:
    """The document after ``$set`` and ``$unset`` with dotted names."""
    out = json.loads(_compact(document))
    for path, value in (update.get("$set") or {}).items():
        *way, last = path.split(".")
        at = out
        for name in way:
            at = at.setdefault(name, {})
        at[last] = value
    for path in update.get("$unset") or {}:
        *way, last = path.split(".")
        at = out
        for name in way:
            at = at.get(name, {}) if isinstance(at, dict) else {}
        if isinstance(at, dict):
            at.pop(last, None)
    return out


def apply_documents(target: DataFrame, changes: DataFrame) -> DataFrame:
    """``target`` (_id, doc: JSON texts) after ``changes`` (op, seq, _id, doc, update), replayed in the order of ``seq``.

    insert and replace give the whole ``doc``, delete removes it, update applies ``update`` (``$set`` and ``$unset``); an update of a document that is
    not there makes one of its id and the fields set.  One aggregation finds each document's last whole state and the updates after it; only
    documents that the batch names leave the target's scan.
    """
    whole = F.when(F.col("op") != "update", F.col("seq"))
    later = F.when(F.col("op") == "update", F.struct("seq", "update"))
    net = changes.groupBy("_id").agg(F.max(whole).alias("since"), F.max_by(F.struct("op", "doc"), whole).alias("last"), F.sort_array(F.collect_list(later)).alias("updates"))
    updates = F.transform(F.filter("updates", lambda u: F.col("since").isNull() | (u["seq"] > F.col("since"))), lambda u: u["update"])
    net = net.select("_id", "since", F.when(F.col("last.op") != "delete", F.col("last.doc")).alias("whole"), updates.alias("updates"))
    kept = target.select("_id", "doc").join(net.select("_id"), "_id", "left_anti")
    known = target.select("_id", "doc").join(net.select("_id"), "_id", "left_semi")
    start = F.when(F.col("since").isNull(), F.col("doc")).otherwise(F.col("whole"))
    met = net.join(known, "_id", "left").select("_id", start.alias("doc"), "updates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = []
            for key, doc, some in zip(*(batch.column(c).to_pylist() for c in ("_id", "doc", "updates")), strict=True):
                if some:
                    state = json.loads(doc) if doc else {"_id": json.loads(key)}
                    for update in some:
                        state = applied(state, json.loads(update or "{}"))
                    doc = _compact(state)
                docs.append(doc)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(docs, pa.string())], names=["_id", "doc"])

    plain = met.filter(F.size("updates") == 0).select("_id", "doc")
    changed = met.filter(F.size("updates") > 0).mapInArrow(run, "_id string, doc string")
    return kept.unionByName(plain.filter("doc IS NOT NULL")).unionByName(changed)


#: Operations of a document store's change events that define structures, and what they are called here.
STRUCTURE_EVENTS = {
    "create": "create_collection", "drop": "drop_collection", "rename": "rename_collection", "dropDatabase": "drop_database", "createIndexes": "create_indexes",
    "dropIndexes": "drop_indexes", "modify": "modify_collection", "shardCollection": "shard_collection",
}


def structure_events(events: DataFrame, event: str = "event", route: Router | None = None) -> DataFrame:
    """The change events (JSON texts) that define structures, with ``ddl_kind``, ``db``, ``coll``, ``to_db``, ``to_coll`` (of a renaming) and ``detail`` (JSON).

    ``route`` gives the target's names of both; other events are left out.
    """
    get = lambda path: F.get_json_object(event, path)
    names = F.create_map(*[F.lit(x) for pair in sorted(STRUCTURE_EVENTS.items()) for x in pair])
    found = events.withColumn("ddl_kind", F.try_element_at(names, get("$.operationType"))).filter("ddl_kind IS NOT NULL")
    place = lambda path: F.struct(get(f"{path}.db").alias("schema"), get(f"{path}.coll").alias("table"))
    routed = lambda x: F.when(x["schema"].isNotNull(), route.routed_names(x["schema"], x["table"])) if route else x
    own, to = routed(place("$.ns")), routed(place("$.to"))
    return found.withColumns({"db": own["schema"], "coll": own["table"], "to_db": to["schema"], "to_coll": to["table"], "detail": get("$.operationDescription")})


def with_updates(entries: DataFrame, entry: str = "entry", full: str | None = None) -> DataFrame:
    """``update`` (JSON text, null where there is nothing to do or the entry is no object); nesting has no bound, so batches go through Python.

    With ``full``, entries are change events and that column is the document after them.
    """
    others = [c for c in entries.columns if c != "update"]
    src = entries.select(*others)

    def read(text):
        try:
            found = json.loads(text) if text else None
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            fulls = batch.column(full).to_pylist() if full else [None] * batch.num_rows
            for text, whole in zip(batch.column(entry).to_pylist(), fulls, strict=True):
                found = read(text)
                update = None if found is None else stream_update(found, read(whole)) if full else diff_update(found)
                made.append(_compact(update) if update else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "update"])

    return src.mapInArrow(run, T.StructType(src.schema.fields + [T.StructField("update", T.StringType())]))


def flat_diff(entry: str = "entry"):
    """One level of a diff without Python: (set, unset) as maps of texts; nested ``s`` members are not followed."""
    part = lambda mark: F.coalesce(F.from_json(F.get_json_object(entry, f"$.diff.{mark}"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.struct(F.map_concat(part("i"), part("u")).alias("set"), part("d").alias("unset"))
