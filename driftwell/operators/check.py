"""Source against target: what is missing, what differs, what should not be there.

One equi-join on the key, compared column by column inside generated code.  ``by_digest`` joins keys and 128-bit digests
first and fetches whole rows for the keys that disagree only, which spares wide tables the shuffle of rows that agree.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import canonical, key_percent, same_value
from ..meta import TableMeta
from .merge import compact

DIFF_COLUMNS_KEPT = 8


def null_key(meta: TableMeta) -> Column:
    out = F.lit(False)
    for c in meta.id_cols:
        out = out | F.col(c).isNull()
    return out


def sampled(rows: DataFrame, meta: TableMeta, percent: int | None) -> DataFrame:
    """A share of the keys that is the same on both sides and in every run."""
    return rows if percent is None or percent >= 100 else rows.filter(key_percent(*[F.col(c) for c in meta.id_cols]) < percent)


def _packed(side: DataFrame, meta: TableMeta, name: str) -> DataFrame:
    return side.select(*meta.id_cols, F.struct(*side.columns).alias(name))


def _numbered(packed: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    return packed.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(name)))


def _paired(left: DataFrame, right: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """The n-th row of a key, in the order of all columns, beside the target's n-th.

    Both sides go through one shuffle by key, in which rows are numbered and brought together: a join on key and number would shuffle them
    again, as the engine wants both sides of a join dealt by all of its columns.  Keys of two types are left to that join, which knows how they compare.
    """
    if any(left.schema[c].dataType != right.schema[c].dataType for c in key):
        return _numbered(left, key, "src").join(_numbered(right, key, "dst"), [*key, "_nth"], how)
    both = left.unionByName(right, allowMissingColumns=True).repartition(*key)
    side = Window.partitionBy(*key, F.col("src").isNull()).orderBy("src", "dst")
    pairs = both.withColumn("_nth", F.row_number().over(side)).groupBy(*key, "_nth").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("src", "dst")])
    return pairs if how == "full" else pairs.filter("src IS NOT NULL")


def compared(src: DataFrame, dst: DataFrame, meta: TableMeta, how: str = "left", network: Sequence[str] = (), consume: bool = False) -> DataFrame:
    """Key columns, ``kind`` (same, diff, miss, stale, skip), ``diff_cols`` (sorted), ``src`` and ``dst`` as structs.

    ``left`` asks for the source's rows only, ``full`` also for rows that only the target has.  Rows with a null in the key are
    skipped: they are in the result, but not compared.  Columns that only the target has are ignored; one that it lacks differs
    in each row.  ``consume``: of rows that repeat a key each uses up one of the target's, so a surplus one is a miss.
    """
    left, right = _packed(src.filter(~null_key(meta)), meta, "src"), _packed(dst.filter(~null_key(meta)), meta, "dst")
    key, how = list(meta.id_cols), "left" if how == "left" else "full"
    joined = _paired(left, right, key, how) if consume else left.join(right, key, how)
    unequal = []
    for c in sorted(set(src.columns) - set(meta.id_cols)):
        same = same_value(F.col("src")[c], F.col("dst")[c], c in network) if c in dst.columns else F.lit(False)
        unequal.append(F.when(~same, F.lit(c)))
    both = F.col("src").isNotNull() & F.col("dst").isNotNull()
    names = F.array_compact(F.array(*unequal)) if unequal else F.array().cast("array<string>")
    joined = joined.withColumn("diff_cols", F.when(both, names).otherwise(F.array().cast("array<string>")))
    kind = F.when(F.col("dst").isNull(), "miss").when(F.col("src").isNull(), "stale").when(F.size("diff_cols") > 0, "diff").otherwise("same")
    out = joined.select(*meta.id_cols, kind.alias("kind"), "diff_cols", "src", "dst")
    if not meta.nullable.intersection(meta.id_cols):
        return out
    skipped = src.filter(null_key(meta)).select(*meta.id_cols, F.lit("skip").alias("kind"), F.array().cast("array<string>").alias("diff_cols"), F.struct(*src.columns).alias("src"))
    return out.unionByName(skipped.withColumn("dst", F.lit(None).cast(out.schema["dst"].dataType)))


def _digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """128 bits of the columns; two seeds, as one hash of 64 bits would miss a difference now and then at this scale."""
    cols = [F.col(c) for c in sorted(columns)]
    marks = [F.col(c).isNull() for c in sorted(columns)]
    return F.struct(F.xxhash64(F.lit(1), *cols, *marks).alias("a"), F.xxhash64(F.lit(2), *marks, *cols).alias("b"))


def by_digest(src: DataFrame, dst: DataFrame, meta: TableMeta, how: str = "left") -> DataFrame:
    """What ``compared`` says of rows that do not agree, with full rows shuffled for their keys only.

    Where the target lacks a column of the source every row differs, and no digest can spare one.
    """
    if not set(src.columns) <= set(dst.columns):
        return compared(src, dst, meta, how).filter("kind <> 'same'")
    shared = [c for c in src.columns if c not in meta.id_cols]
    key = list(meta.id_cols)
    left = src.filter(~null_key(meta)).select(*key, _digest(src, shared).alias("_s"))
    right = dst.filter(~null_key(meta)).select(*key, _digest(dst, shared).alias("_d"))
    odd = left.join(right, key, "left" if how == "left" else "full").filter(~F.col("_s").eqNullSafe(F.col("_d"))).select(*key).distinct()
    some = lambda side: side.join(odd, key, "left_semi")
    asked = some(src)
    if meta.nullable.intersection(key):
        asked = asked.unionByName(src.filter(null_key(meta)))  # these are skipped, and said to be
    return compared(asked, some(dst), meta, how).filter("kind <> 'same'")


def missing(src: DataFrame, dst: DataFrame, meta: TableMeta) -> DataFrame:
    """The source's rows whose key the target lacks."""
    return src.filter(~null_key(meta)).join(dst.select(*meta.id_cols), list(meta.id_cols), "left_anti")


def stale(src: DataFrame, dst: DataFrame, meta: TableMeta) -> DataFrame:
    return missing(dst, src, meta)


def deleted_still_there(deletes: DataFrame, dst: DataFrame, meta: TableMeta) -> DataFrame:
    """Keys that the source deleted and the target still has: a difference without columns."""
    return dst.join(deletes.select(*meta.id_cols), list(meta.id_cols), "left_semi")


def applied(changes: DataFrame, target: DataFrame, meta: TableMeta) -> DataFrame:
    """A batch that has just been written, held against the target: its rows by key, and its deletes that are still there (stale).

    Only the batch's keys are looked up, and of a row only the columns that were sent.  Rows with a null in the key are not looked up; a
    table without a key cannot be.
    """
    net = compact(changes, meta)
    alive = net.filter("op = 'upsert'")
    found = compared(alive.select("after.*"), target, meta)
    if "unsent" in net.columns:
        key = list(meta.id_cols)
        found = found.join(alive.select(*key, "unsent"), key, "left").withColumn("diff_cols", F.array_except("diff_cols", F.coalesce("unsent", F.array().cast("array<string>")))).drop("unsent")
        found = found.withColumn("kind", F.when((F.col("kind") == "diff") & (F.size("diff_cols") == 0), "same").otherwise(F.col("kind")))
    there = deleted_still_there(net.filter("op = 'delete'"), target, meta)
    left = there.select(*meta.id_cols, F.lit("stale").alias("kind"), F.array().cast("array<string>").alias("diff_cols"), F.lit(None).cast(found.schema["src"].dataType).alias("src"), F.struct(*target.columns).alias("dst"))
    return found.unionByName(left)


def capped(diff_cols: Column, most: int = DIFF_COLUMNS_KEPT) -> Column:
    """The first columns by name."""
    return F.slice(F.array_sort(diff_cols), 1, most)


def differences(checked: DataFrame, most: int | None = DIFF_COLUMNS_KEPT) -> Column:
    """A map from column to the two values as text, and their types where those differ."""
    source, target = checked.schema["src"].dataType, checked.schema["dst"].dataType
    kinds = {f.name: f.dataType for f in target}
    entries = []
    for f in sorted(source, key=lambda f: f.name):
        to = kinds.get(f.name)
        has = lambda image, kind: F.when(image.isNull(), "None").otherwise(kind)
        a, b = F.col("src")[f.name], F.col("dst")[f.name] if to else F.lit(None)
        st, dt = has(a, f.dataType.simpleString()), (has(b, to.simpleString()) if to else F.lit(None).cast("string"))
        odd = ~st.eqNullSafe(dt)
        value = F.struct(canonical(a, f.dataType).alias("src"), (canonical(b, to) if to else F.lit(None).cast("string")).alias("dst"), F.when(odd, st).alias("src_type"), F.when(odd, dt).alias("dst_type"))
        entries.append(F.struct(F.lit(f.name).alias("key"), value.alias("value")))
    shown = F.col("diff_cols") if most is None else capped(F.col("diff_cols"), most)
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.array_contains(shown, e["key"])))


def _json_text(value: Column) -> Column:
    """A quoted JSON string, or null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("null"))


def _json_member(name: Column, value: Column) -> Column:
    return F.concat(_json_text(name), F.lit(":"), value)


def log_lines(checked: DataFrame, meta: TableMeta, target: tuple[str, str] | None = None, full_rows: bool = False, most: int = DIFF_COLUMNS_KEPT) -> Column:
    """A line of the miss or diff log: one JSON object with sorted names.

    ``meta`` has the source's names; ``target`` is given if the target is called otherwise.  The values' types are shown only where they differ.
    """
    source = checked.schema["src"].dataType
    kinds = {f.name: f.dataType for f in source}
    quoted = lambda c, v: _json_member(F.lit(c), F.when(v.isNull(), F.lit("null")).otherwise(_json_text(v)))
    ids = F.concat(F.lit("{"), F.concat_ws(",", *[quoted(c, canonical(F.col(c), kinds[c])) for c in sorted(meta.id_cols)]), F.lit("}"))
    parts = [quoted("schema", F.lit(meta.schema)), quoted("tb", F.lit(meta.table))]
    if target:
        parts += [quoted("target_schema", F.lit(target[0])), quoted("target_tb", F.lit(target[1]))]
    parts.append(F.concat(F.lit('"id_col_values":'), ids))
    found = F.map_entries(differences(checked, most))
    one = lambda e: _json_member(
        e["key"],
        F.concat(F.lit("{"), F.concat_ws(",", *[quoted(k, e["value"][k]) for k in ("src", "dst")], *[F.when(e["value"][k].isNotNull(), quoted(k, e["value"][k])) for k in ("src_type", "dst_type")]), F.lit("}")),
    )
    shown = F.concat(F.lit('"diff_col_values":{'), F.array_join(F.transform(found, one), ","), F.lit("}"))
    parts.append(F.when(F.col("kind") == "diff", shown))
    if full_rows:
        row = lambda name: F.when(F.col(name).isNotNull(), F.concat(F.lit(f'"{name}_row":'), F.to_json(F.struct(*[F.col(name)[c].alias(c) for c in sorted(checked.schema[name].dataType.names)]), {"ignoreNullFields": "false"})))
        parts += [row("src"), row("dst")]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def summary(checked: DataFrame, by: Sequence[str] = ("schema", "tb"), total: bool = False) -> DataFrame:
    """Counts per table, and over all with nulls for the names; a table is consistent if nothing is missing, differs or was skipped."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    grouped = checked.rollup(*by) if total else checked.groupBy(*by)
    found = grouped.agg(
        n("same", "diff", "miss", "stale").alias("checked_count"), n("miss").alias("miss_count"), n("diff", "stale").alias("diff_count"), n("skip").alias("skip_count"),
        *([F.grouping_id().alias("_level")] if total else []),
    )
    if total:
        found = found.filter(F.col("_level").isin(0, (1 << len(by)) - 1)).drop("_level")
    return found.withColumn("is_consistent", (F.col("miss_count") + F.col("diff_count") + F.col("skip_count")) == 0)


def recheck(keys: DataFrame, src: DataFrame, dst: DataFrame, meta: TableMeta) -> DataFrame:
    """What has become of logged keys: compared again if both sides have them, else miss, stale or clear."""
    key = list(meta.id_cols)
    asked = keys.select(*key).distinct()
    some = lambda side: side.join(asked, key, "left_semi")
    found = compared(some(src), some(dst), meta, "full")
    outcome = F.when(F.col("kind") == "same", "clear").otherwise(F.coalesce("kind", F.lit("clear")))
    return asked.join(found, key, "left").withColumn("outcome", outcome)


def with_retries(read: Callable[[], tuple[DataFrame, DataFrame]], meta: TableMeta, retries: int, wait: Callable[[], None] = lambda: None, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Rows that disagree are looked at again, each time over the keys that still do; the last look decides.

    ``read`` gives the two sides as they are now.  ``settle`` cuts the lineage of the residual keys (a written table in production).
    """
    src, dst = read()
    odd = settle(compared(src, dst, meta).filter("kind IN ('miss', 'diff')"))
    for _ in range(retries):
        wait()
        src, dst = read()
        again = src.join(odd.select(*meta.id_cols), list(meta.id_cols), "left_semi")
        odd = settle(compared(again, dst, meta).filter("kind IN ('miss', 'diff')"))
    return odd


def newest_lines(lines: DataFrame, order: str, line: str, max_rows: int, max_bytes: int) -> DataFrame:
    """The newest lines that fit under both caps; the row cap bounds what is sorted in one place."""
    top = lines.orderBy(F.desc(order)).limit(max_rows)
    size = F.sum(F.octet_length(line) + 1).over(Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return top.withColumn("_size", size).filter(F.col("_size") <= max_bytes).drop("_size")


def structures(src: DataFrame, dst: DataFrame, key: str = "key", text: str = "ddl") -> DataFrame:
    """Catalogue objects by name: miss if the target lacks one, diff if the texts differ or only the target has it."""
    a, b = src.select(key, F.col(text).alias("src_ddl")), dst.select(key, F.col(text).alias("dst_ddl"))
    joined = a.join(b, key, "full")
    kind = F.when(F.col("dst_ddl").isNull(), "miss").when(~F.col("src_ddl").eqNullSafe(F.col("dst_ddl")), "diff").otherwise("same")
    return joined.withColumn("kind", kind)


def documents(src: Column, dst: Column) -> Column:
    """Top-level fields of two documents (JSON text) that differ: a map from field to the two values, null where a side lacks it."""
    fields = lambda doc: F.coalesce(F.from_json(doc, "map<string,string>"), F.create_map().cast("map<string,string>"))
    both = F.map_zip_with(fields(src), fields(dst), lambda _, a, b: F.struct(a.alias("src"), b.alias("dst")))
    return F.map_filter(both, lambda _, v: ~v["src"].eqNullSafe(v["dst"]))


def missing_target(src: DataFrame, meta: TableMeta) -> DataFrame:
    """Without a target table each row with a key is a miss."""
    return compared(src, src.limit(0), meta)


def under_names(checked: DataFrame, meta: TableMeta, names: Mapping[str, str]) -> DataFrame:
    """What ``compared`` gives, with columns renamed by ``names`` in keys, images and ``diff_cols``: the target's names to the source's.

    All are renamed at once, so names may be swapped.  A column that only the target has keeps its name, or goes if that is taken.
    """
    if not names:
        return checked
    new = {c: names.get(c, c) for c in checked.schema["src"].dataType.names}
    others = [c for c in checked.schema["dst"].dataType.names if c not in new]
    taken = set(new.values())
    image = lambda name, pairs: F.when(F.col(name).isNotNull(), F.struct(*[F.col(name)[a].alias(b) for a, b in pairs])).alias(name)
    known = checked.schema["dst"].dataType.names
    renamed = F.transform("diff_cols", lambda c: F.element_at(F.create_map(*[F.lit(x) for pair in sorted(new.items()) for x in pair]), c))
    return checked.select(
        *[F.col(c).alias(new[c]) for c in meta.id_cols], "kind", F.array_sort(renamed).alias("diff_cols"), image("src", new.items()),
        image("dst", [(a, b) for a, b in new.items() if a in known] + [(c, c) for c in others if c not in taken]),
        *[c for c in checked.columns if c not in {*meta.id_cols, "kind", "diff_cols", "src", "dst"}],
    )
