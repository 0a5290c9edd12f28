"""Changes that no merge by key covers: tables without a key, nulls in the key, columns that were not sent.

The contract is replay in the order of ``seq``.  Each case is brought to aggregations and joins, so no row waits for another:

* a bag's copies of one row are a walk that never falls below zero; its end needs only the sum of the steps and the lowest point;
* a row with a null in its key is changed by what comes after it: the last delete of its key ends it, the last value sent of each column holds;
* an update that moves a row to another key takes unsent columns from where the row was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..meta import TableMeta
from .merge import has_null, images, is_moved

#: So many numbers of ``seq`` are walked in one sort; the slices of a walk are then added up.
SLICE = 1 << 16


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def bag(target: DataFrame, changes: DataFrame) -> DataFrame:
    """A keyless table after the changes: an insert adds a copy, a delete removes one copy if there is one, an update is both.

    Columns that an update did not send are those of its old image.  Rows whose value no change names are neither shuffled nor counted.
    """
    columns = target.columns
    values, named = [f"v{n}" for n in range(len(columns))], [f"c{n}" for n in range(len(columns))]
    unsent = F.coalesce("unchanged", F.array().cast("array<string>")) if "unchanged" in changes.columns else F.array().cast("array<string>")
    old = F.struct(*[F.col("before")[c].alias(v) for c, v in zip(columns, values, strict=True)])
    kept = lambda c: (F.col("op") == "update") & F.array_contains(unsent, c)
    new = F.struct(*[F.when(kept(c), F.col("before")[c]).otherwise(F.col("after")[c]).alias(v) for c, v in zip(columns, values, strict=True)])
    step = lambda row, part, by: F.struct(row.alias("row"), F.lit(part).alias("part"), F.lit(by).alias("by"))
    lost, won = step(old, 0, -1), step(new, 1, 1)
    each = F.when(F.col("op") == "insert", F.array(won)).when(F.col("op") == "delete", F.array(lost)).otherwise(F.array(lost, won))
    steps = changes.select("seq", F.explode(each).alias("s")).select("s.row.*", "s.part", "s.by", "seq", F.floor(F.col("seq") / SLICE).alias("slice"))
    height = F.sum("by").over(Window.partitionBy(*values, "slice").orderBy("seq", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slices = steps.withColumn("height", height).groupBy(*values, "slice").agg(F.sum("by").alias("total"), F.min("height").alias("low"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy(*values).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    walks = slices.withColumn("low", before + F.col("low")).groupBy(*values).agg(F.sum("total").alias("total"), F.min("low").alias("low"))
    rows = target.toDF(*named)
    untouched = rows.join(walks.select(*values), _same(named, values), "left_anti")
    there = rows.join(walks.select(*values), _same(named, values), "left_semi").groupBy(*named).agg(F.count("*").alias("n"))
    both = walks.join(there, _same(values, named), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    left = both.withColumn("n", F.col("n") + F.col("total") - F.least(F.lit(0), F.col("n") + F.col("low"))).filter("n > 0")
    copies = left.select(*values, F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(*values)
    return untouched.toDF(*columns).union(copies.toDF(*columns))


def null_keyed(target: DataFrame, flat: DataFrame, meta: TableMeta) -> DataFrame:
    """The rows with a null in the key after the changes in ``flat`` (``images``).

    null equals null: a delete removes each row of its key and an update changes each; an insert adds one, as nulls conflict with nothing.
    An update of a key that no row has does nothing.
    """
    columns, key = target.columns, list(meta.id_cols)
    rows = target.filter(has_null(key)).select(F.struct(*columns).alias("row"), F.lit(-1).cast("long").alias("since"), *[F.col(c).alias(f"c{n}") for n, c in enumerate(key)])
    at = (F.col("seq") * 2 + F.col("part")).cast("long")
    odd = flat.filter(has_null(key)).select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(key)], "op", "after", at.alias("at"), (F.col("unsent") if "unsent" in flat.columns else F.array().cast("array<string>")).alias("unsent"))
    keys, own = [f"k{n}" for n in range(len(key))], [f"c{n}" for n in range(len(key))]
    others = {c: f"got{n}" for n, c in enumerate(columns) if c not in key}
    sent = lambda c: (F.col("op") == "update") & ~F.array_contains("unsent", c)
    ends = odd.groupBy(*keys).agg(
        F.max(F.when(F.col("op") == "delete", F.col("at"))).alias("gone"),
        *[F.max_by(F.struct("at", F.col("after")[c].alias("value")), F.when(sent(c), F.col("at"))).alias(name) for c, name in others.items()],
    )
    born = odd.filter("op = 'insert'").select(F.struct(*[F.col("after")[c].alias(c) for c in columns]).alias("row"), F.col("at").alias("since"), *[F.col(k).alias(c) for k, c in zip(keys, own, strict=True)])
    met = rows.unionByName(born).join(ends, _same(own, keys), "left").filter("gone IS NULL OR since > gone")
    later = lambda name: F.col(name).isNotNull() & (F.col(f"{name}.at") > F.col("since"))
    return met.select(*[(F.when(later(others[c]), F.col(f"{others[c]}.value")).otherwise(F.col("row")[c]) if c in others else F.col("row")[c]).alias(c) for c in columns])


def moved_values(target: DataFrame, changes: DataFrame, meta: TableMeta) -> DataFrame:
    """Changes whose moves to another key have all columns: those not sent come from the old image, else from the batch's last
    image of the old key that has them, else from the target's row.

    A column that none of these gives (the row has moved twice in the batch without it) is an error, not a null.
    """
    moves = is_moved(meta) & (F.size(F.coalesce("unchanged", F.array().cast("array<string>"))) > 0)
    fields = changes.schema["after"].dataType.names
    key = list(meta.id_cols)
    keys, old = [f"k{n}" for n in range(len(key))], [f"c{n}" for n in range(len(key))]
    moving = changes.filter(moves).select("*", *[F.col("before")[c].alias(k) for c, k in zip(key, keys, strict=True)])
    flat = images(changes, meta, moves_are_whole=False).filter("op <> 'delete'")
    seen = flat.select(*[F.col(c).alias(k) for c, k in zip(key, old, strict=True)], F.col("seq").alias("s"), F.col("after").alias("image"), "unsent")
    names = [f"a{n}" for n in range(len(key))]
    asked = moving.select(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.col("seq").alias("of"))
    sent = lambda c: F.when(~F.array_contains("unsent", c), F.col("s"))
    batch = asked.join(seen, _same(names, old) & (F.col("s") < F.col("of"))).groupBy(*names, "of").agg(*[F.max_by(F.struct(F.col("image")[c].alias("value")), sent(c)).alias(f"got{n}") for n, c in enumerate(fields)])
    there = target.select(F.struct(*target.columns).alias("there"), *[F.col(c).alias(k) for c, k in zip(key, old, strict=True)])
    there = there.join(asked.select(*names).distinct(), _same(old, names), "left_semi")
    full = moving.join(batch, (F.col("seq") == F.col("of")) & _same(keys, names), "left").join(there, _same(keys, old), "left")

    def value(n: int, c: str) -> Column:
        lost = F.raise_error(F.concat(F.lit(f"{meta.schema}.{meta.table}: no value of {c} for the row moved at "), F.col("seq").cast("string")))
        found = F.when(F.col(f"got{n}").isNotNull(), F.col(f"got{n}.value")).when(F.col("there").isNotNull(), F.col("there")[c]) if c in target.columns else F.lit(None)
        found = found.otherwise(lost.cast(changes.schema["after"].dataType[c].dataType)) if c in target.columns else found
        unsent = F.array_contains("unchanged", c)
        return F.when(~unsent, F.col("after")[c]).when(F.col("before")[c].isNotNull(), F.col("before")[c]).otherwise(found).alias(c)

    after = F.struct(*[value(n, c) for n, c in enumerate(fields)])
    done = full.withColumns({"after": after, "unchanged": F.array().cast("array<string>")}).select(*changes.columns)
    return changes.filter(~moves).unionByName(done)
