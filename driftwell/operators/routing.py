"""Renaming of schemas, tables, columns and topics, forwards and backwards."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import Pair, tokens, unquoted


def _lookup(key: Column, entries: Mapping[str, str]) -> Column:
    """A literal map; null where it has no entry.  Maps come from settings, so they are as small as those."""
    if not entries:
        return F.lit(None).cast("string")
    flat = [F.lit(x) for kv in sorted(entries.items()) for x in kv]
    return F.try_element_at(F.create_map(*flat), key)


def _pair_key(schema: Column, table: Column) -> Column:
    return F.concat_ws("\x1f", schema, table)


@dataclass(frozen=True)
class Router:
    """A table's own entry beats its schema's; names without an entry stay.  No wildcards."""

    schemas: Mapping[str, str] = field(default_factory=dict)
    tables: Mapping[Pair, Pair] = field(default_factory=dict)
    columns: Mapping[Pair, Mapping[str, str]] = field(default_factory=dict)

    @classmethod
    def read(cls, settings: Mapping[str, str]) -> Router:
        """From text settings: db_map, tb_map, col_map."""
        split = lambda k: [unquoted(t) for t in tokens(settings.get(k, ""), ",.:")]
        s, t = split("db_map"), split("tb_map")
        rows = json.loads((settings.get("col_map") or "json:[]").removeprefix("json:"))
        return cls(
            dict(zip(s[::2], s[1::2], strict=True)),
            {(t[i], t[i + 1]): (t[i + 2], t[i + 3]) for i in range(0, len(t), 4)},
            {(x["db"], x["tb"]): x["col_map"] for x in rows},
        )

    def table(self, schema: str, table: str) -> Pair:
        return self.tables.get((schema, table), (self.schemas.get(schema, schema), table))

    def reverse(self) -> Router:
        back = {self.table(*src): {v: k for k, v in names.items()} for src, names in self.columns.items()}
        return Router({v: k for k, v in self.schemas.items()}, {v: k for k, v in self.tables.items()}, back)

    def routed_names(self, schema: Column, table: Column) -> Column:
        """A struct of the target's schema and table."""
        key = _pair_key(schema, table)
        joined = {"\x1f".join(k): v for k, v in self.tables.items()}
        own_schema = _lookup(key, {k: v[0] for k, v in joined.items()})
        own_table = _lookup(key, {k: v[1] for k, v in joined.items()})
        return F.struct(F.coalesce(own_schema, _lookup(schema, self.schemas), schema).alias("schema"), F.coalesce(own_table, table).alias("table"))

    def rename(self, df: DataFrame, schema: str, table: str) -> DataFrame:
        return df.withColumnsRenamed(dict(self.columns.get((schema, table), {})))

    def rename_images(self, changes: DataFrame, schema: str, table: str) -> DataFrame:
        """Both images of a change are renamed alike."""
        names = self.columns.get((schema, table), {})
        out = changes
        for image in ("before", "after"):
            fields = changes.schema[image].dataType.names
            renamed = F.struct(*[F.col(image)[f].alias(names.get(f, f)) for f in fields])
            out = out.withColumn(image, F.when(F.col(image).isNotNull(), renamed))
        return out


def topic(schema: Column, table: Column, topics: Mapping[Pair, str]) -> Column:
    """The topic of a table: its own entry, else its schema's ``*``, else ``*.*``, else the empty text."""
    exact = {"\x1f".join(k): v for k, v in topics.items() if "*" not in k}
    schemas = {k[0]: v for k, v in topics.items() if k[1] == "*" and k[0] != "*"}
    return F.coalesce(_lookup(_pair_key(schema, table), exact), _lookup(schema, schemas), F.lit(topics.get(("*", "*"), "")))


def read_topics(text: str) -> dict[Pair, str]:
    """``*.*:t1,db.*:t2,db.tb:t3``"""
    t = [unquoted(x) for x in tokens(text, ",.:")]
    return {(t[i], t[i + 1]): t[i + 2] for i in range(0, len(t), 3)}


def route_db(db: Column, mapping: Mapping[int, int], cluster: bool = False) -> Column:
    """Key-value databases are numbers; a cluster has only 0."""
    if cluster and any(mapping.values()):
        raise ValueError("a cluster has database 0 only")
    out = db
    for source, target in sorted(mapping.items()):
        out = F.when(db == source, F.lit(target)).otherwise(out)
    return out
