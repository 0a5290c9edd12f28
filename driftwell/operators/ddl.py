"""Statements that define structures and rights: read, route, write again, and carry over to a schema."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import spark_type
from .routing import Router

QUOTES = {"mysql": "`", "pg": '"'}


@dataclass(frozen=True)
class Ddl:
    """``kind`` such as create_table; ``head`` and ``tail`` are the words around the name; ``to`` is the other name of a renaming."""

    kind: str
    schema: str = ""
    table: str = ""
    head: str = ""
    tail: str = ""
    to: tuple[str, str] | None = None
    join: str = ""

    def render(self, dialect: str = "mysql") -> str:
        q = QUOTES[dialect]
        name = lambda s, t: ".".join(f"{q}{x}{q}" for x in (s, t) if x)
        parts = [self.head, name(self.schema, self.table)]
        if self.to:
            parts += [self.join, name(*self.to)]
        return " ".join(p for p in [*parts, self.tail] if p)

    def routed(self, router: Router) -> Ddl:
        """Under the target's names; a renaming's two names are routed each."""
        if not self.table:
            return replace(self, schema=router.schemas.get(self.schema, self.schema))
        schema, table = router.table(self.schema, self.table)
        to = router.table(self.to[0] or self.schema, self.to[1]) if self.to else None
        return replace(self, schema=schema, table=table, to=to)


class _Words:
    """A cursor over a statement without its comments."""

    def __init__(self, text: str, dialect: str):
        self.text, self.at, self.dialect = re.sub(r"/\*.*?\*/|--[^\n]*(?:\n|$)", " ", text, flags=re.S).strip(), 0, dialect

    def take(self, words: str) -> bool:
        m = re.compile(r"\s*" + r"\s+".join(words.split()) + r"(?![\w$])", re.I).match(self.text, self.at)
        if m:
            self.at = m.end()
        return bool(m)

    def identifier(self) -> str:
        m = re.compile(r'\s*(?:`((?:[^`]|``)*)`|"((?:[^"]|"")*)"|([^\s.(),;`"]+))').match(self.text, self.at)
        if not m:
            raise ValueError(f"a name is missing in {self.text!r}")
        self.at = m.end()
        plain = m[3]
        if plain is not None:
            return plain.lower() if self.dialect == "pg" else plain
        return m[1] if m[1] is not None else m[2]

    def name(self) -> tuple[str, str]:
        first = self.identifier()
        m = re.compile(r"\s*\.").match(self.text, self.at)
        if not m:
            return "", first
        self.at = m.end()
        return first, self.identifier()

    def mark(self, sign: str) -> bool:
        m = re.compile(r"\s*" + re.escape(sign)).match(self.text, self.at)
        if m:
            self.at = m.end()
        return bool(m)

    def rest(self) -> str:
        return self.text[self.at :].strip()


def parse_ddl(text: str, dialect: str = "mysql") -> list[Ddl]:
    """The statements of a text: a renaming or dropping of several tables is several.  What isn't DDL gives an empty list."""
    w = _Words(text, dialect)
    for verb, what in (("create", "database"), ("drop", "database"), ("alter", "database"), ("create", "schema"), ("drop", "schema"), ("alter", "schema")):
        if w.take(f"{verb} {what}"):
            head = f"{verb} {what}".upper()
            head += " IF NOT EXISTS" if w.take("if not exists") else " IF EXISTS" if w.take("if exists") else ""
            if what == "schema" and w.take("authorization"):
                head += " AUTHORIZATION"
            return [Ddl(f"{verb}_{what}", schema=w.identifier(), head=head, tail=w.rest())]
    m = re.compile(r"\s*create\s+((?:(?:global|local|temporary|temp|unlogged)\s+)*)table(?![\w$])", re.I).match(w.text)
    if m:
        w.at = m.end()
        head = " ".join(["CREATE", *m[1].split(), "TABLE"]) + (" IF NOT EXISTS" if w.take("if not exists") else "")
        schema, table = w.name()
        return [Ddl("create_table", schema, table, head, w.rest())]
    if w.take("drop table"):
        head = "DROP TABLE" + (" IF EXISTS" if w.take("if exists") else "")
        names = [w.name()]
        while w.mark(","):
            names.append(w.name())
        return [Ddl("drop_table", s, t, head, w.rest()) for s, t in names]
    if w.take("truncate table") or w.take("truncate"):
        names = [w.name()]
        while w.mark(","):
            names.append(w.name())
        return [Ddl("truncate_table", s, t, "TRUNCATE TABLE", w.rest()) for s, t in names]
    if w.take("rename table"):
        found = []
        while not found or w.mark(","):
            old = w.name()
            if not w.take("to"):
                raise ValueError(text)
            found.append(Ddl("rename_table", *old, "RENAME TABLE", "", w.name(), "TO"))
        return found
    if w.take("alter table"):
        head = "ALTER TABLE" + (" IF EXISTS" if w.take("if exists") else "") + (" ONLY" if w.take("only") else "")
        schema, table = w.name()
        keep = w.at
        if w.take("set schema"):
            return [Ddl("alter_table", schema, table, f"{head}", "", (w.identifier(), ""), "SET SCHEMA")]
        if w.take("rename") and not any(w.take(x) for x in ("column", "index", "key", "constraint")):
            w.take("to") or w.take("as")
            rest = w.rest()
            target = w.name()
            if not re.match(r"\S+\s+to\s", rest, re.I):
                return [Ddl("rename_table", schema, table, head, w.rest(), target, "RENAME TO")]
        w.at = keep
        return [Ddl("alter_table", schema, table, head, w.rest())]
    if w.take("create unique index") or w.take("create index"):
        unique = re.match(r"\s*create\s+unique", w.text, re.I)
        start = w.at
        if (on := re.compile(r"\s+on\s+(?:only\s+)?", re.I).search(w.text, start)) is None:
            raise ValueError(text)
        head = f"CREATE{' UNIQUE' if unique else ''} INDEX {w.text[start : on.start()].strip()} ON"
        w.at = on.end()
        schema, table = w.name()
        return [Ddl("create_index", schema, table, head, w.rest())]
    if w.take("drop index"):
        if dialect == "mysql":
            index = w.identifier()
            if not w.take("on"):
                raise ValueError(text)
            schema, table = w.name()
            return [Ddl("drop_index", schema, table, f"DROP INDEX `{index}` ON", w.rest())]
        head = "DROP INDEX" + (" CONCURRENTLY" if w.take("concurrently") else "") + (" IF EXISTS" if w.take("if exists") else "")
        schema, table = w.name()
        return [Ddl("drop_index", schema, table, head, w.rest())]
    return []


#: The first words of statements about users and rights.
DCL_WORDS = {
    "create user": "create_user", "alter user": "alter_user", "drop user": "drop_user", "create role": "create_role", "alter role": "alter_role",
    "drop role": "drop_role", "grant": "grant", "revoke": "revoke", "set role": "set_role", "set default role": "set_default_role",
}


def parse_dcl(text: str) -> str | None:
    """The kind of a statement about rights, or None."""
    w = _Words(text, "mysql")
    return next((kind for words, kind in sorted(DCL_WORDS.items(), key=lambda x: -len(x[0])) if w.take(words)), None)


def with_ddl(statements: DataFrame, column: str = "sql", dialect: str = "mysql") -> DataFrame:
    """A row per statement: ddl_kind, ddl_schema, ddl_table; texts that are no DDL give none.  Texts go through Python in Arrow batches."""
    names = ["ddl_kind", "ddl_schema", "ddl_table"]
    schema = T.StructType([*statements.schema.fields, *(T.StructField(n, T.StringType()) for n in names)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
                try:
                    made = [(d.kind, d.schema, d.table) for d in parse_ddl(text or "", dialect)]
                except ValueError:
                    made = []
                at += [i] * len(made)
                found += made
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array([d[k] for d in found], pa.string()) for k in range(3))], names=[*batch.schema.names, *names])

    return statements.mapInArrow(parse, schema)


def evolve(schema: T.StructType, ddl: Ddl, source: str = "mysql") -> T.StructType:
    """A table's schema after an ALTER: columns added, dropped, renamed, modified; other clauses leave it."""
    fields = list(schema.fields)
    for clause in _clauses(ddl.tail):
        w = _Words(clause, source)
        place = lambda name: next(i for i, f in enumerate(fields) if f.name == name)
        if w.take("add column") or w.take("add") and not any(w.take(x) for x in ("index", "key", "unique", "primary", "constraint", "foreign", "fulltext")):
            w.take("if not exists")
            name = w.identifier()
            kind, required, where = _column(w.rest())
            new = T.StructField(name, spark_type(source, kind), not required)
            at = 0 if where == "first" else place(where) + 1 if where else len(fields)
            fields.insert(at, new)
        elif w.take("drop column") or w.take("drop") and not any(w.take(x) for x in ("index", "key", "primary", "constraint", "foreign")):
            w.take("if exists")
            del fields[place(w.identifier())]
        elif w.take("rename column"):
            k = place(w.identifier())
            w.take("to")
            fields[k] = T.StructField(w.identifier(), fields[k].dataType, fields[k].nullable)
        elif w.take("change column") or w.take("change"):
            k = place(w.identifier())
            name = w.identifier()
            kind, required, _ = _column(w.rest())
            fields[k] = T.StructField(name, spark_type(source, kind), not required)
        elif w.take("modify column") or w.take("modify") or w.take("alter column"):
            k = place(w.identifier())
            w.take("type") or w.take("set data type")
            kind, required, _ = _column(w.rest())
            fields[k] = T.StructField(fields[k].name, spark_type(source, kind), not required)
    return T.StructType(fields)


def _clauses(text: str) -> list[str]:
    """The parts between commas outside parentheses and quotes."""
    return [m[0].strip() for m in re.finditer(r"(?:[^,()'\"`]|\((?:[^()]|\([^()]*\))*\)|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)+", text.rstrip("; \n")) if m[0].strip()]


def _column(text: str) -> tuple[str, bool, str]:
    """(type, whether it refuses nulls, the column it follows or ``first``)"""
    kind = re.match(r"\s*([\w ]*?\w(?:\s*\([^)]*\))?(?:\s+unsigned)?)(?=\s+(?:not|null|default|comment|first|after|auto_increment|primary|unique|collate|character|using)\b|\s*$)", text, re.I)
    after = re.search(r"\bafter\s+`?([^\s`]+)`?", text, re.I)
    return (kind[1] if kind else text).strip(), bool(re.search(r"\bnot\s+null\b", text, re.I)), after[1] if after else "first" if re.search(r"\bfirst\b", text, re.I) else ""


def schema_at(history: DataFrame, seq: int) -> DataFrame:
    """The last known schema of each table before a position: (schema, tb, ddl)."""
    return history.filter(F.col("seq") <= seq).groupBy("schema", "tb").agg(F.max_by("ddl", "seq").alias("ddl"))


def precheck(tables: DataFrame, constraints: DataFrame, kept) -> DataFrame:
    """Findings on tables: (item, level): a table without a primary or unique key is a warning, a foreign key to a table left out is an error.

    ``constraints``: schema, tb, kind, ref_schema, ref_tb; ``kept``: a function from two columns to a condition.
    """
    keyed = constraints.filter(F.col("kind").isin("PRIMARY KEY", "UNIQUE")).select("schema", "tb")
    bare = tables.join(keyed, ["schema", "tb"], "left_anti").select(F.concat_ws(".", "schema", "tb").alias("item"), F.lit("warning").alias("level"))
    lost = constraints.filter((F.col("kind") == "FOREIGN KEY") & F.col("ref_tb").isNotNull() & ~kept(F.col("ref_schema"), F.col("ref_tb")))
    return bare.unionByName(lost.select(F.concat_ws(".", "ref_schema", "ref_tb").alias("item"), F.lit("error").alias("level")).distinct())
