"""Which tables, rows, columns, events and statements take part."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTES = ("`", '"')
RAW = ("r#", "#")
Pair = tuple[str, str]


def tokens(text: str, delimiters: str = ",.", quotes: Sequence[str] = QUOTES) -> list[str]:
    """The tokens of a setting such as ``db_1.tb_*,`a.b`.c``; quoted and raw tokens may hold delimiters, quotes stay."""
    quoted = "|".join(f"{re.escape(q)}[^{re.escape(q)}]*{re.escape(q)}" for q in quotes)
    plain = f"[^{re.escape(delimiters)}]+"
    found = re.compile(rf"\s*({quoted}|r#.*?#(?=[{re.escape(delimiters)}]|\s*$)|{plain})\s*(?:[{re.escape(delimiters)}]|$)")
    out, at = [], 0
    while at < len(text):
        m = found.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read {text[at:]!r}")
        out.append(m[1].strip())
        at = m.end()
    return out


def unquoted(token: str, quotes: Sequence[str] = QUOTES) -> str:
    return token[1:-1] if len(token) >= 2 and token[0] in quotes and token[-1] == token[0] else token


def pairs(text: str) -> frozenset[Pair]:
    """``a.b,c.d`` as pairs."""
    found = tokens(text)
    if len(found) % 2:
        raise ValueError(f"{text!r} is not a list of schema.table")
    return frozenset(zip(found[::2], found[1::2], strict=True))


def pattern_regex(token: str, quotes: Sequence[str] = QUOTES) -> str | None:
    """The regular expression of a token, or None if the token stands for itself only.

    ``*`` is any text, ``?`` at most one character; a quoted token is taken literally; ``r#...#`` is an expression as it is.
    """
    if unquoted(token, quotes) != token:
        return None
    if token.startswith(RAW[0]) and token.endswith(RAW[1]) and len(token) > 2:
        return f"^(?:{token[len(RAW[0]) : -len(RAW[1])]})$"
    if not re.search(r"[*?]", token):
        return None
    return "^" + re.escape(token).replace(r"\*", ".*").replace(r"\?", ".?") + "$"


def name_matches(name: Column, token: str) -> Column:
    rule = pattern_regex(token)
    return name == F.lit(unquoted(token)) if rule is None else name.rlike(rule)


def _fits(name: str, token: str) -> bool:
    rule = pattern_regex(token)
    return name == unquoted(token) if rule is None else re.search(rule, name) is not None


def _any(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


@dataclass(frozen=True)
class TableFilter:
    """What is ignored wins over what is asked for; what is neither is left out.

    Empty ``do_ddls`` and ``do_dcls`` mean none, ``*`` means all.
    """

    do_schemas: frozenset[str] = frozenset()
    ignore_schemas: frozenset[str] = frozenset()
    do_tables: frozenset[Pair] = frozenset()
    ignore_tables: frozenset[Pair] = frozenset()
    do_events: frozenset[str] = frozenset({"*"})
    do_ddls: frozenset[str] = frozenset()
    do_dcls: frozenset[str] = frozenset()
    do_structures: frozenset[str] = frozenset({"*"})
    ignore_commands: frozenset[str] = frozenset()
    ignore_columns: Mapping[Pair, frozenset[str]] = field(default_factory=dict)
    conditions: Mapping[Pair, str] = field(default_factory=dict)

    @classmethod
    def read(cls, settings: Mapping[str, str]) -> TableFilter:
        """From text settings: do_dbs, ignore_dbs, do_tbs, ignore_tbs, do_events, do_ddls, do_dcls, do_structures, ignore_cmds, ignore_cols, where_conditions."""
        one = lambda k, none="": frozenset(tokens(settings.get(k, "") or none))
        rows = lambda k: json.loads((settings.get(k) or "json:[]").removeprefix("json:"))
        return cls(
            one("do_dbs"), one("ignore_dbs"), pairs(settings.get("do_tbs", "")), pairs(settings.get("ignore_tbs", "")),
            one("do_events", "*"), one("do_ddls"), one("do_dcls"), one("do_structures", "*"), one("ignore_cmds"),
            {(x["db"], x["tb"]): frozenset(x["ignore_cols"]) for x in rows("ignore_cols")},
            {(x["db"], x["tb"]): x["condition"] for x in rows("where_conditions")},
        )

    def keeps(self, schema: str, table: str) -> bool:
        """For names that the driver holds: tables are pruned before anything is scanned."""
        hit = lambda schemas, tables: any(_fits(schema, s) for s in schemas) or any(_fits(schema, s) and _fits(table, t) for s, t in tables)
        return hit(self.do_schemas, self.do_tables) and not hit(self.ignore_schemas, self.ignore_tables)

    def table_kept(self, schema: Column, table: Column) -> Column:
        """For names in a column; null names are left out."""
        hit = lambda schemas, tables: _any([name_matches(schema, s) for s in schemas] + [name_matches(schema, s) & name_matches(table, t) for s, t in tables])
        return F.coalesce(hit(sorted(self.do_schemas), sorted(self.do_tables)) & ~hit(sorted(self.ignore_schemas), sorted(self.ignore_tables)), F.lit(False))

    def schema_kept(self, schema: Column) -> Column:
        """A schema is asked for if any of its tables is; it is ignored if all its tables are."""
        asked = sorted(self.do_schemas | {s for s, _ in self.do_tables})
        ignored = sorted(self.ignore_schemas | {s for s, t in self.ignore_tables if t == "*"})
        any_of = lambda names: _any(name_matches(schema, s) for s in names)
        return F.coalesce(any_of(asked) & ~any_of(ignored), F.lit(False))

    @staticmethod
    def _member(value: Column, names: frozenset[str]) -> Column:
        return F.lit(True) if names == {"*"} else value.isin(sorted(names))

    def event_kept(self, op: Column) -> Column:
        return self._member(op, self.do_events)

    def ddl_kept(self, kind: Column, schema: Column, table: Column) -> Column:
        """A statement without a table is judged by its schema."""
        where = F.when(F.coalesce(table, F.lit("")) == "", self.schema_kept(schema)).otherwise(self.table_kept(schema, table))
        return self._member(kind, self.do_ddls) & where

    def dcl_kept(self, kind: Column) -> Column:
        return self._member(kind, self.do_dcls)

    def structure_kept(self, kind: Column) -> Column:
        return self._member(kind, self.do_structures)

    def command_kept(self, command: Column) -> Column:
        return ~command.isin(sorted(self.ignore_commands)) if self.ignore_commands else F.lit(True)

    def prune(self, df: DataFrame, schema: str, table: str) -> DataFrame:
        """Row condition and columns of one table; both reach the scan."""
        if condition := self.conditions.get((schema, table)):
            df = df.filter(condition)
        return df.drop(*self.ignore_columns.get((schema, table), ()))


def within(changes: DataFrame, start=None, end=None, txn: str = "txn", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The change rows of a time window, by whole transactions.

    The first transaction that begins at or after ``start`` opens the window, the first that begins at or after ``end``
    closes it, whatever the clock does in between.  Two scalar subqueries over the transactions' begins; no ordered window.
    """
    begins = changes.groupBy(txn).agg(F.min(F.struct(seq, ts)).alias("b")).select(F.col(f"b.{seq}").alias("at"), F.col(f"b.{ts}").alias("begin"))
    out = changes
    if start is not None:
        first = begins.filter(F.col("begin") >= F.lit(start).cast(changes.schema[ts].dataType)).agg(F.min("at"))
        out = out.filter(F.col(seq) >= first.scalar())
    if end is not None:
        last = begins.filter(F.col("begin") >= F.lit(end).cast(changes.schema[ts].dataType)).agg(F.coalesce(F.min("at"), F.lit((1 << 63) - 1)))
        out = out.filter(F.col(seq) < last.scalar())
    return out
