"""A whole task over many tables: what takes part, under which names, merged and applied how, checked how.

Tables are pruned on the driver before anything is read; each table's plan is a DataFrame, so a task's tables run as Spark schedules them.
"""

from __future__ import annotations

import configparser
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import kinds_of, revise_sql
from ..meta import TableMeta
from ..operators import apply, check
from ..operators.filters import Pair, TableFilter
from ..operators.routing import Router

Reader = Callable[[str, str], DataFrame]


@dataclass(frozen=True)
class TaskSpec:
    """``hook``: user code on the change rows of a table, after routing; ``mode``: upsert or update_only."""

    filter: TableFilter = TableFilter()
    router: Router = Router()
    mode: str = "upsert"
    sample_percent: int | None = None
    full_rows: bool = False
    revise: bool = False
    match_full_row: bool = False
    dialect: str = "mysql"
    hook: Callable[[DataFrame, TableMeta], DataFrame] | None = None
    network_columns: Mapping[Pair, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def read(cls, text: str) -> TaskSpec:
        """From the sections [filter], [router], [sinker] and [checker] of a task file; other sections concern what Spark's session holds."""
        ini = configparser.RawConfigParser(strict=False)
        ini.read_string(text)
        part = lambda name: dict(ini[name]) if ini.has_section(name) else {}
        sink, checks, source = part("sinker"), part("checker"), part("extractor")
        flag = lambda section, key: section.get(key, "false").lower() == "true"
        rate = checks.get("sample_rate") or source.get("sample_rate")
        return cls(
            TableFilter.read(part("filter")), Router.read(part("router")), "upsert" if sink.get("replace", "true").lower() == "true" else "update_only",
            int(rate) if rate else None, flag(checks, "output_full_row"), flag(checks, "output_revise_sql"), flag(checks, "revise_match_full_row"),
            "pg" if (sink.get("db_type") or source.get("db_type", "")) == "pg" else "mysql",
        )

    def tables(self, names: Iterable[Pair]) -> list[Pair]:
        return [n for n in names if self.filter.keeps(*n)]

    def target_meta(self, meta: TableMeta) -> TableMeta:
        """A table's meta under the target's names, without the columns left out."""
        schema, table = self.router.table(meta.schema, meta.table)
        gone = self.filter.ignore_columns.get((meta.schema, meta.table), frozenset())
        names = self.router.columns.get((meta.schema, meta.table), {})
        to = lambda cols: tuple(names.get(c, c) for c in cols)
        kept = tuple(c for c in meta.columns if c not in gone)
        whole = lambda key: not gone.intersection(key)
        return TableMeta(schema, table, to(kept), to(meta.primary) if whole(meta.primary) else (), tuple(to(k) for k in meta.unique if whole(k)), frozenset(to(meta.nullable)))

    def applied(self, target: DataFrame, changes: DataFrame, meta: TableMeta) -> DataFrame:
        """The target after a batch: where MySQL's REPLACE writes, a written row takes every row that shares any unique key with it."""
        if self.mode == "upsert" and self.dialect == "mysql" and len(meta.keys) > 1:
            return apply.replace_rows(target, changes, meta)
        return apply.apply_changes(target, changes, meta, "upsert" if meta.is_bag else self.mode)

    def source_meta(self, meta: TableMeta, to: TableMeta, back: Mapping[str, str]) -> TableMeta:
        """The target's meta under the source's names again."""
        old = lambda cols: tuple(back.get(c, c) for c in cols)
        return TableMeta(meta.schema, meta.table, old(to.columns), old(to.primary), tuple(old(k) for k in to.unique), frozenset(old(to.nullable)))

    def source_rows(self, read: Reader, meta: TableMeta) -> DataFrame:
        """A table's rows as the target shall have them; conditions and columns reach the scan."""
        rows = self.filter.prune(read(meta.schema, meta.table), meta.schema, meta.table)
        return self.router.rename(rows, meta.schema, meta.table)


def snapshot(spec: TaskSpec, read: Reader, metas: Iterable[TableMeta]) -> dict[Pair, DataFrame]:
    """The target's tables."""
    chosen = [m for m in metas if spec.filter.keeps(m.schema, m.table)]
    return {spec.router.table(m.schema, m.table): spec.source_rows(read, m) for m in chosen}


def cdc(spec: TaskSpec, changes: Reader, targets: Reader, metas: Iterable[TableMeta]) -> dict[Pair, DataFrame]:
    """The target's tables after a batch of changes of the source's."""
    out = {}
    for m in metas:
        if not spec.filter.keeps(m.schema, m.table):
            continue
        to = spec.target_meta(m)
        rows = changes(m.schema, m.table)
        rows = rows.filter(spec.filter.event_kept(F.col("op")))
        gone = spec.filter.ignore_columns.get((m.schema, m.table), frozenset())
        for image in ("before", "after"):
            if gone:
                rows = rows.withColumn(image, F.col(image).dropFields(*sorted(gone)))
        rows = spec.router.rename_images(rows, m.schema, m.table)
        if spec.hook:
            rows = spec.hook(rows, to)
        out[to.schema, to.table] = spec.applied(targets(to.schema, to.table), rows, to)
    return out


def check_tables(spec: TaskSpec, sources: Reader, targets: Reader, metas: Iterable[TableMeta]) -> DataFrame:
    """One row per checked row of any table: schema, tb (the source's), kind, line (of the log) and, if asked for, statement."""
    found = None
    for m in metas:
        if not spec.filter.keeps(m.schema, m.table):
            continue
        to = spec.target_meta(m)
        src = check.sampled(spec.source_rows(sources, m), to, spec.sample_percent)
        one = check.compared(src, targets(to.schema, to.table), to, network=spec.network_columns.get((m.schema, m.table), ()), consume=to.is_bag)
        if spec.revise:
            one = one.withColumn("_statement", revise_sql(to, kinds_of(src.schema), spec.dialect, spec.match_full_row))
        back = {new: old for new, old in spec.router.reverse().columns.get((to.schema, to.table), {}).items() if new in src.columns}
        named = spec.source_meta(m, to, back)
        one = check.under_names(one, to, back)
        target = (to.schema, to.table) if (to.schema, to.table) != (m.schema, m.table) else None
        line = F.when(F.col("kind").isin("miss", "diff"), check.log_lines(one, named, target, spec.full_rows))
        columns = [F.lit(m.schema).alias("schema"), F.lit(m.table).alias("tb"), "kind", line.alias("line")]
        if spec.revise:
            columns.append(F.col("_statement").alias("statement"))
        rows = one.select(*columns)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no table takes part")
    return found
