"""Tables as the operators see them: columns, keys, and the columns that identify a row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TableMeta:
    """``unique`` lists the unique keys in the order of their declaration; Spark itself has no keys."""

    schema: str
    table: str
    columns: tuple[str, ...]
    primary: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    nullable: frozenset[str] = frozenset()
    #: (columns, schema, table) of each foreign key
    foreign: tuple[tuple[tuple[str, ...], str, str], ...] = ()

    @property
    def order_cols(self) -> tuple[str, ...]:
        """The key that orders and identifies rows; none for a keyless table.

        The primary key; else the shortest unique key without a nullable column; else the shortest unique key.
        """
        if self.primary:
            return self.primary
        strict = [k for k in self.unique if not self.nullable.intersection(k)]
        return min(strict or self.unique, key=len, default=())

    @property
    def id_cols(self) -> tuple[str, ...]:
        """The order columns, or every column if there is no key: then the table is a bag of rows."""
        return self.order_cols or self.columns

    @property
    def is_bag(self) -> bool:
        return not self.order_cols

    @property
    def partition_col(self) -> str:
        return self.id_cols[0]

    @property
    def keys(self) -> tuple[tuple[str, ...], ...]:
        return ((self.primary,) if self.primary else ()) + self.unique

    @property
    def key_cols(self) -> tuple[str, ...]:
        """Every column of any key, in the order of the table."""
        used = {c for k in self.keys for c in k}
        return tuple(c for c in self.columns if c in used)

    @property
    def value_cols(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in self.id_cols)


def table_meta(
    df: DataFrame,
    table: str,
    primary: Sequence[str] = (),
    unique: Iterable[Sequence[str]] = (),
    schema: str = "main",
    nullable: Iterable[str] | None = None,
) -> TableMeta:
    """The meta of a DataFrame; ``nullable`` defaults to what its schema says, without the primary key."""
    if nullable is None:
        nullable = [f.name for f in df.schema if f.nullable and f.name not in primary]
    return TableMeta(schema, table, tuple(df.columns), tuple(primary), tuple(tuple(k) for k in unique), frozenset(nullable))
