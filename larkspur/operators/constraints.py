"""Constraints as validation queries: each kind gives the rows that break it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintViolation(Exception):
    """A broken constraint with its SQLSTATE."""

    def __init__(self, sqlstate: str, message: str):
        super().__init__(message)
        self.sqlstate = sqlstate

    def getSqlState(self) -> str:  # noqa: N802  as PySpark's own exceptions have it
        return self.sqlstate


@dataclass
class Constraints:
    """not_null: columns.  unique: column tuples (NULLs never collide).  checks: conditions that no row may make FALSE.
    foreign: (columns, parent table, parent's columns); rows with a NULL in columns are free."""

    not_null: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    checks: dict[str, Column] = field(default_factory=dict)
    foreign: Sequence[tuple[Sequence[str], DataFrame, Sequence[str]]] = ()

    def null_rows(self, table: DataFrame, column: str) -> DataFrame:
        return table.where(F.col(column).isNull())

    def repeated_keys(self, table: DataFrame, key: Sequence[str]) -> DataFrame:
        return table.dropna(subset=list(key)).groupBy(*key).count().where("count > 1")

    def failing_rows(self, table: DataFrame, check: Column) -> DataFrame:
        return table.where(~check)

    def orphans(self, table: DataFrame, columns: Sequence[str], parent: DataFrame, key: Sequence[str]) -> DataFrame:
        parents = parent.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(key)])
        met = [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)]
        return table.dropna(subset=list(columns)).join(parents, met, "left_anti")

    def enforce(self, table: DataFrame) -> None:
        for c in self.not_null:
            if not self.null_rows(table, c).isEmpty():
                raise ConstraintViolation("23502", f"null value in column {c} violates not-null constraint")
        for name, check in self.checks.items():
            if not self.failing_rows(table, check).isEmpty():
                raise ConstraintViolation("23514", f"new row violates check constraint {name}")
        for key in self.unique:
            if not self.repeated_keys(table, key).isEmpty():
                raise ConstraintViolation("23505", f"duplicate key value violates unique constraint on ({', '.join(key)})")
        for columns, parent, key in self.foreign:
            if not self.orphans(table, columns, parent, key).isEmpty():
                raise ConstraintViolation("23503", f"insert or update violates foreign key constraint on ({', '.join(columns)})")
