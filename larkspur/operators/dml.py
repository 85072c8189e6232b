"""Data modification as transformations: each takes a table and gives the new table, or the rows it touched.

Right-hand sides see the old row.  Nothing is written; `sources.tables.replace` makes a result durable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import as_column
from .checkpoints import cut  # noqa: F401
from .constraints import Constraints


def _expressions(assignments: Mapping[str, Column | object]) -> dict[str, Column]:
    return {k: as_column(v) for k, v in assignments.items()}


def insert(table: DataFrame, rows: DataFrame, columns: Sequence[str] | None = None, defaults: Mapping[str, Column | object] | None = None) -> DataFrame:
    """table with rows, by position onto columns (all by default); the others get their default or NULL."""
    columns = list(columns or table.columns)
    if len(rows.columns) != len(columns):
        raise ValueError(f"INSERT has {len(rows.columns)} expressions but {len(columns)} target columns")
    given = rows.toDF(*columns)
    filled = _expressions(defaults or {})
    full = given.select(*[(F.col(f.name) if f.name in columns else filled.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    return table.unionByName(full)


def update(table: DataFrame, assignments: Mapping[str, Column | object], where: Column | None = None) -> DataFrame:
    """Rows for which `where` is TRUE get the assignments; all of these see the old row."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    new = _expressions(assignments)
    missing = set(new) - set(table.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return table.select(*[F.when(hit, new[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in new else F.col(f.name) for f in table.schema.fields])


def updated_rows(table: DataFrame, assignments: Mapping[str, Column | object], where: Column | None = None) -> DataFrame:
    """UPDATE ... RETURNING *: the new versions of the rows touched."""
    return update(table if where is None else table.where(where), assignments)


def update_from(table: DataFrame, source: DataFrame, on: Sequence[str], assignments: Mapping[str, str]) -> DataFrame:
    """Rows with a partner in source (equal `on` columns) get the named source columns; the first partner by value if there are several."""
    keyed = source.groupBy(*on).agg(F.min(F.struct(*assignments.values())).alias("__new")).withColumn("__hit", F.lit(True))
    joined = table.join(keyed, list(on), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col("__new")[assignments[f.name]]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in assignments else F.col(f.name) for f in table.schema.fields])


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows for which `where` is FALSE or NULL stay."""
    return table.limit(0) if where is None else table.where(~F.coalesce(where, F.lit(False)))


def deleted_rows(table: DataFrame, where: Column | None = None) -> DataFrame:
    """DELETE ... RETURNING *."""
    return table if where is None else table.where(where)


def delete_using(table: DataFrame, source: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """Rows without a partner in source stay."""
    return table.join(source, on if isinstance(on, Column) else list(on), "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str], assignments: Mapping[str, Column | object] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (key): DO NOTHING without assignments, else DO UPDATE with them on the stored row.

    Assignments see stored columns by name and the proposed row as `excluded`, a struct.  Of proposed rows with the same
    key the least is taken; a NULL in the key conflicts with nothing.
    """
    names = table.columns
    no_null = F.lit(True)
    for k in key:
        no_null = no_null & F.col(k).isNotNull()
    proposed = rows.select(*names)
    one = proposed.where(no_null).groupBy(*key).agg(F.min(F.struct(*names)).alias("excluded"))
    new = one.join(table.select(*key).distinct(), list(key), "left_anti").select("excluded.*").unionByName(proposed.where(~no_null))
    if not assignments:
        return table.unionByName(new)
    joined = table.join(one, list(key), "left")
    exprs = _expressions(assignments)
    hit = F.col("excluded").isNotNull()
    changed = joined.select(*[F.when(hit, exprs[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in exprs else F.col(f.name) for f in table.schema.fields])
    return changed.unionByName(new)


def checked(table: DataFrame, constraints: Constraints) -> DataFrame:
    """The table, after a check that it breaks no constraint (a job for each kind)."""
    constraints.enforce(table)
    return table


def delete_cascade(parent: DataFrame, where: Column, children: Mapping[str, tuple[DataFrame, str, str]], parent_key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Delete from parent and act on children: name -> (table, foreign key column, "cascade", "set null" or "restrict")."""
    gone = parent.where(where).select(F.col(parent_key).alias("__gone")).distinct()
    out = {}
    for name, (child, column, action) in children.items():
        met = child[column] == gone["__gone"]
        if action == "restrict":
            if not child.join(gone, met, "left_semi").isEmpty():
                raise ValueError(f"update or delete on the parent violates foreign key {column} of {name}")
            out[name] = child
        elif action == "cascade":
            out[name] = child.join(gone, met, "left_anti")
        elif action == "set null":
            out[name] = child.join(gone, met, "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column))).select(*child.columns)
        else:
            raise ValueError(f"unknown action {action}")
    return delete(parent, where), out
