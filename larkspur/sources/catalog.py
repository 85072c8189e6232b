"""Views of information_schema (tables, columns, schemata and those of constraints) and pg_catalog (pg_tables, pg_class,
pg_namespace, pg_attribute, pg_type) as DataFrames over the session's catalog; other views are left out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .tables import META

_KINDS = {"bigint": "bigint", "int": "integer", "double": "double precision", "string": "text", "boolean": "boolean", "timestamp_ntz": "timestamp without time zone", "timestamp": "timestamp with time zone", "date": "date", "binary": "bytea"}


def kind_name(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return kind_name(spark_type[6:-1]) + "[]"
    return spark_type.replace("decimal", "numeric") if spark_type.startswith("decimal") else _KINDS.get(spark_type, spark_type)


def tables(spark: SparkSession) -> DataFrame:
    rows = [(t.catalog or "spark_catalog", (t.namespace or ["public"])[0], t.name, "LOCAL TEMPORARY" if t.isTemporary else "VIEW" if t.tableType == "VIEW" else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def columns(spark: SparkSession) -> DataFrame:
    rows = []
    for t in spark.catalog.listTables():
        for i, c in enumerate(spark.catalog.listColumns(t.name)):
            rows.append(((t.namespace or ["public"])[0], t.name, c.name, i + 1, "YES" if c.nullable else "NO", kind_name(c.dataType)))
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def schemata(spark: SparkSession) -> DataFrame:
    rows = [(d.catalog or "spark_catalog", d.name) for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(rows, "catalog_name string, schema_name string")


def _declared(spark: SparkSession) -> list[tuple[str, dict]]:
    """(table, what it declares) of all saved tables."""
    out = []
    for t in spark.catalog.listTables():
        if not t.isTemporary and t.tableType != "VIEW":
            found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {t.name}").collect()}
            if META in found:
                out.append((t.name, json.loads(found[META])))
    return out


def _keys(spark: SparkSession) -> list[tuple[str, str, str, list[str]]]:
    """(constraint, table, type, columns) of all keys and checks."""
    out = []
    for name, meta in _declared(spark):
        if meta["primary"]:
            out.append((f"{name}_pkey", name, "PRIMARY KEY", meta["primary"]))
        out += [(f"{name}_{'_'.join(u)}_key", name, "UNIQUE", u) for u in meta["unique"]]
        out += [(f"{name}_{f['name']}", name, "FOREIGN KEY", f["columns"]) for f in meta["foreign"]]
        out += [(f"{name}_{c}", name, "CHECK", []) for c in meta["checks"]]
    return out


def table_constraints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("default", *k[:3]) for k in _keys(spark)], "constraint_schema string, constraint_name string, table_name string, constraint_type string")


def key_column_usage(spark: SparkSession) -> DataFrame:
    rows = [(n, t, c, i + 1) for n, t, _, columns in _keys(spark) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "constraint_name string, table_name string, column_name string, ordinal_position int")


def referential_constraints(spark: SparkSession) -> DataFrame:
    rule = {"restrict": "NO ACTION"}
    rows = [(f"{t}_{f['name']}", f"{f['parent']}_pkey", rule.get(f["update"], f["update"].upper()), rule.get(f["delete"], f["delete"].upper())) for t, m in _declared(spark) for f in m["foreign"]]
    return spark.createDataFrame(rows, "constraint_name string, unique_constraint_name string, update_rule string, delete_rule string")


def _number(spark: SparkSession) -> dict[str, int]:
    """A number of its own for each table."""
    return {t.name: 16384 + i for i, t in enumerate(sorted(spark.catalog.listTables(), key=lambda t: t.name))}


def pg_tables(spark: SparkSession) -> DataFrame:
    rows = [((t.namespace or ["public"])[0], t.name) for t in spark.catalog.listTables() if t.tableType != "VIEW" and not t.isTemporary]
    return spark.createDataFrame(rows, "schemaname string, tablename string")


def pg_namespace(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(2200 + i, d.name) for i, d in enumerate(spark.catalog.listDatabases())], "oid int, nspname string")


def pg_class(spark: SparkSession) -> DataFrame:
    spaces = {d.name: 2200 + i for i, d in enumerate(spark.catalog.listDatabases())}
    oid = _number(spark)
    rows = [(oid[t.name], t.name, spaces.get((t.namespace or [""])[0]), "v" if t.isTemporary or t.tableType == "VIEW" else "r") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "oid int, relname string, relnamespace int, relkind string")


def pg_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(sorted({kind_name(k) for k in _KINDS}), 16)), "oid int, typname string")


def pg_attribute(spark: SparkSession) -> DataFrame:
    types = {r["typname"]: r["oid"] for r in pg_type(spark).collect()}
    oid = _number(spark)
    rows = [(oid[t.name], c.name, types.get(kind_name(c.dataType)), i + 1, not c.nullable) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "attrelid int, attname string, atttypid int, attnum int, attnotnull boolean")


VIEWS = {f"information_schema_{f.__name__}": f for f in (tables, columns, schemata, table_constraints, key_column_usage, referential_constraints)} | {f.__name__: f for f in (pg_tables, pg_class, pg_namespace, pg_attribute, pg_type)}


def register(spark: SparkSession, names: list[str]) -> None:
    """Temporary views of the catalog as it is now; they don't list each other."""
    for name in VIEWS:
        spark.catalog.dropTempView(name)
    for name, rows in [(n, VIEWS[n](spark)) for n in names]:
        rows.createOrReplaceTempView(name)
