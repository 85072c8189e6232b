"""Durable tables over Parquet: writing a new version, then swapping it in."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The property that holds what a table declares, as JSON.
META = "larkspur.declared"


def create(spark: SparkSession, name: str, df: DataFrame, if_not_exists: bool = False) -> None:
    if if_not_exists and spark.catalog.tableExists(name):
        return
    df.write.format("parquet").saveAsTable(name)


def replace(spark: SparkSession, name: str, df: DataFrame, meta: dict | None = None) -> None:
    """df as the table's new content.  df may read the table: it is written beside it first, and the names are swapped then.
    meta: what the table declares, as `statements` keeps it."""
    new, old = f"{name}_{uuid.uuid4().hex[:8]}", f"{name}_{uuid.uuid4().hex[:8]}"
    df.write.format("parquet").saveAsTable(new)
    if meta:
        text = json.dumps(meta, sort_keys=True).replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {new} SET TBLPROPERTIES ('{META}' = '{text}')")
    spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    spark.sql(f"DROP TABLE {old}")


def add_column(df: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumn(name, F.lit(default).cast(kind))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def change_type(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, df[name].cast(kind))
