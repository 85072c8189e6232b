"""Sessions, table registration and runtime settings."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Settings of the SQL dialect; all are runtime settings of a session.
DIALECT = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.adaptive.enabled": "true",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(text: str) -> list[str]:
    """The tables that a statement names."""
    words = set(re.findall(r"[a-z]+", text.lower()))
    return [t for t in TABLES if t in words]


def register(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> None:
    """A temporary view for each table; nothing is read before a query needs it."""
    for name in names:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


_NOT_IN = re.compile(r"\bWHERE (\w+) NOT IN \(SELECT ([^()]*(?:\([^()]*\)[^()]*)*) FROM (\w+)\)(?=\s*(?:$|\)|AND |GROUP |ORDER ))")


def spread_not_in(text: str) -> str:
    """WHERE x NOT IN (SELECT y FROM t) as the three conditions it stands for: no y equals x, no y is null, and x isn't unless t is empty.

    Spark sends all y to the driver and to every executor for a null-aware anti join; an anti join by equality is dealt over tasks.
    """

    def conditions(m: re.Match) -> str:
        x, y, t = m.groups()
        own = f"SELECT 1 FROM (SELECT {y} AS __y FROM {t})"
        return f"WHERE (NOT EXISTS ({own} WHERE __y = {x}) AND NOT EXISTS ({own} WHERE __y IS NULL) AND ({x} IS NOT NULL OR NOT EXISTS (SELECT 1 FROM {t})))"

    return _NOT_IN.sub(conditions, text)


def configure(spark: SparkSession) -> SparkSession:
    for key, value in DIALECT.items():
        spark.conf.set(key, value)
    return spark
