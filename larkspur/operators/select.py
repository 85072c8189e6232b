"""DataFrame operators whose defaults differ from Spark's, or that Spark's API lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(column: Column | str, descending: bool = False, nulls_first: bool = False) -> Column:
    """A sort key; NULLs come last both ways unless told otherwise."""
    c = F.col(column) if isinstance(column, str) else column
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def sort(df: DataFrame, *keys: Column | str | tuple) -> DataFrame:
    """keys are columns or (column, descending[, nulls_first])."""
    return df.orderBy(*[ordering(*k) if isinstance(k, tuple) else ordering(k) for k in keys])


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on all columns of the same name; a cross product if there is none."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)


def full_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, rows: int = 5_000_000) -> DataFrame:
    """FULL OUTER JOIN where left_key = right_key.  A key with more than about `rows` pairs is dealt over parts: each has some of its left rows and all of its right ones.

    Spark joins all rows of a key in one task, and all keys in one if they are few, however many pairs they make.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = left.withColumn("__key", left_key), right.withColumn("__key", right_key)
    held = [df.where("__key IS NOT NULL").groupBy("__key").agg(F.count("*").alias(c)) for df, c in ((a, "__a"), (b, "__b"))]
    parts = held[0].join(held[1], "__key").select("__key", F.least(F.ceil(F.col("__a") * F.col("__b") / F.lit(rows)), F.col("__a")).cast("int").alias("__parts")).where("__parts > 1")
    dealt = a.join(parts, "__key", "left").withColumn("__part", F.pmod(F.xxhash64(*[left[c] for c in left.columns]), F.coalesce("__parts", F.when(F.col("__key").isNull(), n), F.lit(1))).cast("int"))
    copied = b.where("__key IS NOT NULL").join(parts, "__key", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    dealt = dealt.repartition(n, "__key", "__part").select("__key", "__part", F.struct(*left.columns).alias("__left"))
    copied = copied.repartition(n, "__key", "__part").select("__key", "__part", F.struct(*right.columns).alias("__right"))
    out = [F.col(f"__left.{c}").alias(c) for c in left.columns], [F.col(f"__right.{c}").alias(c) for c in right.columns]
    found = dealt.join(copied, ["__key", "__part"], "left").select(*out[0], *out[1])
    alone = b.join(held[0].select("__key"), "__key", "left_anti")
    return found.unionByName(alone.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields], *right.columns))


def groups_frame(df: DataFrame, partition: Sequence[str], order: str, start: int, end: int, value: Column, name: str) -> DataFrame:
    """value over a GROUPS frame from start to end peer groups away: ranks of peers make it a RANGE frame."""
    numbered = df.withColumn("__peers", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    frame = Window.partitionBy(*partition).orderBy("__peers").rangeBetween(start, end)
    return numbered.withColumn(name, value.over(frame)).drop("__peers")


def recursive(base: DataFrame, step, limit: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION (distinct): rows that step(new rows) gives are added until it gives none that are new.

    Each round's rows are written to the checkpoint folder, so plans don't grow.  More than `limit` rounds are an error.
    """
    from .checkpoints import cut

    found = new = cut(base.distinct())
    for _ in range(limit):
        new = cut(step(new).toDF(*found.columns).subtract(found))
        if new.isEmpty():
            return found
        found = cut(found.unionByName(new))
    raise RecursionError(f"recursion went beyond {limit} rounds")

