"""Mixing sources to target weights by weighted fair queueing, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, partitions, unit_hash

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: A table of so many sources is broadcast; beyond, rows and sources are joined by a salted shuffle.
FEW_SOURCES = 20_000
SALTS = 32


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: source_size, n_rows, target.

    Sources by code point, null last, weigh weights[0], weights[1], ... repeating, and share
    the sum of all sizes.  A target stops at max_repeats times its source's size; the excess
    is shared again by weight until none is above.  With caps ordered by cap / weight, a
    source is capped if the share that remains when it comes up exceeds its cap: two running
    sums over the sources (not the rows) settle every round of re-sharing at once.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(kinds, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    per = per.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("budget", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rate", F.col("left") / F.col("weights_left"))
        .withColumn("capped", F.col("cap") <= F.col("rate") * F.col("weight"))
    )
    # The first source that isn't capped sets the rate of all later ones.
    rate = F.first(F.when(~F.col("capped"), F.col("rate")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), rate * F.col("weight")))
    per = per.withColumn("target", target).withColumn("src", F.row_number().over(by_name).cast("long"))
    return per.select("source", "src", "source_size", "n_rows", "target", "budget")


def _with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows with their source's columns: a broadcast if the sources are few, else a join dealt over SALTS parts of each source."""
    t = targets.withColumnRenamed("source", "t_source").drop("budget")
    same = F.col("source").eqNullSafe(F.col("t_source"))
    if targets.count() <= FEW_SOURCES:
        return rows.join(F.broadcast(t), same).drop("t_source")
    t = t.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS)).cast("int"))
    return salted.join(t, same & (F.col("salt") == F.col("t_salt"))).drop("t_source", "t_salt", "salt")


def _truncated(turns: DataFrame, budget: float) -> DataFrame:
    """The turns (row, size, finish, turn) that the budget lasts for, in order of finish time.

    They are sorted by ranges of the whole order.  Sums of the parts, as many as there are partitions, show which parts
    are in as a whole and which one the budget ends in; only that one is summed up row by row.
    """
    order = ["finish", "row", "turn"]
    ranged = cut(turns.repartitionByRange(partitions(turns.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("size").alias("words"), F.min("finish").alias("first"))
    before = Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    met = ranged.join(F.broadcast(sums.where(F.col("before") <= budget)), "part")
    whole = F.col("before") + F.col("words") <= budget
    so_far = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    edge = met.where(~whole).withColumn("so_far", F.col("before") + so_far).where(F.col("so_far") <= budget)
    return met.where(whole).select(*order).unionByName(edge.select(*order))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = 17,
    size: Column | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, n_taken int, taken long, tie), one row for each row of docs; tie is a hash of the text.

    Each source's documents are shuffled by a hash and stand in line up to max_repeats times.
    A document's virtual finish time is its source's running size divided by the source's
    target, so time 1 is where a source has its target.  All lines are merged in order of
    finish time, sorted by ranges, and cut where the sum of all sizes (the budget) is spent.  Documents are
    taken whole; the first that goes beyond the budget and all after it aren't taken.

    Beyond time 1 only the document at which a source passes its target stands in line, so no
    source is further from its target than by one document, be others ever so long.

    Running sums are made in two levels: within buckets of a source's shuffled order, as many
    as the square root of its rows, and over the buckets; no task holds a source.

    Defined cases: a null text has size 0; documents of size 0 and sources of size 0 are taken
    0 words; very long texts count with all their words; equal rows stand at their own places in the line; other columns are not returned;
    an empty table gives an empty table.
    """
    spark = docs.sparkSession
    size = n_words(F.col("text")) if size is None else size
    rows = cut(docs.select("doc_id", "source", size.cast("long").alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")))
    targets = cut(source_targets(rows, weights, max_repeats))
    line = (
        _with_targets(rows, targets)
        .withColumn("place", unit_hash(F.lit(seed), F.col("doc_id"), F.col("tie")))
        .withColumn("n_buckets", F.ceil(F.sqrt("n_rows")))
        .withColumn("bucket", F.floor(F.col("place") * F.col("n_buckets")))
    )
    starts = (
        line.groupBy("src", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("start", F.sum("words").over(Window.partitionBy("src").orderBy("bucket")) - F.col("words"))
        .select("src", "bucket", "start")
    )
    inside = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("place", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, 0))
    line = cut(
        line.withColumn("inside", inside)
        .join(starts, ["src", "bucket"])
        .withColumn("upto", F.col("start") + F.col("inside"))
        .select("doc_id", "source", "size", "source_size", "target", "upto", "tie", F.monotonically_increasing_id().alias("row"))
    )
    goal = F.nullif(F.col("target"), F.lit(0.0))
    turns = (
        line.where(F.col("size") > 0)
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .select("row", "size", "turn", ((F.col("turn") * F.col("source_size") + F.col("upto")) / goal).alias("finish"), (F.col("size") / goal).alias("lasts"))
        .where(F.col("finish") - F.col("lasts") < 1.0 - 1e-12)
    )
    budget = targets.agg(F.max("budget")).first()[0] or 0.0
    taken = _truncated(turns, budget).groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("n_taken"))
    times = F.coalesce("n_taken", F.lit(0))
    out = line.join(taken, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("n_taken"), (times * F.col("size")).cast("long").alias("taken"), "tie")
