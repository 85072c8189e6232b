"""A corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but
the last return the columns of documents.  Null, empty and repeated rows have the defined cases of the
operators that the stages call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import lang_id, line_dedup, mixing, packing
from larkspur.llm.common import cut_table
from larkspur.llm.jaccard_join import components, jaccard_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its language is told with this probability or more.
SURE = 0.5
#: Shingles and similarity of the near-duplicate stage.
WORDS, SHARE = 5, (80, 100)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language can't be told, go."""
    told = lang_id.detect(docs.select(*COLUMNS))
    return told.where((F.col("lang_pred") != lang_id.UNDETERMINED) & (F.col("score") >= SURE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one with the smallest doc_id stays, rows without a doc_id counting as the last."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        first = jaccard_components(docs, WORDS, SHARE).where("doc_id = component_id").select("doc_id").distinct()
        return docs.join(first, "doc_id", "left_semi").select(*COLUMNS)
    # Rows are told apart by a number; those of one document are linked, whatever their texts, and those without a doc_id to an equal text.
    rows = cut_table(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()))
    found = jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text"), WORDS, SHARE).select(F.col("doc_id").alias("y"), F.col("component_id").alias("x"))
    least = lambda c: F.min("__row").over(Window.partitionBy(c)).alias("x")
    same = [rows.select(F.col("__row").alias("y"), least(c), "doc_id").where(which).select("y", "x") for c, which in (("doc_id", "doc_id is not null"), ("text", "doc_id is null"))]
    groups = components(found.unionByName(same[0]).unionByName(same[1]))
    stays = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row")))["__row"]
    first = rows.join(groups, rows["__row"] == groups["node"]).groupBy("comp").agg(stays.alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    docs = docs.select(*COLUMNS).withColumn("__tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    taken = mixing.mix(docs).where("n_taken > 0").groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__t")).agg(F.sum("n_taken").alias("__n"), F.count(F.lit(1)).alias("__rows"))
    # Rows that repeat a document share what was taken of them.
    times = F.ceil(F.col("__n") / F.col("__rows")).cast("int")
    met = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__t")))
    return met.withColumn("__times", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its sequence and its place there."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_languages),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Language ID learns by expectation maximisation, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_table(stage(spark, docs, sf_dir))
    return docs
