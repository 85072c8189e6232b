"""Line dedup: lines that occur in many documents stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower

MIN_CHARS = 40
MIN_DOCS = 5
#: Parts into which the rows of one line are dealt for the join with the frequent lines.
SALTS = 32


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(occurrences, frequent): distinct (key, doc_id), and keys in at least min_docs documents with their largest doc_id.

    A document's repeats of a key are removed before the first shuffle, and both
    aggregations combine on the map side, so a key in every document costs one row
    for each map task.
    """
    keys = F.transform(F.split("text", "\n", -1), line_key)
    long_keys = F.transform(F.filter(keys, lambda k: F.length(k) >= min_chars), _digest)
    found = (
        docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select("doc_id", F.explode(F.array_distinct(long_keys)).alias("key"))
        .distinct()
    )
    frequent = found.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    return found, frequent


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with text cut, and with n_lines and n_dropped (longs); other columns stay as they are.

    A text is split at "\\n".  Keys (line_key) of min_chars code points or more that
    occur in min_docs documents or more lose all their lines, except in the largest
    doc_id holding them.  The positions of these lines are found by a hash join; the other lines are put together in order of position.

    Defined cases: a null or empty text is one empty line and stays as it is (null stays
    null); very long texts are split whole, a text and its lines being one row; rows that share a doc_id count as one document, and each is cut by its own
    lines; rows whose doc_id is null are never counted and lose nothing; input columns
    called n_lines or n_dropped are replaced; an empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_dropped")
    columns = docs.columns
    found, frequent = frequent_lines(docs, min_chars, min_docs)
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mark = F.xxhash64("text").alias("__mark")  # tells rows of a document apart
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    placed = usable.select("doc_id", mark, F.posexplode(F.transform(F.split("text", "\n", -1), line_key)).alias("pos", "key")).where(F.length("key") >= min_chars)
    gone = (
        placed.select("doc_id", "__mark", "pos", _digest(F.col("key")).alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(salted, ["key", "salt"])
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("__doc"), F.col("__mark").alias("__own"))
        .agg(F.collect_set("pos").alias("__gone"))
    )
    # Equal rows have equal marks, so each row meets its positions once.
    lined = docs.select(*[c for c in columns if c != "text"], mark, F.split("text", "\n", -1).alias("__lines"))
    joined = lined.join(gone, (F.col("doc_id") == F.col("__doc")) & (F.col("__mark") == F.col("__own")), "left")
    n = F.size("__lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("__gone", F.array().cast("array<int>")))
    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.transform(stay, lambda i: F.get("__lines", i)))
    return joined.select(
        *[F.when(F.col("__lines").isNotNull(), F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(c) for c in columns],
        F.when(F.col("__lines").isNull(), F.lit(1)).otherwise(n).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
