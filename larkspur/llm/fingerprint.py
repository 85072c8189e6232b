"""Document fingerprints by consistent weighted sampling, with built-in functions only.

For each of SAMPLES draws a word of weight w (its count) gets, from hashes of the word and the
draw alone, r and c of Gamma(2, 1) and beta of Uniform(0, 1), and

    t = floor(ln w / r + beta),    ln a = ln c - r * (t - beta + 1).

The word with the least ln a, with its t, is the draw's sample.  Two texts have the same sample
with a probability of sum(min(w, w')) / sum(max(w, w')), their generalised Jaccard similarity.
As ln a depends on nothing but the word, the draw and t, the least value itself names the sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, WHITE_CLASS, partitions

SAMPLES = 48
#: Draws that one pass over the words makes at once: generated code beyond some size isn't compiled.
DRAWS = 8
_UNIT = float(1 << 21)


def _uniform(h: Column, shift: int) -> Column:
    """21 bits of h as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5) / _UNIT


def draw_values(word: Column, draw: Column) -> tuple[Column, Column, Column]:
    """(r, ln c, beta) of a word in a draw."""
    one = F.xxhash64(word, draw)
    two = F.xxhash64(one)
    return -F.ln(_uniform(one, 0) * _uniform(one, 21)), F.ln(-F.ln(_uniform(one, 42) * _uniform(two, 0))), _uniform(two, 21)


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_CLASS + "+"))


def fingerprints(rows: DataFrame, keys: Sequence[str], texts: Sequence[str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each column in texts, its samples as array<int> of 16 bits each (-1: no words) under the column's name.

    keys name a row.  If rows are dealt by some of the keys already, nothing is shuffled.  Words stay as they
    are, but for white space (\\x20, \\x09-\\x0D).  A null text counts as empty.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), F.coalesce(t, F.lit("")).alias("text")) for i, t in enumerate(texts)]))
    split = rows.select(*keys, each.alias("__t")).select(*keys, F.col("__t.of").alias("__of"), F.explode_outer(words(F.col("__t.text"))).alias("__w"))
    split = split.select(*keys, "__of", F.when(F.col("__w").isNotNull(), F.xxhash64("__w")).alias("__word"))
    counted = split.groupBy(*keys, "__word").agg(*[F.count(F.when((F.col("__of") == i) & F.col("__word").isNotNull(), 1)).alias(f"__n{i}") for i in range(len(texts))])
    passes = counted.select(*keys, "__word", *[F.ln(f"__n{i}").alias(f"__n{i}") for i in range(len(texts))], F.explode(F.array(*[F.lit(i) for i in range(0, samples, DRAWS)])).alias("__pass"))
    # The values of a draw are columns of their own, so that each is computed once for all texts; ln 0 is null, and so is what follows.
    drawn = [x.alias(f"__{n}_{j}") for j in range(DRAWS) for n, x in zip("rcb", draw_values(F.col("__word"), F.col("__pass") + j))]
    drawn = passes.select(*keys, "__pass", *[f"__n{i}" for i in range(len(texts))], *drawn)
    value = lambda i, j: F.col(f"__c_{j}") - F.col(f"__r_{j}") * (F.floor(F.col(f"__n{i}") / F.col(f"__r_{j}") + F.col(f"__b_{j}")) - F.col(f"__b_{j}") + 1.0)
    found = drawn.groupBy(*keys, "__pass").agg(*[F.min(value(i, j)).alias(f"__a{i}_{j}") for j in range(DRAWS) for i in range(len(texts))])
    bits = lambda a: F.coalesce(F.xxhash64(a).bitwiseAND(F.lit(0xFFFF)).cast("int"), F.lit(-1))
    own = lambda i: F.array(*[F.when(F.col(f"__a{i}_{j}").isNotNull(), bits(F.col(f"__a{i}_{j}"))).otherwise(F.lit(-1)) for j in range(DRAWS)])
    parts = found.select(*keys, F.struct("__pass", *[own(i).alias(f"s{i}") for i in range(len(texts))]).alias("__s"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("__s")).alias("__s"))
    taken = lambda i: lambda s: s[f"s{i}"]
    return whole.select(*keys, *[F.flatten(F.transform("__s", taken(i))).alias(t) for i, t in enumerate(texts)])


def likeness(a: Column, b: Column) -> Column:
    """Share of samples that agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("double") / F.size(a)


def as_text(samples: Column) -> Column:
    """Four hexadecimal digits a sample, "----" where a text has no words."""
    return F.array_join(F.transform(samples, lambda x: F.when(x < 0, F.lit("----")).otherwise(F.lower(F.lpad(F.hex(x), 4, "0")))), "")


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, text and fingerprint, a row for each distinct pair of doc_id and text; equal texts have equal fingerprints."""
    keyed = docs.select("doc_id", "text").distinct().withColumn("__key", F.struct(F.col("doc_id"), F.col("text")))
    found = fingerprints(keyed.select("__key", F.col("text").alias("samples")), ["__key"], ["samples"], samples)
    return found.select("__key.doc_id", "__key.text", as_text(F.col("samples")).alias("fingerprint"))


def _bounds(key_rows: DataFrame, n: int) -> list[int]:
    """About n keys, among them the greatest, that cut the rows in even parts; n doesn't depend on the data."""
    at = F.array(*[F.lit((i + 1) / n) for i in range(n)])
    r = key_rows.agg(F.percentile_approx("key", at, 20 * n + 1000).alias("q"), F.max("key").alias("top")).first()
    return sorted({*(r["q"] or []), *([] if r["top"] is None else [r["top"]])})


def _part_of(key: Column, bounds: Sequence[int]) -> Column:
    """Number of bounds below key, found in two steps of about the square root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    heads = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    groups = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    group = F.size(F.filter(heads, lambda b: b < key))
    return group * step + F.size(F.filter(F.coalesce(F.get(groups, group), F.array().cast("array<bigint>")), lambda b: b < key))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of all texts and of their edited texts: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all,
    of the next document by descending doc_id (the last document's next is the first).  near_edited and near_next
    are the likeness of a text's fingerprint to the edited text's and to the next document's.

    Texts are shuffled once, by ranges of doc_id; the first document of a range is also sent to the range above,
    whose last document it follows.  All that comes after stays in these partitions.

    Defined cases: a null text is empty; very long texts are sampled whole, their words being rows; equal rows (same doc_id and text) follow each other in
    any order, which changes no result; two texts without words are alike (1), and unlike any with words (0);
    rows with the same doc_id are ordered by text; null doc_ids come last; other columns are not returned;
    an empty table gives an empty table.
    """
    spark = docs.sparkSession
    parts = 2 * partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    bounds = _bounds(rows.select("key"), 8 * parts) or [0]
    part = _part_of(F.col("key"), bounds)
    follows = F.get(F.array(*[F.lit(b) for b in bounds]), part) == F.col("key")
    dealt = rows.select("*", F.posexplode(F.when(follows, F.array(part, (part + 1) % len(bounds))).otherwise(F.array(part))).alias("guest", "part")).repartition(parts, "part")
    order = Window.partitionBy("part").orderBy("guest", F.col("key").desc(), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    lined = dealt.withColumn("place", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    lined = lined.withColumn("edited", F.when(F.col("guest") == 0, F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))).otherwise(F.lit("")))
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    keys = ["part", "place", "guest", "doc_id", "n_chars", *[f"sha{i}" for i in range(4)]]
    keyed = lined.select(
        "part", "place", "guest", "doc_id", n.cast("long").alias("n_chars"),
        *[F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)], "text", "edited",
    )
    found = fingerprints(keyed, keys, ["text", "edited"], samples)
    found = found.withColumn("next", F.lead("text").over(Window.partitionBy("part").orderBy("place"))).where("guest = 0")
    hexed = F.lower(F.concat(*[F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)]))
    return found.select(
        "doc_id", "n_chars", hexed.alias("edited_sha256"), as_text(F.col("text")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("next")).alias("near_next"),
    )
