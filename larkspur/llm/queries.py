"""The registered queries of this subpackage; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import read_table
from . import katz
from .chat import format_conversations
from .fingerprint import edited_fingerprints
from .jaccard_join import jaccard_components
from .lang_id import detect
from .line_dedup import dedup_lines
from .mixing import mix
from .packing import pack
from .substring_dedup import repeated_passages
from .topk import search


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return detect(docs).select("doc_id", "held_out", "lang_pred", "score")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_conversations(spark, read_table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "call_id", "depth", "status", "valid", F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_passages", "n_words", "first_partner", "component_id", "partners")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op10_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_best_fit_packing, op3_topk_search, op4_language_id, op5_mix_sources, op6_chat_formatting, op7_line_dedup, op8_substring_dedup, op9_fingerprints, op10_katz_scoring)}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk_search": oracles.TOPK, "op6_chat_formatting": oracles.CHAT, "op7_line_dedup": oracles.LINE_DEDUP}
