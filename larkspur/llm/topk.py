"""Exact top-k search by inner product: term-at-a-time accumulation over blocks of queries and candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut_table

K = 10
SCALE = 1024
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
_BLOCKS = "ids binary, terms binary, n int, dim int"


def blocks(vectors: DataFrame, size: int, scale: int = SCALE) -> DataFrame:
    """Blocks of at most `size` vectors: ids, and terms as a matrix of longs floor(scale * x), with a row for each dimension.

    Vectors that are null, or hold a null or a component that isn't finite, or have no id, take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            dim = max(map(len, rows))
            terms = np.zeros((dim, len(rows)), np.int64)
            for j, x in enumerate(rows):
                terms[: len(x), j] = x
            out = [np.array(ids, np.int64).tobytes()], [terms.tobytes()], [len(ids)], [dim]
            ids.clear(), rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["ids", "terms", "n", "dim"])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(v).all():
                    ids.append(i)
                    rows.append(np.floor(v * scale).astype(np.int64))
                    if len(ids) == size:
                        yield block()
        if ids:
            yield block()

    return vectors.select("vec_id", "embedding").mapInArrow(run, _BLOCKS)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, ties to the smaller id: a partition selects, only the selected are sorted."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above, equal = np.flatnonzero(score > least), np.flatnonzero(score == least)
        if len(equal) > k - len(above):
            equal = equal[np.argpartition(ids[equal], k - len(above) - 1)[: k - len(above)]]
        at = np.concatenate([above, equal])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k best of all other vectors, ties to the smaller vec_id.

    Every block of queries meets every block of candidates once: both are written as tables, of which tasks
    read a part each (a Cartesian product of their partitions), so neither is broadcast nor copied in a shuffle.
    For each term (dimension) the
    queries that hold it scatter their weight times the term's postings into dense score arrays;
    k rows of each query leave a block, and a window with a group limit merges them.

    Defined cases: equal scores go to the smaller vec_id; very long vectors are matrices with as many rows, a block at a time; vectors of unlike lengths miss the terms that they lack; a candidate with the query's id
    isn't its neighbour; candidates that repeat an id stand as often as they occur; queries that repeat an
    id are one query, with the least of their vectors; fewer than k others give fewer rows;
    other columns are not returned; empty tables give an empty result.
    """
    bound_batches(vectors.sparkSession)
    queries = cut_table(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    few = max(1, -(-queries.count() // query_block))  # partitions that are enough for full blocks
    asked = cut_table(blocks(queries.coalesce(few), query_block, scale)).toDF("q_ids", "q_terms", "q_n", "q_dim")
    dealt = cut_table(blocks(vectors, candidate_block, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                postings = np.frombuffer(r["terms"], np.int64).reshape(r["dim"], r["n"])
                weights = np.frombuffer(r["q_terms"], np.int64).reshape(r["q_dim"], r["q_n"])
                score = np.zeros((len(q_ids), len(ids)), np.int64)
                for term in range(min(r["dim"], r["q_dim"])):
                    holds = np.flatnonzero(weights[term])
                    at = slice(None) if len(holds) == len(q_ids) else holds
                    score[at] += weights[term][holds][:, None] * postings[term]
                out: list[np.ndarray] = []
                for q, own in enumerate(q_ids):
                    other = np.flatnonzero(ids != own) if (ids == own).any() else None
                    s, c = (score[q], ids) if other is None else (score[q][other], ids[other])
                    at = _best(c, s, k)
                    out.append(np.stack([np.full(len(at), own), c[at], s[at]]))
                flat = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["query_id", "vec_id", "score"])

    met = dealt.join(asked.hint("shuffle_replicate_nl")).select("ids", "terms", "n", "dim", "q_ids", "q_terms", "q_n", "q_dim")
    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
