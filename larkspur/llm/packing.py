"""Best-fit packing of tokenized documents into sequences, planned over a histogram of lengths."""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, partitions
from .textkernel import Words, slices

SEQUENCE = 4096
END_ID = 1
KNOWN_WORDS = 500_000
PIECES = T.StructType().add("piece", T.IntegerType()).add("start", T.LongType()).add("length", T.LongType()).add("ids_crc32", T.LongType())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _worker_cache() -> dict:
    """A place that outlives a task in a reused worker."""
    return vars(sys.modules.setdefault("_larkspur_worker", types.ModuleType("_larkspur_worker")))


class WordTokens:
    """Token ids of words, each distinct word tokenized once.

    The tokenizer splits at white space before anything else looks at the text, so the ids of
    a text are those of its words in order.  It lower-cases, and splits letters and digits from what
    follows; so A-Z is lower-cased here already, and a word's last mark is a unit of its own, which leaves
    fewer distinct ones.
    """

    @staticmethod
    def units(column: pa.Array) -> Words:
        words = Words(column, lower=True)
        if b"<|" in words.data.tobytes():  # special tokens are found in the text as it is
            return Words(column, lower=False)
        code = np.arange(256)
        words.split_tails(np.isin(code, list(b".,;:!?")), (code < 128) & np.isin(code, list(b"abcdefghijklmnopqrstuvwxyz0123456789")))
        return words

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts)."""
        h, index, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        fresh = ~np.isin(h, self.known, assume_unique=True)
        if fresh.any():
            texts = words.texts(index[fresh])
            ends = np.cumsum([len(t) + 1 for t in texts])
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            of = np.searchsorted(ends, np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids)), "right")
            size = np.bincount(of, minlength=len(texts))
            at = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, np.array(found.ids, np.uint32)])
            order = np.argsort(known := np.concatenate([self.known, h[fresh]]))
            self.known, self.at, self.size = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        k = np.searchsorted(self.known, h)[inverse]
        size = self.size[k]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.at[k] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[words.first]


def tokenized_pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """docs without text, a row for each piece, with the columns of PIECES; a null text is an empty one."""
    path = path or tokenizer_path()
    rest = [c for c in docs.columns if c != "text" and c not in PIECES.names]
    schema = T.StructType([docs.schema[c] for c in rest] + PIECES.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _worker_cache()
        tokens = cache.get(path) or cache.setdefault(path, WordTokens(path))
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = tokens.ids(tokens.units(part.column(part.schema.get_field_index("text"))))
                row, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), sequence)):
                        x = own[s : s + sequence]
                        row.append(i), piece.append(k), start.append(s), length.append(len(x)), crc.append(zlib.crc32(x))
                kept = part.select(rest).take(pa.array(row, pa.int64()))
                new = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*rest, *PIECES.names])

    return docs.select(*rest, "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, number, first sequence, offset) of runs of pieces.

    Pieces of a length go, longest first, to the fullest sequences that still hold them.
    Sequences with as much room stand together as intervals of sequence numbers, so a step
    moves an interval, and the work depends on the number of lengths, not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    free = np.zeros(sequence + 1, bool)
    runs, made = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                # New sequences take as many pieces of this length as they hold, a layer at a time.
                each = max(1, sequence // length)
                whole = left // each
                if whole:
                    for k in range(each):
                        runs.append((length, rank, whole, made, k * length))
                        rank += whole
                    _give(room, free, sequence - each * length, made, whole)
                    made, left = made + whole, left - whole * each
                if left:
                    for k in range(left):
                        runs.append((length, rank + k, 1, made, k * length))
                    _give(room, free, sequence - left * length, made, 1)
                    made, left = made + 1, 0
                break
            r = int(fits[0]) + length
            first, n = room[r].pop()
            use = min(n, left)
            runs.append((length, rank, use, first, sequence - r))
            if use < n:
                room[r].append((first + use, n - use))
            if not room[r]:
                free[r] = False
            _give(room, free, r - length, first, use)
            rank, left = rank + use, left - use
    return runs


def _give(room: dict[int, list[tuple[int, int]]], free: np.ndarray, r: int, first: int, n: int) -> None:
    if r:
        stack = room.setdefault(r, [])
        if stack and stack[-1][0] + stack[-1][1] == first:
            stack[-1] = (stack[-1][0], stack[-1][1] + n)
        else:
            stack.append((first, n))
        free[r] = True


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all docs with sequence_id (from 0) and offset, packed by best fit.

    docs needs doc_id and text; other columns are kept, but for those named like a result column,
    which are replaced.  Pieces of a length are ranked by counts for each (length, block) and
    places in it; a length that most documents share is split over the blocks.

    Defined cases: a null or empty text is a piece of the end id alone; a very long text is tokenized whole, in a slice of its own, and
    cut into pieces; a slice that holds "<|", which may begin a special token, is tokenized without lower-casing it first, to the same ids; equal rows are packed
    each by itself; null doc_ids are packed like others; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.drop("sequence_id", "offset")
    blocks = max(64, partitions(spark))
    pieces = tokenized_pieces(docs, path, sequence, end_id)
    pieces = cut(pieces.withColumn("__block", F.pmod(F.xxhash64("doc_id", "ids_crc32", "start"), F.lit(blocks)).cast("int")))
    cells = pieces.groupBy("length", "__block").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `sequence` rows
    runs = plan(histogram, sequence)
    schema = "length long, r_first long, r_n long, r_sequence long, r_offset long"
    # At most a few runs for each pair of a length and a room: bounded by the sequence length, whatever the data.
    planned = spark.createDataFrame(runs, schema) if runs else spark.createDataFrame([], schema)
    by_length = Window.partitionBy("length").orderBy("__block")
    starts = cells.withColumn("__before", F.sum("n").over(by_length) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "__block").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("__inside", inside).join(starts, ["length", "__block"]).withColumn("__rank", F.col("__before") + F.col("__inside"))
    there = (ranked["length"] == planned["length"]) & (F.col("__rank") >= F.col("r_first")) & (F.col("__rank") < F.col("r_first") + F.col("r_n"))
    placed = ranked.join(F.broadcast(planned), there).drop(planned["length"])
    return (
        placed.withColumn("sequence_id", F.col("r_sequence") + F.col("__rank") - F.col("r_first"))
        .withColumn("offset", F.col("r_offset"))
        .drop("__block", "__inside", "__before", "__rank", "r_first", "r_n", "r_sequence", "r_offset")
    )
