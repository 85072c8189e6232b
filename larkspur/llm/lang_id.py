"""Language ID by unigram models over the pieces of a public vocabulary, summed over all segmentations of the text.

No piece of the vocabulary spans white space, so a text's probability is the product
of its words' probabilities, and each distinct word is scored once for a slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut_table
from .textkernel import Words, powers, slices

UNDETERMINED = "und"
#: Bounds of the sample of labelled rows that the models are fitted on, for each language.
FIT_ROWS = 600
FIT_CHARS = 3_000_000
FIT_ROUNDS = 3
#: Code points of the pieces in which longer words are learnt.
FIT_UNIT = 40
#: Parts into which the sample's distinct units are dealt, units that a task takes at once, and chunks in which counts are added up.
FIT_PARTS, FIT_WORDS, CHUNKS = 16, 3_000, 32
#: Occurrences that the prior stands for.
PRIOR_COUNT = 200.0
UNKNOWN = 1e-6
#: Words whose probabilities a worker keeps, and that it scores at once.
KNOWN_WORDS, WORDS_AT_ONCE = 200_000, 4_000


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def _code_points(words: list[str], marked: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, each after the mark of a word's start unless they have it; their starts and lengths."""
    words = words if marked else ["▁" + w for w in words]
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.cumsum(size) - size, size


class Pieces:
    """The pieces by length and hash, for finding all pieces in words at once."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.by_length = []
        flat = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in pieces]
        self.longest = max(map(len, flat))
        power, _ = powers(self.longest + 1)
        for size in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(flat) if len(p) == size], np.int64)
            if len(ids):
                h = ((np.stack([flat[i] for i in ids]).astype(np.uint64) + np.uint64(1)) * power[:size]).sum(1, dtype=np.uint64)
                order = np.argsort(h)
                self.by_length.append((size, h[order], ids[order]))

    def found(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(length, id of the piece of that length that ends at each place; n + 1 where there is none, n for a lone unknown code point)."""
        n = len(flat)
        power, inverse = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        inside = np.arange(n) - np.repeat(start, size)
        out = []
        for length, hashes, ids in self.by_length:
            at = np.flatnonzero(inside >= length - 1)
            piece = np.full(n, self.n + 1, np.int32)
            if len(at):
                h = (sums[at + 1] - sums[at + 1 - length]) * inverse[at + 1 - length]
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                piece[at] = np.where(hashes[k] == h, ids[k], self.n + 1)
            if length == 1:
                piece[piece == self.n + 1] = self.n
            out.append((length, piece))
        return out


def forward(pieces: Pieces, probability: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word) by language (columns of probability), summed over all segmentations.

    All words advance together, one code point a step; values are rescaled before they underflow.
    """
    langs = probability.shape[1]
    flat, start, size = _code_points(words)
    found = pieces.found(flat, start, size)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    ring = pieces.longest + 1
    a = np.zeros((ring, len(words), langs))
    a[0] = 1.0
    scale = np.zeros((len(words), langs))
    out = np.zeros((len(words), langs))
    active = len(words)
    for e in range(1, int(size[0]) + 1 if len(size) else 1):
        while active and size[active - 1] < e:
            active -= 1
        now = np.zeros((active, langs))
        at = start[:active] + e - 1
        for length, piece in found:
            if length > e:
                break
            p = piece[at]
            hit = np.flatnonzero(p <= pieces.n)
            if len(hit):
                now[hit] += a[(e - length) % ring, hit] * probability[p[hit]]
        a[e % ring, :active] = now
        if e % 8 == 0:
            low = now < 1e-120
            if low.any():
                for j in range(ring):
                    a[j, :active][low] *= 1e120
                scale[:active][low] -= 120 * np.log(10.0)
        last = slice(int(np.searchsorted(-size, -e, "left")), active)
        if last.start < last.stop:
            out[last] = np.log(np.maximum(a[e % ring, last], 1e-300)) + scale[last]
    back = np.empty_like(out)
    back[order] = out
    return back


def expected_counts(pieces: Pieces, probability: np.ndarray, words: list[str], weight: np.ndarray, marked: bool = False) -> np.ndarray:
    """Expected piece counts by language, over all segmentations of words that occur weight (words x languages) times."""
    langs = probability.shape[1]
    flat, start, size = _code_points(words, marked)
    found = pieces.found(flat, start, size)
    place = start + np.arange(len(words))  # each word has a place more than code points
    a = np.zeros((len(flat) + len(words), langs))
    b = np.zeros_like(a)
    a[place] = 1.0
    b[place + size] = 1.0
    longest = int(size.max(initial=0))
    for e in range(1, longest + 1):
        w = np.flatnonzero(size >= e)
        for length, piece in found:
            if length > e:
                break
            a[place[w] + e] += a[place[w] + e - length] * probability[piece[start[w] + e - 1]]
    for e in range(longest, 0, -1):
        w = np.flatnonzero(size >= e)
        for length, piece in found:
            if length > e:
                break
            b[place[w] + e - length] += b[place[w] + e] * probability[piece[start[w] + e - 1]]
    total = a[place + size]
    share = np.where(total > 0, weight / np.maximum(total, 1e-300), 0.0)
    of_word = np.repeat(np.arange(len(words)), size)
    end = np.arange(len(flat)) + of_word + 1
    counts = np.zeros((pieces.n + 2, langs))
    for length, piece in found:
        at = np.flatnonzero(piece <= pieces.n)
        gain = a[end[at] - length] * probability[piece[at]] * b[end[at]] * share[of_word[at]]
        for k in range(langs):
            counts[:, k] += np.bincount(piece[at], gain[:, k], pieces.n + 2)
    counts[pieces.n + 1] = 0
    return counts


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(words.hash, return_index=True, return_inverse=True)


def starting_point(pieces: list[str], langs: int) -> tuple[np.ndarray, np.ndarray]:
    """(prior of the pieces, probabilities to begin with: of the pieces, the unknown code point and a row of zeros, by language)."""
    prior = 1.0 / (np.arange(len(pieces)) + 100.0)  # the vocabulary stands in order of frequency
    prior /= prior.sum()
    p = np.zeros((len(pieces) + 2, langs))
    p[: len(pieces)], p[len(pieces)] = prior[:, None], UNKNOWN
    return prior, p


def next_probabilities(p: np.ndarray, counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The maximisation step: expected counts and the prior, which is the same for all languages, so that only evidence tells them apart."""
    smoothed = counts[: len(prior)] + PRIOR_COUNT * prior[:, None]
    return np.concatenate([smoothed / smoothed.sum(0), p[len(prior) :]])


def units(texts: list[str]) -> list[str]:
    """Words after the mark of a word's start, in consecutive pieces of at most FIT_UNIT code points."""
    return [m[i : i + FIT_UNIT] for m in ("▁" + t for t in texts) for i in range(0, len(m), FIT_UNIT)]


def unit_counts(sample: DataFrame, langs: list[str]) -> DataFrame:
    """(unit, counts): distinct units of a sample (text, lang), and how often each language has them."""
    at = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(0), lower=False)
                _, index, inverse = _distinct(words)
                lang = np.repeat(np.array([at[x] for x in part.column(1).to_pylist()], np.int64), np.diff(words.first))
                cell, n = np.unique(inverse * len(langs) + lang, return_counts=True)
                word, k = cell // len(langs), cell % len(langs)
                texts = words.texts(index)
                own = [units([texts[i]]) for i in word.tolist()]
                size = [len(x) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([u for x in own for u in x], pa.string()), pa.array(np.repeat(k, size), pa.int32()), pa.array(np.repeat(n, size), pa.int64())], names=["unit", "lang", "n"])

    found = sample.select("text", "lang").mapInArrow(run, "unit string, lang int, n long")
    counts = F.array(*[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).cast("double") for i in range(len(langs))])
    return found.groupBy("unit").agg(counts.alias("counts"))


def fit(sample: DataFrame, pieces: list[str], rounds: int = FIT_ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities of the pieces, the unknown code point and a row of zeros) from rows (text, lang).

    Each round's expectation is taken on the executors, over parts of the distinct units; what reaches the
    driver is a table of vocabulary x languages.
    """
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    prior, p = starting_point(pieces, len(langs))
    if not langs:
        return [], p
    spark = sample.sparkSession
    counted = cut_table(unit_counts(sample, langs).repartition(FIT_PARTS))
    width = -(-(len(pieces) + 2) // CHUNKS)

    for _ in range(rounds):
        model = spark.sparkContext.broadcast((pieces, p))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, p = model.value
            kinds, total = Pieces(pieces), np.zeros(p.shape)
            for batch in batches:
                for i in range(0, batch.num_rows, FIT_WORDS):
                    part = batch.slice(i, FIT_WORDS)
                    weight = pc.list_flatten(part.column(1)).to_numpy().reshape(part.num_rows, p.shape[1])
                    total += expected_counts(kinds, p, part.column(0).to_pylist(), weight, marked=True)
            chunks = [np.ascontiguousarray(total[i : i + width]).tobytes() for i in range(0, len(total), width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "counts"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("counts"))
            return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

        rows = counted.mapInArrow(expect, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
        counts = np.concatenate([np.frombuffer(r["counts"], np.float64) for r in sorted(rows, key=lambda r: r["chunk"])]).reshape(p.shape)
        p = next_probabilities(p, counts, prior)
        model.unpersist()
    return langs, p


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out_column())


def held_out_column():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_sample(docs: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> DataFrame:
    """(text, lang): about `rows` whole texts and about `chars` code points of each language, chosen by a hash of the row, and one text at least."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") / float(1 << 53)).alias("u")
    usable = training_rows(docs).select("text", "lang", u)
    per = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.min("u").alias("first"))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("n"), F.lit(float(chars)) / F.greatest(F.col("chars"), F.lit(1)))
    shares = per.select("lang", F.greatest(share, "first").alias("share"))  # a row for each language
    return usable.join(F.broadcast(shares), "lang").where(F.col("u") <= F.col("share")).select("text", "lang")


def identify(docs: DataFrame, langs: list[str], pieces: list[str], probability: np.ndarray) -> DataFrame:
    """docs with lang_pred and score, the probability of lang_pred given the text if all languages are as likely.

    Defined cases: a text that is null or has no letter (Unicode category L), and every text if
    nothing was learnt, gets "und" and score 0; very long texts are scored whole, a slice with one of them being that
    text alone; ties go to the first language by name; rows that repeat are told each by itself, alike; input columns
    called lang_pred or score are replaced; an empty table gives an empty table.
    """
    docs = docs.drop("lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast((langs, pieces, probability))  # vocabulary x languages
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces, probability = model.value
        kinds = Pieces(pieces)
        known, scores = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column(part.schema.get_field_index("text"))
                letters = [t is not None and next(filter(str.isalpha, t), None) is not None for t in column.to_pylist()]
                pred, sure = [UNDETERMINED] * len(letters), np.zeros(len(letters))
                if langs and any(letters):
                    words = Words(column, lower=False)
                    h, index, inverse = _distinct(words)
                    if len(known) > KNOWN_WORDS:
                        known, scores = known[:0], scores[:0]
                    at = np.searchsorted(known, h)
                    fresh = np.flatnonzero((at == len(known)) | (np.append(known, np.uint64(0))[at] != h))
                    if len(fresh):
                        new = [forward(kinds, probability, words.texts(index[fresh[i : i + WORDS_AT_ONCE]])) for i in range(0, len(fresh), WORDS_AT_ONCE)]
                        known, scores = np.insert(known, at[fresh], h[fresh]), np.insert(scores, at[fresh], np.concatenate(new), axis=0)
                    each = scores[np.searchsorted(known, h)][inverse]
                    sums = np.concatenate([np.zeros((1, len(langs))), np.cumsum(each, 0)])
                    total = sums[words.first[1:]] - sums[words.first[:-1]]
                    best = total.argmax(1)
                    odds = np.exp(total - total.max(1, keepdims=True))
                    top = odds.max(1) / odds.sum(1)
                    for i, ok in enumerate(letters):
                        if ok:
                            pred[i], sure[i] = langs[best[i]], top[i]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(sure)], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def detect(docs: DataFrame, vocabulary_path: str | None = None, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> DataFrame:
    """Fit on the rows of docs that may be learnt from, then identify every row; adds held_out, lang_pred and score.

    Defined cases: as for `identify`; rows whose lang or text is null, or whose doc_id is held out, aren't learnt from, a null doc_id counting as the id "";
    every language among the others has at least one of its texts in the sample; an input column called held_out is replaced.
    """
    bound_batches(docs.sparkSession)
    pieces = vocabulary(vocabulary_path)
    langs, probability = fit(fit_sample(docs, rows, chars), pieces)
    return identify(docs.withColumn("held_out", held_out_column()), langs, pieces, probability)
