"""LM scoring by a Katz backoff bigram model with Good-Turing discounts.

The texts are read once and written as packed blocks: distinct words, distinct bigrams by
context, and which texts use them.  From then on only distinct words and bigrams travel, a
block's for each partition in one row:

1. Partitions of words add up the blocks' counts and number the words by frequency, so that
   frequent words have small numbers and columns of numbers pack well.
2. Partitions of bigrams, by context, add up counts, and for each context what its discounts
   and exactly normalised backoff weight are made of.
3. Each block gets back what it asked for and scores its own texts, token by token: a bigram
   seen in training by its discounted count, else by backing off to the word.

No task and no broadcast holds a table of all words or bigrams.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, release
from .textkernel import Words, slices

#: Counts above this are not discounted.
GOOD_TURING_K = 5
#: Bytes of text in a block, about; a longer text is a block's by itself.
BLOCK_BYTES = 16_000_000
#: Contexts with more than 1 / HOT of all tokens are dealt over SALTS parts by the word that follows.
HOT, SALTS = 1000, 16
#: The token at the end of each text, which is also the context of its first word.
END = np.uint64(0x5851F42D4C957F2D)
_ROW = "kind int, block long, place int, data binary, doc long, doc_id long, held_out boolean, n_tokens long"
_TEXT, _TYPES, _USES, _WORDS, _WORD_ANSWER, _ANSWER = range(6)


def held_out_column() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def good_turing(n: list[float], k: int = GOOD_TURING_K) -> np.ndarray:
    """Katz's ratios d[r] for r <= k from the numbers n[r] of types seen r times; d[r] = 1 beyond.

    Where the numbers give no ratio in (0, 1), as in small corpora, d[r] is that of absolute discounting.
    """
    d = np.ones(k + 2)
    plain = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] > 0 else 0.5
    plain = min(max(plain, 0.1), 0.9)
    big = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - big) / (1 - big) if n[r] and big < 1 else 0.0
        d[r] = ratio if 0 < ratio < 1 else (r - plain) / r
    return d


class Unigrams:
    """The lower-order distribution: discounted counts, and the rest for the class of all unknown words."""

    def __init__(self, total: float, kinds: float, n: list[float]):
        self.total, self.kinds, self.d = total, kinds, good_turing(n)
        # sum of d[c] * c / total over known tokens = 1 - what is taken off the rare ones
        taken = sum((1 - self.d[r]) * r * n[r] for r in range(1, GOOD_TURING_K + 1))
        self.unknown = max(taken / total, 1 / (total + 1)) if total else 1.0
        self.scale = (1 - self.unknown) / (1 - taken / total) if total and taken < total else 0.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * self.d[np.minimum(c, GOOD_TURING_K + 1)] * c / max(self.total, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.kinds + 1)))


def _pack(*columns: np.ndarray) -> bytes:
    head = np.array([len(columns), *[x for c in columns for x in (len(c), c.dtype.itemsize)]], np.int64)
    raw = b"".join([head.tobytes(), *[np.ascontiguousarray(c).tobytes() for c in columns]])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    m = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * m, 8).tolist()
    at, out = 8 * (2 * m + 1), []
    for n, width in zip(head[::2], head[1::2]):
        out.append(np.frombuffer(data, kinds[width], n, at))
        at += n * width
    return out


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def probabilities(n: np.ndarray, of: np.ndarray, total: np.ndarray, whole: np.ndarray, rare: list[np.ndarray], covered: np.ndarray, lower_p: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 P of bigrams seen n times; of is each one's context.

    By context: total occurrences, whether all its followers are seen too often to be discounted (whole), rare[r - 1]
    followers seen r times, and covered, the sum of the lower-order probabilities of all seen followers.  Seen followers
    get d[n] * n / total; what that leaves goes to the others in proportion to the lower order, with the weight
    left / (1 - covered), so that each context sums to 1.
    """
    # A context without discounted followers has nothing left: one more occurrence is assumed, of none of them.
    denominator = np.maximum(np.where(whole, total + 1, total), 1)
    left = np.where(whole, 1, sum((1 - d[r]) * r * rare[r - 1] for r in range(1, GOOD_TURING_K + 1))) / denominator
    weight = np.where(total > 0, left / np.maximum(1 - covered, 1e-12), 1.0)
    seen = n > 0
    out = np.empty(len(n))
    out[seen] = d[np.minimum(n[seen], GOOD_TURING_K + 1)] * n[seen] / denominator[of[seen]]
    out[~seen] = weight[of[~seen]] * lower_p[~seen]
    return np.log10(out)


def _rows(kinds: list[int], block: int, places: list[int], data: list[bytes | None]) -> dict:
    n = len(kinds)
    return {"kind": pa.array(kinds, pa.int32()), "block": pa.array([block] * n, pa.int64()), "place": pa.array(places, pa.int32()), "data": pa.array(data, pa.binary())}


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of _ROW: a _TEXT for each text, and for each block its bigrams (_TYPES), which texts use them (_USES), and its words for each part (_WORDS).

    A block's words are ordered by part and hash, and known by their place in that order; its bigrams are ordered by context and word.
    """

    def block(number: int, parts_of: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts_of)
        held = table.column("held_out").to_numpy()
        hashes, sizes = [], []
        for part in slices(table.combine_chunks(), "text"):
            w = Words(part.column("text"), lower=True)
            hashes.append(w.hash), sizes.append(np.diff(w.first))
        h, size = np.concatenate(hashes), np.concatenate(sizes) + 1
        doc = np.repeat(np.arange(len(size)), size)
        ends = np.cumsum(size) - 1
        token = np.full(len(doc), END, np.uint64)
        inner = np.ones(len(doc), bool)
        inner[ends] = False
        token[inner] = h
        words, second = np.unique(token, return_inverse=True)
        part_of = (words % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part_of, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words, part_of, second = words[order], part_of[order], place[second]
        train = ~held[doc]
        n = np.bincount(second, train, len(words)).astype(np.int64)
        first = np.empty(len(second), np.int64)
        first[1:] = second[:-1]
        first[ends - size + 1] = second[ends[0]]  # the end's place
        order = np.lexsort((doc, second, first))
        doc, first, second, train = doc[order], first[order], second[order], train[order]
        new = np.ones(len(doc), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(new)
        seen = np.bincount(np.cumsum(new) - 1, train).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], first[at][1:] != first[at][:-1]]))
        kinds, places = [_TYPES, _USES], [-1, -1]
        data = [_pack(_small(first[at][heads]), _small(np.diff(np.append(heads, len(at)))), _small(second[at]), _small(seen)), _pack(_small(np.diff(np.append(at, len(doc)))), _small(doc))]
        cuts = np.searchsorted(part_of, np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[p], cuts[p + 1])
            kinds.append(_WORDS), places.append(p), data.append(_pack(words[own], _small(n[own])))
        m = len(kinds)
        rows = _rows([_TEXT] * len(size) + kinds, number, [-1] * len(size) + places, [None] * len(size) + data)
        rows["doc"] = pa.array([*range(len(size)), *[None] * m], pa.int64())
        for name, column in (("doc_id", table.column("doc_id").to_pylist()), ("held_out", held.tolist()), ("n_tokens", size.tolist())):
            rows[name] = pa.array([*column, *[None] * m], pa.bool_() if name == "held_out" else pa.int64())
        return pa.RecordBatch.from_pydict(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, kept, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                kept.append(part)
                size += part.column(2).nbytes
                if size >= BLOCK_BYTES:
                    yield block(number, kept)
                    number, kept, size = number + 1, [], 0
        if kept:
            yield block(number, kept)

    return docs.select(F.col("doc_id").cast("long"), held_out_column().alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _ROW)


def _word_answers(asked: DataFrame, parts: int) -> DataFrame:
    """(block, place, data, seen): for each word a block asked of a part its count in training and its number.
    Rows with a null block have in seen what the part's words add to the sums: all, distinct, and those seen 1, 2, ... times."""

    def run(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        blocks, asks = table.column("block").to_pylist(), [_unpack(x.as_py()) for x in table.column("data")]
        words, of = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
        total = np.bincount(of, np.concatenate([a[1] for a in asks])).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.lexsort((words, -total))] = np.arange(len(words)) * parts + place
        cuts = np.cumsum([0, *[len(a[0]) for a in asks]])
        data = [_pack(_small(total[of[a:b]]), _small(number[of[a:b]])) for a, b in zip(cuts[:-1], cuts[1:])]
        seen = [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, GOOD_TURING_K + 2), minlength=GOOD_TURING_K + 3)[1 : GOOD_TURING_K + 2].tolist()]
        return _answer_table(blocks, place, data, seen)

    return asked.where(F.col("kind") == _WORDS).groupBy("place").applyInArrow(run, "block long, place int, data binary, seen array<long>")


def _answer_table(blocks: list[int], place: int, data: list[bytes], seen: list[int]) -> pa.Table:
    n = len(blocks)
    return pa.table({"block": pa.array([*blocks, None], pa.int64()), "place": pa.array([place] * (n + 1), pa.int32()), "data": pa.array([*data, None], pa.binary()), "seen": pa.array([*[None] * n, seen], pa.list_(pa.int64()))})


class _Block:
    """A block's bigrams with what is known of its words, in the order in which it asks for them: by part, context and word."""

    def __init__(self, types: bytes, answers: list[tuple[int, bytes]], all_tokens: float, parts: int):
        heads, runs, second, seen = _unpack(types)
        found = [_unpack(data) for _, data in sorted(answers)]
        self.total, number = (np.concatenate([f[j] for f in found]).astype(np.int64) for j in (0, 1))
        self.second = second.astype(np.int64)
        first = np.repeat(heads.astype(np.int64), runs)
        hot = self.total[first] > all_tokens / HOT
        place = (number[first] + np.where(hot, number[self.second] % SALTS, 0)) % parts
        self.order = np.lexsort((number[self.second], number[first], place))
        f, s, p = first[self.order], self.second[self.order], place[self.order]
        at = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (p[1:] != p[:-1])]))
        run = np.diff(np.append(at, len(f)))
        context, h_place = f[at], p[at]
        # A hot context is asked of all its parts, for what they hold of it adds up.
        there = set(zip(context[hot[self.order][at]].tolist(), h_place[hot[self.order][at]].tolist()))
        more = sorted({(w, (int(number[w]) + i) % parts) for w, _ in there for i in range(SALTS)} - there)
        if more:
            context = np.concatenate([context, np.array([w for w, _ in more], np.int64)])
            h_place, run = np.concatenate([h_place, np.array([p for _, p in more], np.int64)]), np.concatenate([run, np.zeros(len(more), np.int64)])
            order = np.lexsort((number[context], h_place))
            context, h_place, run = context[order], h_place[order], run[order]
        # Only contexts with a bigram unseen in the block can back off, and need what the weight is made of.
        unseen = np.zeros(len(self.total), bool)
        unseen[first[seen == 0]] = True
        self.context, self.h_place, self.run, self.place = context, h_place, run, p
        self.need = unseen[context]
        self.numbers, self.seconds, self.seen, self.counts = number[context], number[s], seen[self.order].astype(np.int64), self.total[s]


def _asked_bigrams(asked: DataFrame, words: DataFrame, all_tokens: float, parts: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        types, answers = None, []
        for kind, place, data in zip(*(table.column(n).to_pylist() for n in ("kind", "place", "data"))):
            if kind == _TYPES:
                types = data
            else:
                answers.append((place, data))
        b = _Block(types, answers, all_tokens, parts)
        cuts, h_cuts = np.searchsorted(b.place, np.arange(parts + 1)), np.searchsorted(b.h_place, np.arange(parts + 1))
        places, out = np.flatnonzero(np.diff(h_cuts)).tolist(), []
        for p in places:
            own, h = slice(cuts[p], cuts[p + 1]), slice(h_cuts[p], h_cuts[p + 1])
            out.append(_pack(_small(b.numbers[h]), _small(b.run[h]), b.need[h].astype(np.uint8), _small(b.seconds[own]), _small(b.seen[own]), _small(b.counts[own])))
        rows = _rows([_ANSWER] * len(out), table.column("block")[0].as_py(), places, out)
        return pa.table({n: rows[n] for n in ("block", "place", "data")})

    given = asked.where(F.col("kind") == _TYPES).select("block", "kind", "place", "data").unionByName(_told(words, _WORD_ANSWER))
    return given.groupBy("block").applyInArrow(run, "block long, place int, data binary")


def _told(answers: DataFrame, kind: int) -> DataFrame:
    return answers.where("block is not null").select("block", F.lit(kind).alias("kind"), "place", "data")


def _answers(bigrams: DataFrame, lower: Unigrams) -> DataFrame:
    """(block, place, data, seen): for each bigram a block asked of a part its count, and for each context what probabilities() needs.
    Rows with a null block have in seen the numbers of the part's bigrams that were seen 1, 2, ... times."""

    def run(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        blocks, asks = table.column("block").to_pylist(), [_unpack(x.as_py()) for x in table.column("data")]
        heads, of = np.unique(np.concatenate([a[0].astype(np.int64) for a in asks]), return_inverse=True)
        h_cuts = np.cumsum([0, *[len(a[0]) for a in asks]])
        first = np.concatenate([np.repeat(of[h_cuts[i] : h_cuts[i + 1]], a[1]) for i, a in enumerate(asks)])
        second, seen, count = (np.concatenate([a[j].astype(np.int64) for a in asks]) for j in (3, 4, 5))
        order = np.lexsort((second, first))
        f, s = first[order], second[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        kind = np.cumsum(new) - 1
        n = np.bincount(kind, seen[order]).astype(np.int64)
        f, c, m = f[new], count[order][new], len(heads)
        total = np.bincount(f, n, m).astype(np.int64)
        rare = [np.bincount(f[n == r], minlength=m) for r in range(1, GOOD_TURING_K + 1)]
        covered = np.bincount(f, np.where(n > 0, lower.p(c), 0.0), m)
        whole = (sum(rare) == 0).astype(np.uint8)
        back = np.empty(len(first), np.int64)
        back[order] = n[kind] if len(n) else 0
        cuts, data = np.cumsum([0, *[len(a[3]) for a in asks]]), []
        for i, a in enumerate(asks):
            h = of[h_cuts[i] : h_cuts[i + 1]]
            need = h[a[2] > 0]
            data.append(_pack(_small(back[cuts[i] : cuts[i + 1]]), _small(total[h]), whole[h], covered[need].view(np.uint64), *[_small(x[need]) for x in rare]))
        r = np.bincount(np.minimum(n, GOOD_TURING_K + 2), minlength=GOOD_TURING_K + 3)[1 : GOOD_TURING_K + 2].tolist()
        return _answer_table(blocks, place, data, r)

    return bigrams.groupBy("place").applyInArrow(run, "block long, place int, data binary, seen array<long>")


def _scored(asked: DataFrame, words: DataFrame, answers: DataFrame, lower: Unigrams, d: np.ndarray, parts: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        place, data = table.column("place").to_pylist(), table.column("data")
        of_kind = lambda k: [(place[i], data[i].as_py()) for i in np.flatnonzero(kind == k).tolist()]
        texts = table.filter(pa.array(kind == _TEXT))
        b = _Block(of_kind(_TYPES)[0][1], of_kind(_WORD_ANSWER), lower.total, parts)
        uses, doc = _unpack(of_kind(_USES)[0][1])
        found = [_unpack(x) for _, x in sorted(of_kind(_ANSWER))]
        n = np.concatenate([x[0] for x in found]).astype(np.int64)
        context, of = np.unique(b.context, return_inverse=True)
        m = len(context)
        total = np.bincount(of, np.concatenate([x[1] for x in found]), m)
        whole = np.bincount(of, np.concatenate([x[2] for x in found]) == 0, m) == 0
        covered = np.bincount(of[b.need], np.concatenate([x[3].view(np.float64) for x in found]), m)
        rare = [np.bincount(of[b.need], np.concatenate([x[j] for x in found]), m) for j in range(4, 4 + GOOD_TURING_K)]
        p = np.empty(len(n))
        p[b.order] = probabilities(n, np.repeat(of, b.run), total, whole, rare, covered, lower.p(b.counts), d)
        doc, c = doc.astype(np.int64), b.total[b.second]
        size = texts.num_rows
        sums = {"n_known": np.bincount(doc, np.repeat(c > 0, uses), size).astype(np.int64), "base_score": np.bincount(doc, np.repeat(lower.base(c), uses), size), "score": np.bincount(doc, np.repeat(p, uses), size)}
        at = texts.column("doc").to_numpy()
        return pa.table({**{x: texts.column(x) for x in ("doc_id", "held_out", "n_tokens")}, **{x: pa.array(v[at]) for x, v in sums.items()}})

    given = asked.where(F.col("kind") <= _USES)
    for told, k in ((words, _WORD_ANSWER), (answers, _ANSWER)):
        given = given.unionByName(_told(told, k), allowMissingColumns=True)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return given.groupBy("block").applyInArrow(run, schema)


def _sums(answers: DataFrame, n: int) -> list[float]:
    row = answers.where("block is null").agg(*[F.sum(F.get("seen", F.lit(i))).alias(f"n{i}") for i in range(n)]).first()
    return [float(x or 0) for x in row]


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Tokens are words with A-Z lower-cased and one end for each text; the model learns from the
    texts that held_out_column leaves.  An unknown word is one class of the vocabulary.  score is log10 of the
    text's probability, base_score that of add-0.5 word frequencies.

    Defined cases: a null or empty text is one end token; a very long text is a block by itself; a null doc_id counts as the id "" for the split; ties don't arise;
    repeated rows are learnt and scored each; with nothing to learn from, every token is unknown;
    other columns are not returned; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    parts = max(32, partitions(spark))
    asked = cut(blocks(docs, parts))
    words = cut(_word_answers(asked, parts))
    total, kinds, *n = _sums(words, GOOD_TURING_K + 3)
    lower = Unigrams(total, kinds, [0.0, *n])
    release(spark)
    answers = cut(_answers(_asked_bigrams(asked, words, total, parts), lower))
    release(spark)
    d = good_turing([0.0, *_sums(answers, GOOD_TURING_K + 1)])
    scored = _scored(asked, words, answers, lower, d, parts)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
