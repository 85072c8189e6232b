"""N-gram Jaccard self-join: exact links between shingle sets, and the components they form.

Equal sets are one node.  Nodes are indexed under their rarest shingles (the prefix that any
partner must share), with set size and position; entries without another of about their size in their list go at once.
Relations between sets then save most of the work:

1. A list is read block by block (a block: equal sizes, ordered by position); a probe takes from each
   block only the entries before the last position that can still reach the overlap.
2. In a long list a set that isn't yet near another one becomes a pivot, whose distances to all entries in
   reach are computed.  The answers of sets near it are derived from these: by the triangle
   inequality only entries whose distance to the pivot is about the set's own can be near it.
3. Distances are those of parity sketches, which never exceed the sets' own, so a pair too far apart by them isn't
   linked.  Of the pairs left a task keeps a spanning forest, the nearest pairs first: these are verified.
   If all of a tree's pairs are links, no other pair in it needs an answer, as it changes no component.
4. The nodes of trees with a pair that isn't a link are read again with finer sketches, and
   all their pairs across components are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, cut_table, partitions
from .textkernel import Words, mix, once, shingles, slices, unique_sets

WORDS = 3
SHARE = (90, 100)
#: Cells of the table of shingle counts by which the index orders shingles; its size is fixed, and no result depends on it.
CELL_BITS = 20
CHUNKS = 64
#: Bits of a sketch for each shingle in which linked sets may differ, in the first reading and for trees that are read again.
COARSE, FINE = 8, 64
#: Lists up to this length are compared pair by pair, many lists at once; longer ones by pivots.
SMALL = 48
#: Lists beyond this length are dealt over parts that meet two by two.
LONG = 20_000
#: Pairs that a task holds before it reduces them to trees.
HELD = 300_000
#: Links that a task reduces to trees at once.
EDGES = 250_000
#: Nodes in more pairs than this have their text copied to SALTS parts for verification.
HEAVY = 500
#: Up to so many nodes (8 MB) are broadcast to select their texts; beyond, texts and nodes are joined by a shuffle.
FEW_NODES = 500_000
SALTS = 16


def least_overlap(a, b, share: tuple[int, int] = SHARE):
    """The least i with share[1] * i >= share[0] * (a + b - i)."""
    return -((-share[0] * (a + b)) // (share[0] + share[1]))


def prefix_length(n: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """Shingles under which a set of n is indexed; 0 if only an equal set could be linked."""
    least = -((-share[0] * n) // share[1])
    most = n * share[1] // share[0]
    return np.where((least == n) & (most == n), 0, n - least + 1)


def _sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(part.column(part.schema.get_field_index("text")), lower=True)
    return unique_sets(*shingles(words, k))


def shingle_counts(docs: DataFrame, k: int = WORDS) -> np.ndarray:
    """Documents by cell of the hash of their shingles: 2**CELL_BITS numbers, whatever the data."""
    cells, width = 1 << CELL_BITS, (1 << CELL_BITS) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                values, _ = _sets(part, k)
                total += np.bincount((values & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        if total.any():
            parts = [total[i * width : (i + 1) * width].astype("<i4").tobytes() for i in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<i4")
        total = np.minimum(total, (1 << 31) - 1).astype("<i4")
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(cells, np.int32)
    for r in rows:
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["counts"], "<i4")
    return out


def most_apart(a, b, share: tuple[int, int] = SHARE):
    """Shingles that linked sets of a and b hold alone, at most."""
    return a + b - 2 * least_overlap(a, b, share)


def parity_sketches(values: np.ndarray, n: np.ndarray, share: tuple[int, int], fine: int) -> pa.Array:
    """Parity bits of each set, a power of two of them and at least `fine` for each shingle in which linked sets may differ.

    A shingle in one of two sets changes one bit, so sketches differ in no more bits than the sets have such shingles; the halves
    of a sketch, laid over each other, are the sketch of half the size.
    """
    bits = np.exp2(np.ceil(np.log2(np.maximum(fine * most_apart(n, n, share), 256)))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(bits)])
    bit = np.repeat(ends[:-1], n) + ((values >> np.uint64(20)) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(bit, minlength=ends[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(packed)])


class Sketches:
    """The sketches of a column, compared many at a time."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        self.words = pc.binary_length(column).to_numpy().astype(np.int64) // 8
        self.start = np.cumsum(self.words) - self.words
        self.flat = np.frombuffer(b"".join(column.to_pylist()), np.uint64)

    def _rows(self, k: np.ndarray, width: int) -> np.ndarray:
        out = self.flat[self.start[k][:, None] + np.arange(width)]
        for m in range(1, int(self.words[k].max()) // width):
            wide = np.flatnonzero(self.words[k] > m * width)
            out[wide] ^= self.flat[self.start[k[wide]][:, None] + (m * width + np.arange(width))]
        return out

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which sketches i and j differ."""
        out = np.zeros(len(i), np.int64)
        least = np.minimum(self.words[i], self.words[j])
        for width in np.unique(least).tolist():
            at = np.flatnonzero(least == width)
            for part in np.array_split(at, -(-len(at) * width // 2_000_000)):
                out[part] = np.bitwise_count(self._rows(i[part], width) ^ self._rows(j[part], width)).sum(1)
        return out


def signatures(docs: DataFrame, k: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, n_shingles, sig1, sig2, prefix, sketch): set size, a 128-bit digest of the set (null if empty), the rarest shingles in order, and a sketch."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value.astype(np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = _sets(part, k)
                n = np.diff(offsets)
                has = n > 0
                sigs = []
                for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(seed)), dtype=np.uint64)])
                    sigs.append(mix(sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64))
                order = (np.minimum(table[(values & np.uint64(len(table) - 1)).astype(np.int64)], np.uint64((1 << 24) - 1)) << np.uint64(40)) | (values >> np.uint64(24))
                take = prefix_length(n, share)
                place = np.empty(int(take.sum()), np.int64)
                at = 0
                for a, b, m in zip(offsets[:-1].tolist(), offsets[1:].tolist(), take.tolist()):
                    if m:
                        place[at : at + m] = a + np.argsort(order[a:b], kind="stable")[:m]
                        at += m
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(values[place].astype(np.int64)))
                columns = [part.column(0), pa.array(n), *(pa.array(s, mask=~has) for s in sigs), prefix, parity_sketches(values, n, share, COARSE)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "sig1", "sig2", "prefix", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, sig1 long, sig2 long, prefix array<long>, sketch binary")


def shared_entries(nodes: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """(token, n, pos, node): the index entries whose list has another entry of a size that can be linked.

    The lists are cut by range and ordered by size, so that a long one is spread over tasks and an entry needs to
    look at those beside it only; the first and the last entry of a part always stay.
    """
    names = ["token", "n", "pos", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, True  # last: the row held back, known: whether it stays
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if last is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(last, cols)]
            token, n = cols[:2]
            keep = np.zeros(len(token), bool)
            keep[0] = known
            same = (token[1:] == token[:-1]) & (share[1] * n[:-1] >= share[0] * n[1:])
            keep[1:] |= same
            keep[:-1] |= same
            last, known = [c[-1:] for c in cols], keep[-1]
            stay = np.flatnonzero(keep[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[stay]) for c in cols], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=names)

    entries = nodes.where(F.size("prefix") > 0).select(F.posexplode("prefix").alias("pos", "token"), "n", "node").select("token", "n", F.col("pos").cast("long"), "node")
    order = ["token", "n", "pos", "node"]
    return entries.repartitionByRange(2 * partitions(nodes.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, "token long, n long, pos long, node long")


class _Lists:
    """Whole index lists, ordered by list, n and pos: which pairs of entries may be linked."""

    def __init__(self, table: pa.Table, share: tuple[int, int]):
        self.list, self.n, self.pos, self.node, self.comp, self.own, self.cross = (table.column(c).to_numpy() for c in _LIST_COLUMNS[:-1])
        self.sketch, self.share = Sketches(table.column("sketch")), share
        self.cuts = np.flatnonzero(np.concatenate([[True], self.list[1:] != self.list[:-1], [True]]))
        self.size = np.diff(self.cuts)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs (i, j) that sketches don't rule out, and how near they are (0: equal sketches)."""
        most = most_apart(self.n[i], self.n[j], self.share)
        apart = self.sketch.apart(i, j)
        ok = np.flatnonzero(apart <= most)
        return i[ok], j[ok], apart[ok] / (most[ok] + 1.0)

    def meet(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.comp[i] != self.comp[j]) & (~self.cross[i] | (self.own[i] != self.own[j]))

    def small(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of the lists up to SMALL: entries 1, 2, ... places apart, of all lists at once; sizes grow along a list, so the first too large ends it."""
        after = np.repeat(self.cuts[1:], self.size) - np.arange(len(self.list)) - 1
        at = np.flatnonzero((np.repeat(self.size, self.size) <= SMALL) & (after > 0))
        shift = 1
        while len(at):
            j = at + shift
            a, b = self.n[at], self.n[j]
            close = self.share[1] * a >= self.share[0] * b
            at, j, a, b = at[close], j[close], a[close], b[close]
            need = least_overlap(a, b, self.share)
            ok = (a - self.pos[at] >= need) & (b - self.pos[j] >= need) & self.meet(at, j)
            yield self.near(at[ok], j[ok])
            shift += 1
            at = at[after[at] >= shift]

    def long(self, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k in np.flatnonzero(self.size > SMALL).tolist():
            s, t = int(self.cuts[k]), int(self.cuts[k + 1])
            if (self.comp[s:t] != self.comp[s]).any():
                yield from self._long(s, t, forest)

    def _long(self, s: int, t: int, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, pos = self.n[s:t], self.pos[s:t]
        sizes, starts, block = np.unique(n, return_index=True, return_inverse=True)
        width = int(pos.max()) + 2
        key = block * width + pos

        def reach(p: int) -> np.ndarray:
            """Entries whose size and position allow a link with p: a run at the head of each block."""
            a = int(n[p])
            lo = int(np.searchsorted(self.share[1] * sizes, self.share[0] * a, "left"))
            hi = int(np.searchsorted(self.share[0] * sizes, self.share[1] * a, "right"))
            need = least_overlap(a, sizes[lo:hi], self.share)
            blocks = np.arange(lo, hi)[a - pos[p] >= need]
            last = np.minimum(sizes[blocks] - least_overlap(a, sizes[blocks], self.share), width - 1)
            ends = np.searchsorted(key, blocks * width + last, "right")
            runs = np.maximum(ends - starts[blocks], 0)
            z = np.repeat(starts[blocks] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            return z[z != p]

        def met(p: int, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Those of z near p, how near, and the distances of all z."""
            i = np.full(len(z), s + p)
            most, apart = most_apart(self.n[i], n[z], self.share), self.sketch.apart(i, s + z)
            ok = (apart <= most) & (~self.cross[i] | (self.own[i] != self.own[s + z]))
            return z[ok], apart[ok] / (most[ok] + 1.0), apart

        _, label = np.unique(self.comp[s:t], return_inverse=True)
        if not forest:
            largest = np.bincount(label).argmax()
            for p in np.flatnonzero(label != largest).tolist():
                z = reach(p)
                z, close, _ = met(p, z[(label[z] != label[p]) & ((z > p) | (label[z] == largest))])
                yield np.full(len(z), s + p), s + z, close
            return

        def joined(p: int, z: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The nearest of z for each label but p's; the labels become p's."""
            other = np.flatnonzero(label[z] != label[p])
            by = other[np.lexsort((z[other], close[other]))]
            found, at = np.unique(label[z[by]], return_index=True)
            if len(found):
                label[np.isin(label, found)] = label[p]
            return np.full(len(found), s + p), s + z[by[at]], close[by[at]]

        pivot = np.full(t - s, -1)
        answers: dict[int, np.ndarray] = {}
        for p in range(t - s):
            if pivot[p] < 0:
                pivot[p] = p
                z = reach(p)
                near, close, apart = met(p, z)
                fresh = near[pivot[near] < 0]
                if len(fresh):
                    pivot[fresh] = p
                    answers[p] = np.full(t - s, -1)
                    answers[p][z] = apart
                yield joined(p, near, close)
        largest = np.bincount(label).argmax()
        for p in np.flatnonzero((label != largest) & (pivot != np.arange(t - s))).tolist():
            if label[p] == largest:
                continue
            z = reach(p)
            z = z[label[z] != label[p]]
            known = answers[pivot[p]]
            far = (known[z] >= 0) & (np.abs(known[z] - known[p]) > most_apart(n[p], n[z], self.share)) & (self.sketch.words[s + z] == self.sketch.words[s + p]) & (self.sketch.words[s + pivot[p]] == self.sketch.words[s + p])
            near, close, _ = met(p, z[~far])
            yield joined(p, near, close)


_LIST_COLUMNS = ["list", "n", "pos", "node", "comp", "own", "cross", "sketch"]


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole lists from batches ordered by list."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        at = int(np.searchsorted(key, key[-1], "left"))
        if at:
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        elif held and held[-1].column(0)[-1].as_py() != key[-1]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    """Trees over the pairs that a task has seen so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, i: int) -> int:
        up, top = self.up, i
        while (above := up.setdefault(top, top)) != top:
            top = above
        while up[i] != top:
            up[i], i = top, up[i]
        return top

    def joins(self, x: int, y: int) -> bool:
        """Whether the pair joins two trees; if so they are one from now on."""
        a, b = self.root(x), self.root(y)
        self.up[max(a, b)] = min(a, b)
        return a != b


def candidates(entries: DataFrame, sketches: DataFrame, share: tuple[int, int], forest: bool) -> DataFrame:
    """(x, y): pairs of nodes in different components that share an index list and that sizes, positions and sketches allow to be linked;
    with forest, for each task only a spanning forest of these, the nearest first.

    entries: token, n, pos, node, comp; sketches: node, n, sketch.
    """
    parts = partitions(entries.sparkSession)
    lists = entries.withColumn("list", F.col("token")).withColumn("own", F.lit(0)).withColumn("cross", F.lit(False))
    long_lists = cut(entries.groupBy("token").count().where(F.col("count") > LONG).select("token", (F.floor(F.col("count") / LONG) + 2).cast("int").alias("cuts")))
    if not long_lists.isEmpty():
        lists = lists.join(long_lists, "token", "left").withColumn("own", F.when(F.col("cuts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")))
        lists = lists.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1))).withColumn("cross", F.col("with") != F.col("own"))
        pair = F.xxhash64("token", F.least("own", "with"), F.greatest("own", "with"))
        lists = lists.withColumn("list", F.when(F.col("cuts").isNull(), F.col("token")).otherwise(pair))
    order = ["list", "n", "pos", "node"]
    dealt = lists.join(sketches, ["node", "n"]).select(*_LIST_COLUMNS).repartition(parts, "list").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, held, m = _Forest(), [], 0

        def pairs() -> pa.RecordBatch:
            x, y, close = (np.concatenate([h[k] for h in held]) for k in range(3))
            held.clear()
            order = np.lexsort((y, x, close))
            x, y = x[order], y[order]
            _, first = np.unique(np.stack([x, y]), axis=1, return_index=True)
            first.sort()
            x, y = x[first], y[first]
            if forest:
                keep = np.array([trees.joins(a, b) for a, b in zip(x.tolist(), y.tolist())], bool)
                x, y = x[keep], y[keep]
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

        for table in _whole_lists(batches):
            lists = _Lists(table.combine_chunks(), share)
            for found in (lists.small(), lists.long(forest)):
                for i, j, close in found:
                    if len(i):
                        a, b = lists.node[i], lists.node[j]
                        own = a != b
                        held.append((np.minimum(a, b)[own], np.maximum(a, b)[own], close[own]))
                        m += len(i)
                        if m > HELD:
                            yield pairs()
                            m = 0
        if held:
            yield pairs()

    return dealt.mapInArrow(run, "x long, y long").distinct()


def pair_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of doc_ids (x, y) with their other columns and x_text and y_text; x and y may change places.

    The text of a pair's less used end goes to its other end, whose text is sent once for all its pairs.
    """
    ends = cut_table(pairs.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("uses")))
    few = ends.count() <= FEW_NODES  # then the texts of all other documents needn't be shuffled to be left out
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("node"), "text").join(F.broadcast(ends) if few else ends, "node")
    dealt = pairs
    for side in ("x", "y"):
        dealt = dealt.join(ends.select(F.col("node").alias(side), F.col("uses").alias(f"{side}_uses")), side)
    swap = F.col("x_uses") > F.col("y_uses")
    salts = lambda uses: F.when(uses > HEAVY, SALTS).otherwise(1)
    rest = [c for c in pairs.columns if c not in ("x", "y")]
    dealt = dealt.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"), *rest, F.greatest("x_uses", "y_uses").alias("__uses"))
    dealt = dealt.withColumn("__salt", F.pmod(F.xxhash64("x", "y"), salts(F.col("__uses"))).cast("int")).drop("__uses")
    dealt = dealt.join(texts.select(F.col("node").alias("x"), F.col("text").alias("x_text")), "x")
    hubs = texts.select(F.col("node").alias("y"), F.explode(F.sequence(F.lit(0), salts(F.col("uses")) - 1)).alias("__salt"), F.col("text").alias("y_text"))
    return dealt.join(hubs, ["y", "__salt"]).select("x", "y", *rest, "x_text", "y_text")


def verify(pairs: DataFrame, docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(x, y, shared, nx, ny) for pairs of doc_ids, x < y: sizes of the intersection and of both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x_text", "y_text"):
                u, a = _sets(part.select(["x_text"]).rename_columns(["text"]), k)
                (v, b), of = once(part.column(1), part.column(3), lambda t: unique_sets(*shingles(Words(t, lower=True), k)))
                shared = [len(np.intersect1d(u[a[i] : a[i + 1]], v[b[j] : b[j + 1]], assume_unique=True)) for i, j in enumerate(of.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared, pa.int64()), pa.array(np.diff(a)), pa.array(np.diff(b)[of])], names=["x", "y", "shared", "nx", "ny"])

    found = pair_texts(cut_table(pairs), docs).mapInArrow(run, "x long, y long, shared long, nx long, ny long")
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "shared", F.when(F.col("x") < F.col("y"), F.col("nx")).otherwise(F.col("ny")).alias("nx"), F.when(F.col("x") < F.col("y"), F.col("ny")).otherwise(F.col("nx")).alias("ny"))


def _linked(share: tuple[int, int]):
    return share[1] * F.col("shared") >= share[0] * (F.col("nx") + F.col("ny") - F.col("shared"))


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of links (x, y): the least node reachable.

    Parts of about EDGES links are reduced to trees by union and find.  Where a node has several roots, these
    are the links of the next round, until one part is left; then roots are followed upwards.  No task
    holds more than its part of the links, and each round leaves at most a link for each node and part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Forest()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                trees.joins(x, y)
        nodes = list(trees.up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([trees.root(i) for i in nodes], pa.int64())], names=["node", "root"])

    levels, edges = [], cut(links.select("x", "y"))
    while True:
        parts = -(-edges.count() // EDGES) or 1
        roots = edges.repartition(parts).mapInArrow(run, "node long, root long")
        if parts == 1:
            levels.append(cut(roots.withColumnRenamed("root", "comp")))
            break
        roots = cut(roots.withColumn("least", F.min("root").over(Window.partitionBy("node"))))
        levels.append(roots.groupBy("node").agg(F.min("least").alias("comp")))
        edges = cut(roots.where("root <> least").select(F.col("least").alias("x"), F.col("root").alias("y")).distinct())
    out = levels[0]
    for level in levels[1:]:
        above = level.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        out = out.join(above, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return cut(out)


def jaccard_components(docs: DataFrame, k: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    Words are runs of bytes outside \\x20 and \\x09-\\x0D, A-Z lower-cased; a document's set has its distinct
    shingles of k words, or all its words as one shingle if they are fewer.  Two documents are
    linked if share[1] * |intersection| >= share[0] * |union|; component_id is the smallest doc_id that
    links reach.  All links count: no list, group or partner is capped.

    Defined cases: a text that is null or has no words has an empty set, and its own doc_id as component; very long texts are read whole,
    each in a slice of its own; sets of equal size and overlap tie in nothing, as every link counts;
    rows that share a doc_id are one document, reached through any of its texts; a null doc_id gets the
    component of its text's equals, or null; other columns are not returned; an empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    signed = cut_table(signatures(docs, k, share))
    key = ["sig1", "sig2", "n_shingles"]
    sets = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = cut_table(sets.groupBy(*key).agg(F.min("doc_id").alias("node"), F.min_by(F.struct("prefix", "sketch"), "doc_id").alias("s")).select("*", "s.*", F.col("n_shingles").alias("n")).drop("s"))
    entries = cut_table(shared_entries(nodes, share))
    tested = _tested(candidates(entries.withColumn("comp", F.col("node")), nodes.select("node", "n", "sketch"), share, forest=True), docs, k, share)
    links = tested.where("linked").select("x", "y")
    if not tested.where("not linked").isEmpty():
        links = links.union(_read_again(entries, tested, docs, k, share))
    comps = components(links)
    labelled = signed.select("doc_id", *key).join(nodes.select(*key, "node"), key, "left").join(comps, "node", "left")
    return labelled.select("doc_id", "n_shingles", F.coalesce("comp", "node", "doc_id").alias("component_id"))


def _tested(pairs: DataFrame, docs: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """(x, y, linked); of documents with several texts any two may be linked."""
    return cut_table(verify(pairs, docs, k).groupBy("x", "y").agg(F.max(_linked(share)).alias("linked")))


def _read_again(entries: DataFrame, tested: DataFrame, docs: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Links across components among the nodes of trees that have a pair which isn't a link."""
    trees = components(tested.select("x", "y"))
    torn = tested.where("not linked").join(trees, F.col("x") == F.col("node")).select(F.col("comp").alias("tree")).distinct()
    comps = components(tested.where("linked").select("x", "y"))
    again = trees.join(torn, F.col("comp") == F.col("tree"), "left_semi").select("node").join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    again = cut_table(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = _sets(part, k)
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), parity_sketches(values, n, share, FINE)], names=["node", "n", "sketch"])

    few = again.count() <= FEW_NODES
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(F.broadcast(again) if few else again, "node").select("node", "text")
    fine = texts.mapInArrow(run, "node long, n long, sketch binary").distinct()
    found = candidates(entries.join(again, "node"), fine, share, forest=False)
    more = _tested(found.join(tested.select("x", "y"), ["x", "y"], "left_anti"), docs, k, share)
    return more.where("linked").select("x", "y")
