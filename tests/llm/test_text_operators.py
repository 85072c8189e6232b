"""Operators on texts against brute force, on small documents with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import katz, lang_id, packing
from larkspur.llm.jaccard_join import jaccard_components
from larkspur.llm.line_dedup import dedup_lines
from larkspur.llm.mixing import mix
from larkspur.llm.textkernel import Words, shingles, unique_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_lines long, score double, prefix string, block string"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def near(text, rng, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def sample_docs():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß", "日本語", "a\x00b", "Ünï", "don't", "3.14", "🙂"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line = "This line stands in many of the documents, again and again"
    texts = [None, "", " \t\r\n\x0b\x0c", "one", "One two", "a b c", "\n\n", "solo\n", text(20000), "z" * 30000]
    base = text(200)
    texts += [base] * 4 + [near(base, rng, e) for e in (1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9)]
    texts += [f"{line}\n{text(5)}\n  {line.upper()}\t\n{text(8)}" for _ in range(9)] + [line] * 3
    texts += [text(rng.randrange(1, 120)) for _ in range(60)]
    step = text(60)
    for _ in range(15):  # a chain whose ends aren't linked
        step = near(step, rng, 1)
        texts.append(step)
    rows = [(i * 3, t, ["en", "de", None][i % 3], [None, "b", "a", "é"][i % 4], 7, 0.5, "p", "q") for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = sample_docs()
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def test_words_and_shingles_against_regex():
    texts = [r[1] for r in sample_docs()]
    w = Words(pa.array(texts), lower=True)
    for i, t in enumerate(texts):
        own = range(w.first[i], w.first[i + 1])
        assert [w.data[w.start[k] : w.end[k]].tobytes() for k in own] == words(t)
    values, offsets = unique_sets(*shingles(w, 3))
    seen = {}
    for i, t in enumerate(texts):
        ws = words(t)
        want = {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)} if len(ws) >= 3 else {tuple(ws)} if ws else set()
        assert offsets[i + 1] - offsets[i] == len(want)
        key = values[offsets[i] : offsets[i + 1]].tobytes()
        assert seen.setdefault(key, want) == want


def brute_components(rows):
    sets = {}
    for r in rows:
        ws = words(r[1])
        s = {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)} if len(ws) >= 3 else {tuple(ws)} if ws else set()
        sets.setdefault(r[0], []).append(s)
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 90 * len(x | y) for x in sets[a] for y in sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((r[0], len(sets[r[0]][0]), root(r[0])) for r in rows)


def test_jaccard_components(docs):
    df, rows = docs
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute_components(rows)


def test_components_in_several_rounds(spark, monkeypatch):
    from larkspur.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "EDGES", 40)
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 150)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(180)]
    up = {i: i for i in range(401)}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    rng.shuffle(links)
    got = jaccard_join.components(spark.createDataFrame(links, "x long, y long").repartition(9)).collect()
    assert sorted(map(tuple, got)) == sorted((i, root(i)) for i in {x for p in links for x in p})


def test_jaccard_hot_group_and_outliers(spark):
    rng = random.Random(9)
    base = " ".join(f"b{i}" for i in range(150))
    rows = [(i, near(base, rng, rng.choice([0, 1, 1, 2, 3, 5, 7])), None, None, 0, 0.0, "", "") for i in range(160)]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("long, small, held, coarse", [(20, 4, 50, 8), (20_000, 3, 300_000, 1), (9, 48, 10, 2)])
def test_jaccard_in_parts(spark, monkeypatch, long, small, held, coarse):
    """Lists dealt over parts, pivots, many small forests, and sketches so coarse that trees are read again."""
    from larkspur.llm import jaccard_join

    for name, value in (("LONG", long), ("SMALL", small), ("HELD", held), ("COARSE", coarse), ("HEAVY", 5)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(small)
    rows = []
    for size in (60, 150, 151):
        base = " ".join(f"b{size}x{i}" for i in range(size))
        rows += [near(base, rng, rng.choice([0, 1, 2, 2, 3, 4, 5, 6])) for _ in range(70)]
    rows = [(i, t, None, None, 0, 0.0, "", "") for i, t in enumerate(rows)]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == brute_components(rows)


def test_sketches_never_exceed_the_difference():
    from larkspur.llm import jaccard_join

    rng = np.random.default_rng(4)
    sets = []
    for size in (20, 300, 310, 330, 2000, 2600):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(size) > p], rng.integers(0, 1 << 63, int(size * p)).astype(np.uint64)])) for p in (0.0, 0.02, 0.1, 0.5)]
    n = np.array([len(s) for s in sets])
    sketches = jaccard_join.Sketches(jaccard_join.parity_sketches(np.concatenate(sets), n, (80, 100), 8))
    i, j = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    got = sketches.apart(i, j)
    assert (got <= true).all() and (got[i == j] == 0).all() and (got[true > 3 * n[i]] > 0).all()


def test_packing(docs):
    df, rows = docs
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            piece = ids[s : s + 4096]
            want[r[0], k, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    out = packing.pack(df.select("doc_id", "text", "source")).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= math.ceil(sum(r.length for r in out) / 4096) + 1


def test_plan_against_best_fit_one_by_one():
    rng = random.Random(3)
    for _ in range(30):
        top = rng.choice([10, 64, 200])
        histogram = Counter(rng.randrange(1, top + 1) for _ in range(rng.randrange(1, 300)))
        runs = packing.plan(dict(histogram), top)
        fill, ranks = defaultdict(int), defaultdict(int)
        placed = defaultdict(list)
        for length, rank, n, first, offset in runs:
            assert rank == ranks[length]
            ranks[length] += n
            for k in range(n):
                placed[first + k].append((offset, length))
                fill[first + k] += length
        assert ranks == histogram
        for spans in placed.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= top
        rooms = []
        for length in sorted(histogram.elements(), reverse=True):
            fits = [r for r in rooms if r >= length]
            rooms.append(top - length) if not fits else rooms.__setitem__(rooms.index(min(fits)), min(fits) - length)
        assert len(placed) <= len(rooms)


def test_language_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba"]
    kinds = lang_id.Pieces(pieces)
    rng = np.random.default_rng(1)
    p = np.zeros((len(pieces) + 2, 2))
    p[: len(pieces)] = rng.random((len(pieces), 2))
    p[len(pieces)] = 1e-6
    texts = ["abab", "a", "", "bbb", "aébab" * 40, "ab" * 200]

    def brute(word, lang):
        word = "▁" + word
        f = [0.0] * (len(word) + 1)
        f[0], shift = 1.0, 0.0
        for e in range(1, len(word) + 1):
            f[e] = sum(f[s] * (p[pieces.index(word[s:e]), lang] if word[s:e] in pieces else 1e-6 if e - s == 1 else 0.0) for s in range(max(0, e - 3), e))
            if f[e] < 1e-100:
                f = [x * 1e100 for x in f]
                shift -= 100 * math.log(10)
        return math.log(f[-1]) + shift

    got = lang_id.forward(kinds, p, texts)
    want = [[brute(t, k) for k in range(2)] for t in texts]
    assert np.allclose(got, want)


def test_language_fit_against_brute_force(spark):
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba"]
    sample = [("abab ba\nab", "x"), ("b a\tabab", "x"), ("bab bab bab aba", "y"), ("ab" * 60, "y"), ("é ab", "z")]
    prior = [1 / (i + 100) for i in range(len(pieces))]
    prior = [x / sum(prior) for x in prior]

    def segmentations(unit):
        """(product of nothing, pieces) of all ways to cut a unit; an unknown code point stands alone."""
        if not unit:
            return [[]]
        heads = [p for p in pieces if unit.startswith(p)] + ([] if unit[0] in pieces else [unit[0]])
        return [[h, *rest] for h in heads for rest in segmentations(unit[len(h) :])]

    def brute(lang):
        p = dict(zip(pieces, prior))
        units = Counter(u for t, k in sample if k == lang for w in t.split() for u in lang_id.units([w]))
        for _ in range(2):
            counts = Counter()
            for u, n in units.items():
                if len(u) > 12:  # too many to list: by the pieces' places instead
                    f, b = [1.0] + [0.0] * len(u), [0.0] * len(u) + [1.0]
                    for e in range(1, len(u) + 1):
                        f[e] = sum(f[e - len(q)] * x for q, x in p.items() if u[:e].endswith(q) and len(q) <= e)
                    for e in range(len(u) - 1, -1, -1):
                        b[e] = sum(b[e + len(q)] * x for q, x in p.items() if u[e:].startswith(q))
                    for e in range(1, len(u) + 1):
                        for q, x in p.items():
                            if len(q) <= e and u[:e].endswith(q):
                                counts[q] += n * f[e - len(q)] * x * b[e] / f[-1]
                    continue
                ways = [(math.prod(p.get(q, 1e-6) for q in way), way) for way in segmentations(u)]
                for x, way in ways:
                    for q in way:
                        counts[q] += n * x / sum(w for w, _ in ways)
            smoothed = [counts[q] + lang_id.PRIOR_COUNT * x for q, x in zip(pieces, prior)]
            p = {q: x / sum(smoothed) for q, x in zip(pieces, smoothed)}
        return [p[q] for q in pieces]

    langs, p = lang_id.fit(spark.createDataFrame(sample, "text string, lang string").repartition(3), pieces, rounds=2)
    assert langs == ["x", "y", "z"] and (p[len(pieces)] == 1e-6).all() and (p[-1] == 0).all()
    assert np.allclose(p[: len(pieces)].T, [brute(x) for x in langs])


def test_language_with_few_long_rows(spark):
    """One row, far beyond the bound on code points, and words without spaces, are learnt from; no language is dropped."""
    rng = random.Random(3)
    speak = lambda syllables, n, gap: gap.join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(n))
    a, b, c = ["ba", "lo", "ti", "ru"], ["sk", "ve", "my", "no"], ["hu", "wa", "ki", "zo"]
    rows = [(i, speak(a, 50, " "), "aa") for i in range(40)] + [(100 + i, speak(b, 400, ""), "bb") for i in range(20)] + [(1000 + 7 * i, speak(c, 12_000, " "), "cc") for i in range(1)]
    rows += [(-1 - i, speak(x, 30, gap), None) for i, (x, gap) in enumerate([(a, " "), (b, ""), (c, " ")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang for r in lang_id.fit_sample(df, 30, 2_000).select("lang").distinct().collect()} == {"aa", "bb", "cc"}
    got = {r.doc_id: r.lang_pred for r in lang_id.detect(df, rows=30, chars=2_000).collect()}
    assert [got[-1 - i] for i in range(9)] == ["aa", "bb", "cc"] * 3


def test_language_accuracy_and_cases(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(None, "the and of", None), (-1, None, "en"), (-2, "", "en"), (-3, "123 !? 456", "de"), (-4, "é" * 5000, None)], rows.schema)
    out = lang_id.detect(rows.union(extra)).collect()
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id >= 0]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {-1, -2, -3}
    assert all(0 <= r.score <= 1 for r in out)


def brute_katz(rows):
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    texts = [[*words(r[1]), None] for r in rows]
    uni, bi, after = Counter(), Counter(), defaultdict(set)
    for t, h in zip(texts, held):
        if not h:
            uni.update(t)
            pairs = list(zip([None, *t], t))
            bi.update(pairs)
            for a, b in pairs:
                after[a].add(b)
    total = sum(uni.values())
    of = lambda c: [0.0, *[float(sum(v == r for v in c.values())) for r in range(1, 7)]]
    lower = katz.Unigrams(float(total), float(len(uni)), of(uni))
    d = katz.good_turing(of(bi))
    p1 = lambda w: float(lower.p(np.array([uni[w]]))[0])
    seen_of = Counter()
    for (a, _), n in bi.items():
        seen_of[a] += n

    def p2(a, b):
        n = seen_of[a]
        if not n:
            return p1(b)
        kept = sum(d[min(bi[a, x], 6)] * bi[a, x] for x in after[a])
        m = n + 1 if kept >= n else n
        if bi[a, b]:
            return d[min(bi[a, b], 6)] * bi[a, b] / m
        return (m - kept) / m / (1 - sum(p1(x) for x in after[a])) * p1(b)

    out = {}
    for r, t, h in zip(rows, texts, held):
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1))) for w in t)
        out[r[0], r[1]] = (h, len(t), sum(uni[w] > 0 for w in t), total, base, sum(math.log10(p2(a, b)) for a, b in zip([None, *t], t)))
    mass = {a: sum(p2(a, b) for b in uni) + p2(a, "never seen".encode()) for a in list(after)[:40]}
    return out, mass


def test_katz_against_brute_force(docs, monkeypatch):
    df, rows = docs
    for block, hot in ((16_000_000, 1000), (3000, 20)):  # the second: many blocks, and contexts dealt over parts
        monkeypatch.setattr(katz, "BLOCK_BYTES", block)
        monkeypatch.setattr(katz, "HOT", hot)
        out = katz.score(df.select("doc_id", "text", "block", "prefix")).collect()
        want, mass = brute_katz(rows)
        assert all(abs(m - 1) < 1e-9 for m in mass.values())
        assert len(out) == len(rows)
        text = dict((r[0], r[1]) for r in rows)
        for r in out:
            h, n, known, total, base, score = want[r.doc_id, text[r.doc_id]]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_line_dedup(docs):
    df, rows = docs
    holders = defaultdict(set)
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    for r in rows:
        for x in (r[1] or "").encode().split(b"\n"):
            if len(key(x).decode()) >= 40:
                holders[key(x)].add(r[0])
    want = Counter()
    for r in rows:
        lines = (r[1] or "").encode().split(b"\n")
        left = [x for x in lines if len(holders.get(key(x), ())) < 5 or r[0] == max(holders[key(x)])]
        want[r[0], len(lines), len(lines) - len(left), hashlib.sha256(b"\n".join(left)).hexdigest()] += 1
    out = dedup_lines(df).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out) == want
    assert sum(r.n_dropped for r in out) > 0
    assert set(df.columns) | {"n_dropped"} == set(dedup_lines(df).columns)


def test_mixing_takes_what_a_global_sort_takes(spark):
    """The rows taken, against one sorted list of all turns."""
    from larkspur.llm.common import unit_hash
    from pyspark.sql import functions as F

    rng = random.Random(31)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 9, 40])), rng.choice("aaaabbc") if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = {r.doc_id: r for r in mix(df).collect()}
    place = {r.doc_id: r.p for r in df.select("doc_id", unit_hash(F.lit(17), F.col("doc_id"), F.xxhash64("text")).alias("p")).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    turns = []
    for source in ["a", "b", "c", None]:
        line = sorted((i for i, _, s in rows if s == source), key=lambda i: place[i])
        target, so_far = out[line[0]].target, 0
        for turn in range(3):
            for i in line:
                so_far += size[i]
                if size[i] and (so_far - size[i]) / target < 1 - 1e-12:
                    turns.append((so_far / target, i, turn))
    left, want = sum(size.values()), Counter()
    for _, i, _ in sorted(turns):
        left -= size[i]
        if left < 0:
            break
        want[i] += size[i]
    got = Counter({i: r.taken for i, r in out.items() if r.taken})
    differ = [i for i in out if got[i] != want[i]]
    assert len(differ) <= 1, differ  # equal finish times of two sources at the cut may change places
    assert abs(sum(got.values()) - sum(size.values())) <= 80


def test_mixing(spark, docs):
    df, rows = docs
    out = mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], len(words(r[1]))) for r in rows)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mix(df.repartition(2)).collect()))
    size = Counter()
    for r in out:
        size[r.source] += r.size
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(size.values())), set(names)
    while True:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * rate for s in open_}
    taken, longest = Counter(), Counter()
    for r in out:
        assert math.isclose(r.target, target[r.source]) and r.source_size == size[r.source]
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in names)
    assert sum(taken.values()) <= sum(size.values())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_components(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert lang_id.detect(empty).count() == 0
    assert mix(empty).count() == 0
    assert dedup_lines(empty).count() == 0
    assert katz.score(empty).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d", "en", "s", 0, 0.0, "", ""), (None, "a b c d", "en", "s", 0, 0.0, "", ""), (4, "a b c d", None, None, 0, 0.0, "", "")], SCHEMA)
    assert sorted((r.doc_id or -1, r.component_id) for r in jaccard_components(df).collect()) == [(-1, 4), (-1, 4), (4, 4)]
    for f in (packing.pack, lang_id.detect, mix, dedup_lines, katz.score):
        assert f(df).count() == 3
