"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from larkspur.llm.queries import oracle_sql, queries
from test_text_operators import WORD, brute_components, sample_docs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, source, len(t or "")) for i, t, lang, source, *_ in sample_docs()]
    return spark.createDataFrame([*rows, (None, "no id", "en", "b", 5), (None, "no id", "en", "b", 5)], SCHEMA)


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]


def test_language_stage_keeps_clean_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = cp.identify_languages(spark, rows, "")
    assert out.columns == cp.COLUMNS
    lost = {r.doc_id for r in rows.select("doc_id").collect()} - {r.doc_id for r in out.select("doc_id").collect()}
    assert len(lost) < 0.02 * 1000


def test_line_stage(spark, docs):
    out = cp.dedup_lines(spark, docs, "")
    assert out.columns == cp.COLUMNS and out.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def brute_near(rows):
    """Components at five words and a similarity of 0.8, as in the stage."""
    sets = {}
    for i, t, *_ in rows:
        ws = [w.lower() for w in WORD.findall((t or "").encode())]
        sets.setdefault(i, []).append({tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    ids, up = sorted(sets), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i for i in ids if root(i) == i}


def test_near_duplicate_stage(spark, docs):
    out = cp.drop_near_duplicates(spark, docs, "")
    assert out.columns == cp.COLUMNS
    kept = [r.doc_id for r in out.collect()]
    want = brute_near([r for r in docs.collect() if r.doc_id is not None])
    assert {i for i in kept if i is not None} == want and kept.count(None) == 1
    assert len(brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])) == docs.count() - 2


def test_near_duplicate_stage_keeps_one_row(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(7, " ".join(words)), (7, " ".join(words)), (None, near), (None, "a b c d e f g"), (None, "a b c d e f g h i j k"), (None, "A b c d e f g"), (9, "alone"), (20, ""), (21, ""), (None, "")]
    out = cp.drop_near_duplicates(spark, spark.createDataFrame([(i, t, "en", "b", len(t)) for i, t in rows], SCHEMA).repartition(3), "")
    assert sorted((r.doc_id or 0, r.text.lower()) for r in out.collect()) == [(0, "a b c d e f g"), (0, "a b c d e f g h i j k"), (7, " ".join(words)), (9, "alone"), (20, ""), (21, "")]


def test_mixing_stage_takes_what_the_mix_says(spark, docs):
    from larkspur.llm.mixing import mix

    out = cp.mix_sources(spark, docs, "")
    assert out.columns == cp.COLUMNS
    want = Counter()
    for r in mix(docs).collect():
        want[r.doc_id] += r.n_taken
    got = Counter(r.doc_id for r in out.collect())
    assert all(abs(got[i] - n) <= 2 for i, n in want.items()) and set(got) == {i for i, n in want.items() if n}


def test_run_and_empty(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_registered_queries():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(oracle_sql()) <= set(queries())
