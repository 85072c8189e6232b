import random

import numpy as np

from larkspur.llm.topk import search

SCHEMA = "vec_id long, embedding array<float>, rank int, n int"


def brute(rows, queries, k=10):
    ok = [(i, [int(np.floor(1024 * np.float64(np.float32(c)))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, x in ok:
        if q in queries:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.random()]) for _ in range(rng.choice([8, 8, 8, 5]))]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], SCHEMA).repartition(3)
    got = search(df, df.where("vec_id % 20 = 0"), query_block=7, candidate_block=50)
    assert sorted(map(tuple, got.collect())) == brute(rows, set(range(0, 406, 20)))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 1), (1, [1.0], 1, 1), (2, [1.0], 1, 1)], SCHEMA)
    assert sorted(map(tuple, search(df, df.where("vec_id = 0")).collect())) == [(0, 1, 1, 1048576), (0, 2, 2, 1048576)]
    assert search(df.limit(0), df.limit(0)).count() == 0


def test_no_blocks_on_the_driver(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(8)], 1, 1) for i in range(200)], SCHEMA)
    got = search(df, df.where("vec_id % 5 = 0"), query_block=4, candidate_block=16)
    assert got.count() == 400
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan and "CartesianProduct" in plan
