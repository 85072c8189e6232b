import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from larkspur.llm.fingerprint import edited_fingerprints, fingerprint

SCHEMA = "doc_id long, text string, part int, place int, next string"


def jaccard(a, b):
    x, y = (Counter(re.findall(r"[^ \t-\r]+", t)) for t in (a, b))
    both = sum((x | y).values())
    return sum((x & y).values()) / both if both else 1.0


def cases():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(n))
    rows = [(i, text(rng.randrange(1, 120))) for i in range(0, 300, 2)]
    rows += [(301, None), (303, ""), (305, " \n\t"), (307, "é🙂 日本 x" * 50), (309, text(9000)), (None, "null id"), (None, "null id too"), (10, "again"), (10, "again"), (10, None)]
    return rows


def test_edited_fingerprints(spark):
    rows = cases()
    out = edited_fingerprints(spark.createDataFrame([(i, t, 1, 2, "n") for i, t in rows], SCHEMA).repartition(3)).collect()
    order = sorted(rows, key=lambda r: (-(-(1 << 63) if r[0] is None else r[0]), (r[1] or "").encode()))
    want, near, texts = Counter(), [], {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want[i, len(t), sha] += 1
        near.append((i, sha, jaccard(t, edited), jaccard(t, after)))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    by = {(r.doc_id, r.edited_sha256): r for r in out}
    off = [(by[i, sha].near_edited - e, by[i, sha].near_next - n) for i, sha, e, n in near]
    for k in (0, 1):  # unbiased, and no further off than 48 draws allow
        assert abs(sum(x[k] for x in off)) / len(off) < 0.02
        assert max(abs(x[k]) for x in off) < 0.35
    assert all(len(r.fingerprint) == len(out[0].fingerprint) for r in out)


def test_equal_texts_and_single_rows(spark):
    df = spark.createDataFrame([(1, "a b b c"), (2, "a b b c"), (3, "c b a b"), (4, ""), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint(df).collect()}
    assert got[1] == got[2] == got[3] != got[4] == got[5]
    one = edited_fingerprints(df.where("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    assert edited_fingerprints(df.limit(0)).count() == 0
    assert df.select(F.lit(1)).count() == 5
