import numpy as np
import pyspark.sql.functions as F
import pytest

from rankspark.llm import similar_vectors as V

SCHEMA = "article_id long, embedding array<float>, last_updated int"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: [(ids[j], s[r, j]) for j in sorted(range(len(ids)), key=lambda j: (-s[r, j], ids[j]))[:k]] for r, i in enumerate(ids)}


def clustered(rng, n=3000, d=64):
    x = rng.normal(size=(n, d))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, d)) * 0.25  # near copies of about 0.97
    x[: n // 3] += 2 * rng.normal(size=d)  # one area is denser
    return x * rng.uniform(0.01, 50, size=(n, 1))


@pytest.mark.parametrize("cell", [V.CELL, 500])
def test_recall(spark, cell):
    rng = np.random.default_rng(4)
    x = clustered(rng)
    ids = list(range(100, 3100))
    frame = make(spark, [(i, v.tolist(), 0) for i, v in zip(ids, x)])
    vectors = V.usable(frame, 64)
    want = brute(ids, x.astype(np.float32).astype(float), 5)
    pairs = {(i, j) for i, near in want.items() for j, c in near if c >= 0.9}
    got = {(r["id"], r["neighbour"]) for r in V.neighbours(vectors, 64, 5, min_cosine=0.9, cell=cell).collect()}
    assert len(pairs & got) >= 0.97 * len(pairs) > 500 and all(dict(want[i]).get(j, 0) >= 0.899 for i, j in got)
    every = {(r["id"], r["neighbour"]) for r in V.neighbours(vectors, 64, 5, every=50, cell=cell).collect()}
    all_ = {(i, j) for i, near in want.items() if i % 50 == 0 for j, _ in near}
    assert {i for i, _ in every} == {i for i in ids if i % 50 == 0} and len(every & all_) >= 0.95 * len(all_)


def test_copies_and_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 64))
    rows = [(1000 + k, v.tolist(), 0) for k, v in enumerate(x)]
    rows += [(k, x[0].tolist(), 0) for k in range(1, 41)]  # 40 copies of one vector besides its own row
    found = V.neighbours(V.usable(make(spark, rows), 64), 64, 5)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (-r["cosine"], r["neighbour"])):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert all(len(v) == 5 for v in got.values()) and len(got) == 240
    assert got[1] == [2, 3, 4, 5, 6] and got[3] == [1, 2, 4, 5, 6] and got[1000] == [1, 2, 3, 4, 5] and got[40] == [1, 2, 3, 4, 5]
    some = {(r["id"], r["neighbour"]) for r in V.neighbours(V.usable(make(spark, rows), 64), 64, 5, every=20).collect()}
    assert some == {(i, j) for i, near in got.items() if i % 20 == 0 for j in near}
    want = brute([r[0] for r in rows], np.array([r[1] for r in rows], np.float32).astype(float), 5)
    same = sum(len(set(got[i]) & {j for j, _ in want[i]}) for i in got if i >= 1001)
    assert same >= 0.95 * 199 * 5


def test_unusable_and_latest(spark):
    good, other = [1.0] * 64, [1.0] * 63 + [0.5]
    rows = [
        (1, good, 1), (1, other, 2), (2, good, 1), (2, good, 1), (3, None, 1), (4, [0.0] * 64, 1), (5, [float("nan")] + [1.0] * 63, 1),
        (6, [1.0] * 63, 1), (7, [float("inf")] + [1.0] * 63, 1), (8, [None] + [1.0] * 63, 1), (None, good, 1), (9, good, 1), (9, None, 5), (10, [1e-20] * 64, 1), (11, [1e30] * 64, 1),
    ]
    frame = make(spark, rows).withColumns({"id": F.lit("x"), "vector": F.lit(1), "cosine": F.lit(2)})
    use = {r["id"]: r["vector"] for r in V.usable(frame, 64).collect()}
    assert set(use) == {1, 2, 9, 10, 11} and use[1][-1] == 0.5
    found = V.neighbours(V.usable(frame, 64), 64, 5, min_cosine=0.9)
    assert {(r["article_id_a"], r["article_id_b"]) for r in V.neighbour_pairs(found, 0.9).collect()} == {(a, b) for a in use for b in use if a < b}


def test_empty_and_single(spark):
    for rows in ([], [(1, [1.0] * 64, 0)]):
        assert V.neighbours(V.usable(make(spark, rows), 64), 64).count() == 0


def test_chi_square():
    assert abs(V.chi_square_quantile(0.95, 2) - 5.991) < 1e-3 and abs(V.chi_square_quantile(0.9, 8) - 13.362) < 1e-3
