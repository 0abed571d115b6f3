import numpy as np
import pyspark.sql.functions as F
import pytest

from rankspark.llm import mixing as M
from rankspark.sources import table


def test_flight_keeps_both_sums():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        p, t = rng.random(500), rng.integers(1, 5000, 500)
        q = M.flight(p, t, rng)
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert np.isclose(q.sum(), p.sum()) and np.isclose((q * t).sum(), (p * t).sum())


def test_flight_keeps_expectations():
    p, t = np.array([0.2, 0.5, 0.7, 0.6, 0.3, 0.9]), np.array([10, 400, 33, 33, 7, 120])
    mean = np.mean([M.flight(p, t, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_landing_comes_closest():
    q = M.landing(np.array([1.0, 0.5, 0.5, 0.0]), np.array([7, 10, 4, 3]))
    assert q.tolist() in ([1.0, 1.0, 0.0, 0.0], [1.0, 0.0, 1.0, 0.0])
    assert M.landing(np.array([1.0, 0.0]), np.array([1, 2])).tolist() == [1.0, 0.0]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_shares(spark, data, sf):
    d = data.replace("0.001", sf)
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    chosen, report = M.mix(documents, targets)
    rows = {r["source"]: r for r in report.collect()}
    assert len(rows) == targets.count() and chosen.count() == chosen.select("doc_id").distinct().count()
    got = {r["source"]: (r["t"], r["m"]) for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("t"), F.max("uses").alias("m")).collect()}
    for name, r in rows.items():
        assert got.get(name, (0, 0))[0] == r["tokens"] and got.get(name, (0, 0))[1] <= r["max_repeats"]
        if r["reaches_target"]:
            # few documents can't come closer than half of a large one
            large = chosen.where(F.col("source") == name).agg(F.max("tokens")).first()[0]
            assert abs(r["tokens"] - r["target_tokens"]) <= (large / 2 if r["documents"] < 20 else 0.01 * r["target_tokens"])
        else:
            assert r["tokens"] == r["available"] * r["max_repeats"] < r["target_tokens"]
    assert not rows["unheard-of-000"]["reaches_target"] and any(r["reaches_target"] for r in rows.values())
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, M.mix(documents, targets)[0].collect()))


def test_edges(spark):
    rows = [(k, f"word {k} " * (1 + k % 7), "a") for k in range(300)] + [(1000 + k, "some text here", "b") for k in range(10)]
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, "x", None), (2003, "x", "unlisted"), (None, "x", "a"), (2004, "text " * 20_000, "c"), (5, "again", "b")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"tokens": F.lit(1), "p": F.lit("x"), "uses": F.lit(3)})
    targets = spark.createDataFrame([("a", 0.1, 1), ("b", 0.5, 3), ("c", None, None), ("d", 0.4, 2), (None, 0.1, 1), ("a", 0.05, 1)], "source string, target_share double, max_repeats int").withColumn("n", F.lit(1))
    chosen, report = M.mix(documents, targets)
    r = {x["source"]: x for x in report.collect()}
    assert set(r) == {"a", "b", "c", "d"} and r["a"]["target_share"] == 0.1
    assert not r["b"]["reaches_target"] and not r["d"]["reaches_target"] and r["c"]["tokens"] == 0
    assert chosen.where("source = 'b' and uses <> 3").count() == 0
    assert chosen.where("doc_id >= 2000").count() == 0
    for empty in (M.mix(documents.limit(0), targets), M.mix(documents, targets.limit(0))):
        assert empty[0].count() == 0
    assert M.mix(documents.limit(0), targets)[1].count() == 4


def test_flight_in_rounds(spark, monkeypatch):
    """Chunks so small that what they leave takes several more rounds."""
    monkeypatch.setattr(M, "CHUNK", 40)
    rng = np.random.default_rng(2)
    rows = [(k, "word " * int(rng.integers(1, 60)), "a" if k % 3 else "b") for k in range(6000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 4)], "source string, target_share double, max_repeats int")
    chosen, report = M.mix(documents, targets)
    for r in report.collect():
        assert r["reaches_target"] and abs(r["tokens"] - r["target_tokens"]) <= 60
    assert chosen.count() == chosen.select("doc_id").distinct().count()
