import json

import numpy as np
import pyspark.sql.functions as F
import pytest

from rankspark import sinks
from rankspark.operators import cache as C
from rankspark.operators import freshness as P
from rankspark.operators import label as L
from rankspark.operators import metrics as M
from rankspark.operators import model as H
from rankspark.operators import select as R
from rankspark.operators import splits as D
from rankspark.operators import writes as U
from rankspark.operators.encode import HashingEncoder, encoded, mean_pool
from rankspark.schema import RELATIONS, asserted, valid, violations
from rankspark.sources import files

AS_OF = "2024-02-01 00:00:00"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


# --- readers ---


@pytest.mark.parametrize("k", [0, 1, 5, 6, 100])
def test_first_and_skip_are_complementary(spark, k):
    rows = spark.createDataFrame([(i,) for i in (9, 4, 7, 1, 3)], "article_id long")
    a, b = rows_of(R.first_k(rows, k)), rows_of(R.skip_k(rows, k))
    assert sorted(a + b) == [(1,), (3,), (4,), (7,), (9,)] and not set(a) & set(b) and len(a) == min(k, 5)


def entries(spark, *rows):
    base = {"id": 1, "feed_id": 1, "title": "t", "content": "c", "url": "u", "author": None, "published_at": "2024-01-31", "changed_at": None, "status": "unread", "vote": 0, "starred": False, "score": 0, "tags": None}
    made = [tuple((base | r).values()) for r in rows]
    text = RELATIONS["entries"].columns.replace("timestamp_ntz", "string")
    df = spark.createDataFrame(made, text)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("published_at", "changed_at")})


def feeds(spark):
    return spark.createDataFrame([(1, "one")], "id long, title string")


def test_latest_state_and_missing_feed(spark):
    df = entries(
        spark,
        {"id": 1, "status": "unread", "changed_at": None},
        {"id": 1, "status": "read", "changed_at": "2024-01-02"},
        {"id": 1, "status": "removed", "changed_at": "2024-01-01"},
        {"id": 2, "feed_id": 9},
        {"id": 3},
        {"id": 3},
    )
    rows = R.articles(R.current_entries(df), feeds(spark))
    assert rows_of(rows, "article_id", "status") == [(1, "read"), (3, "unread")]
    assert rows.first()["tags"] == []


def test_clashing_columns_stay_behind(spark):
    df = entries(spark, {"id": 1}).withColumns({"feed_name": F.lit("x"), "article_id": F.lit("y"), "_best": F.lit(1)})
    assert rows_of(R.articles(df, feeds(spark)), "article_id", "feed_name") == [(1, "one")]


def test_windows_and_three_valued_logic(spark):
    df = entries(
        spark,
        {"id": 1, "published_at": "2023-12-23"},  # exactly 40 days old: in both halves
        {"id": 2, "vote": None},
        {"id": 3, "starred": None},
        {"id": 4, "vote": -1},
        {"id": 5, "published_at": "2023-02-01"},  # exactly 365 days old
        {"id": 6, "published_at": "2023-01-31"},
        {"id": 7, "published_at": "2024-02-10"},  # after the clock
    )
    rows = R.articles(df, feeds(spark))
    assert rows_of(R.active_set(rows, AS_OF), "article_id") == [(1,), (1,), (5,), (7,)]
    assert rows_of(R.bad(rows, AS_OF), "article_id") == [(4,)]


def test_time_sensitivity_is_one_row(spark):
    scores = spark.sql("select * from values (1L, 2, timestamp_ntz'2024-01-01'), (1L, 5, timestamp_ntz'2024-01-02') t(article_id, score, last_updated)")
    assert rows_of(R.articles(entries(spark, {"id": 1}), feeds(spark), scores), "time_sensitivity_score") == [(5,)]


def test_missing_by_composite_key(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "article_id long")
    known = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a")], "article_id long, model_key string")
    assert rows_of(R.missing(rows, known, model_key="a")) == [(2,), (3,)]


def test_tags(spark):
    tags = spark.createDataFrame([(1, 1, "0-urgency"), (2, 1, "1-urgency"), (3, 2, "0-urgency")], "id long, user_id int, title string")
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (9, 1)], "entry_id long, user_tag_id long")
    rows = R.articles(entries(spark, {"id": 1, "status": "read"}, {"id": 2}), feeds(spark))
    both = R.tagged(rows, links, tags)
    assert rows_of(both, "article_id", "urgency_label") == [(1, 0), (1, 1)]
    assert rows_of(R.conflicting(both)) == [(1,)]


# --- writes ---


def test_update_last_wins_and_unmatched_is_ignored(spark):
    now = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id long, score int")
    new = spark.createDataFrame([(1, 5, 0), (1, 7, 1), (9, 1, 2), (2, None, 0), (None, 3, 0)], "id long, score int, ordinal int")
    assert sorted(map(tuple, U.update(now, new, "id", "score").collect()), key=repr) == [(1, 7), (2, None), (3, None)]


def test_upsert(spark):
    key = "article_id long, model_key string, urgency_score double"
    now = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2)], key)
    new = spark.createDataFrame([(1, "a", 0.3, 0), (1, "a", 0.4, 1), (2, "a", 0.5, 0)], key + ", ordinal int")
    assert rows_of(U.upsert_urgency(now, new)) == [(1, "a", 0.4), (1, "b", 0.2), (2, "a", 0.5)]
    assert rows_of(U.upsert_urgency(now, new.limit(0))) == rows_of(now)
    assert rows_of(U.upsert_urgency(now.limit(0), new)) == [(1, "a", 0.4), (2, "a", 0.5)]


def test_assign_tags_first_wins_and_keeps_what_is_there(spark):
    tags = spark.createDataFrame([(1, 1, "0-urgency"), (2, 1, "1-urgency"), (3, 1, "other"), (4, 2, "0-urgency")], "id long, user_id int, title string")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "entry_id long, user_tag_id long")
    new = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, 0, 1), (3, 0, 0), (None, 0, 0)], "article_id long, label int, ordinal int")
    assert rows_of(U.assign_tags(links, tags, new), "entry_id", "user_tag_id") == [(2, 2), (3, 1)]


def test_ensure_tags(spark):
    tags = spark.createDataFrame([(5, 1, "0-urgency")], "id long, user_id int, title string")
    assert rows_of(U.ensure_tags(tags, 1), "user_id", "title") == [(1, "0-urgency"), (1, "1-urgency")]
    assert U.ensure_tags(U.ensure_tags(tags, 1), 1).count() == 2
    assert U.ensure_tags(tags.limit(0), 1).count() == 2


def test_append_unique(spark):
    now = spark.createDataFrame([(1, 0)], "article_id long, label int")
    assert U.append_unique(now, spark.createDataFrame([(2, 1)], now.schema), ["article_id"]).count() == 2
    for bad in ([(1, 1)], [(3, 0), (3, 0)]):
        with pytest.raises(Exception, match="duplicate key"):
            U.append_unique(now, spark.createDataFrame(bad, now.schema), ["article_id"]).collect()


def test_insert_missing_and_cascade(spark):
    links = spark.createDataFrame([(1, 1), (2, 1)], "entry_id long, user_tag_id long")
    new = spark.createDataFrame([(1, 1), (3, 1), (3, 1)], links.schema)
    assert rows_of(U.insert_missing(links, new, ["entry_id", "user_tag_id"])) == [(3, 1)]
    assert rows_of(U.cascade(links, spark.createDataFrame([(2,)], "id long"), "entry_id")) == [(2, 1)]


def test_checks(spark):
    rows = spark.createDataFrame([(1, 0, "low"), (2, 3, "Low"), (3, 5, None), (4, None, "high")], "article_id long, score int, confidence string")
    assert rows_of(violations(rows, "time_sensitivity")) == [("confidence", 1), ("score", 1)]
    assert rows_of(valid(rows, "time_sensitivity"), "article_id") == [(3,), (4,)]
    with pytest.raises(Exception, match="broken check"):
        asserted(rows, "time_sensitivity").collect()
    assert asserted(valid(rows, "time_sensitivity"), "time_sensitivity").count() == 2


def test_swap_reads_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.swap(spark.range(3), path)
    sinks.swap(spark.read.parquet(path).where("id > 0"), path)
    assert rows_of(spark.read.parquet(path)) == [(1,), (2,)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_buckets_that_nothing_changes_are_left_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(200).select("id", F.lit(0).alias("score"))
    sinks.write_buckets(rows, path, ["id"], 8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    changes = spark.createDataFrame([(5, 50, 0), (5, 51, 1), (999, 1, 0)], "id long, score int, ordinal int")
    touched = sinks.update_buckets(path, changes, ["id"], 8, lambda old, new: U.update(old, new, "id", "score"))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert 1 <= len(touched) <= 2
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if int(p.parent.name.split("=")[1]) in touched}
    assert rows_of(spark.read.parquet(path), "id", "score") == [(k, 51 if k == 5 else 0) for k in range(200)]
    assert sinks.update_buckets(path, changes.limit(0), ["id"], 8, lambda old, new: old) == []


def test_snapshots_of_an_encoder(spark, tmp_path):
    from rankspark.operators.encode import READY, ensured_snapshot, has_snapshot

    calls, path = [], str(tmp_path / "encoder")

    def fetch(to):
        calls.append(to)
        for name in ("config.json", "vocab.json", "part-1.safetensors"):
            (tmp_path / "encoder" / name).write_text("{}")

    assert not has_snapshot(path)
    for _ in range(2):
        assert ensured_snapshot(path, fetch) == path
    assert calls == [path] and has_snapshot(path) and (tmp_path / "encoder" / READY).exists()
    # one that is usable is marked without a fetch, one that broke off is made again
    (tmp_path / "encoder" / READY).unlink()
    ensured_snapshot(path, fetch)
    assert len(calls) == 1
    (tmp_path / "encoder" / READY).unlink()
    (tmp_path / "encoder" / "vocab.json").unlink()
    ensured_snapshot(path, fetch)
    assert len(calls) == 2


@pytest.mark.parametrize("intervals, settled", [(1024, 100_000), (3, 2), (2, 0)])
def test_newest_share_equals_a_sort(spark, monkeypatch, intervals, settled):
    monkeypatch.setattr(D, "INTERVALS", intervals)
    monkeypatch.setattr(D, "SETTLED", settled)
    rng = np.random.default_rng(3)
    times = ["1969-12-31 23:59:58", "1970-01-01 00:00:00.000001", "1970-01-01", "2024-01-01 10:00:00", "2024-01-01 10:00:00.5", "1901-05-05", None]
    made = [(int(k) - 30, times[int(rng.integers(len(times)))]) for k in rng.permutation(70)]
    rows = spark.createDataFrame(made, "id long, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    order = sorted(rows.collect(), key=lambda r: (r["at"] is not None, str(r["at"]) if r["at"] else "", r["id"]), reverse=True)
    for share in (0.0, 0.01, 0.2, 0.5, 0.77, 0.95, 1.0):
        got = D.newest_share(rows, share, "at", "id")
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in order[: int(70 * share)])
        assert got.columns == rows.columns


def test_stored_tables_are_cleaned_by_age(spark):
    from rankspark.sources.shared import clean_stored, stored

    df, path = stored(spark.range(3), "some")
    assert clean_stored(spark, 24) == 0 and df.count() == 3
    assert clean_stored(spark, 0) >= 1 and not files.exists(path)


def test_history(spark, tmp_path):
    path = str(tmp_path / "h.json")
    assert sinks.read_history(path) == []
    sinks.append_history(path, {"a": 1})
    (tmp_path / "broken.json").write_text("{")
    sinks.append_history(str(tmp_path / "broken.json"), {"b": 2})
    sinks.append_history(path, {"a": 2})
    assert sinks.read_history(path) == [{"a": 1}, {"a": 2}]
    assert sinks.read_history(str(tmp_path / "broken.json")) == [{"b": 2}]


# --- cache and encoder ---


def test_cache_states(spark):
    key = {"model_name": "m", "max_length": 8, "text_prep_mode": "x", "prep_version": 1}
    make = lambda: HashingEncoder(4)
    texts = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "article_id long, text string")
    cache = spark.createDataFrame([], RELATIONS["relevance_embeddings"].columns)
    rows, fresh = C.encode_with_cache(texts, cache, key, make, 4, AS_OF)
    assert rows_of(rows, "article_id", "cache_state") == [(1, "miss"), (2, "miss"), (3, "miss")]
    cache = C.updated_cache(cache, fresh)
    assert rows_of(cache, "article_id") == [(1,), (2,)]
    changed = spark.createDataFrame([(1, "a b"), (2, "other")], "article_id long, text string")
    again, _ = C.encode_with_cache(changed, cache, key, make, 4, AS_OF)
    assert rows_of(again, "article_id", "cache_state") == [(1, "hit"), (2, "stale")]
    assert tuple(C.cache_counts(again).first()) == (1, 1, 1)
    longer = C.with_cache_state(changed, cache, key, 8)
    assert rows_of(longer, "article_id", "cache_state") == [(1, "stale"), (2, "stale")]
    # warm and cold give the same vectors
    cold = {r["article_id"]: r["embedding"] for r in rows.collect()}
    assert [r["embedding"] for r in again.collect() if r["article_id"] == 1] == [cold[1]]


def test_encoder(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in encoded(rows, HashingEncoder).collect()}
    assert np.isclose(np.linalg.norm(got[1]), 1) and not any(got[2]) and not any(got[3])
    tokens = np.array([[[1.0, 0.0], [3.0, 2.0], [9.0, 9.0]]])
    assert mean_pool(tokens, np.array([[1, 1, 0]])).tolist() == [[2.0, 1.0]]


# --- models and metrics ---


def newton(x, y, w, c):
    x = np.hstack([x, np.ones((len(x), 1))])
    b, reg = np.zeros(x.shape[1]), np.r_[np.ones(x.shape[1] - 1), 0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (c * w * p * (1 - p))[:, None]).T @ x + np.diag(reg), c * x.T @ (w * (p - y)) + reg * b)
    return 1 / (1 + np.exp(-x @ b))


def test_fit_matches_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    w = np.where(rng.random(200) < 0.3, 3.0, 1.0)
    rows = spark.createDataFrame([(k, x[k].tolist(), int(y[k]), float(w[k]), "old") for k in range(200)], "id int, embedding array<double>, label int, weight double, prediction string")
    got = H.probabilities(H.fit(rows, c=5.0), rows).orderBy("id").select("p").toPandas()["p"].to_numpy()
    assert np.abs(got - newton(x, y, w, 5.0)).max() < 1e-5


def test_fit_needs_both_classes(spark):
    rows = spark.createDataFrame([([1.0], 1, 1.0)], "embedding array<double>, label int, weight double")
    with pytest.raises(RuntimeError):
        H.fit(rows, 1.0)


def test_weights(spark):
    rows = spark.createDataFrame([(1, 1, 1, False), (2, 0, -1, True), (3, 0, None, None), (4, 0, 0, False)], "article_id long, label int, vote int, starred boolean")
    assert [r[0] for r in H.sample_weights(rows).orderBy("article_id").select("weight").collect()] == [3.0, 3.0, 1.0, 1.0]
    assert rows_of(H.balanced_weights(rows.withColumn("weight", F.lit("x"))), "label", "weight") == [(0, 4 / 6), (0, 4 / 6), (0, 4 / 6), (1, 2.0)]


def metrics_by_loop(y, p):
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp, n = sum(a >= t for a in pos), sum(a >= t for a in p)
        ap += (tp / len(pos) - last) * tp / n
        last = tp / len(pos)
    return auc, ap


def test_metrics(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300).tolist()
    p = np.round(np.clip(rng.random(300) * 0.7 + 0.3 * np.array(y) * rng.random(300), 0, 1), 2).tolist()
    p[:2] = [0.0, 1.0]
    row = M.binary_metrics(spark.createDataFrame(list(zip(y, p)), "label int, p double")).first()
    auc, ap = metrics_by_loop(y, p)
    assert np.allclose([row["roc_auc"], row["average_precision"]], [auc, ap], atol=1e-12)
    up = [a >= 0.5 for a in p]
    assert np.isclose(row["accuracy"], np.mean([a == b for a, b in zip(up, y)]))
    assert np.isclose(row["precision"], sum(a and b for a, b in zip(up, y)) / sum(up))
    q = np.clip(p, 1e-7, 1 - 1e-7)
    assert np.isclose(row["log_loss"], -np.mean(np.where(np.array(y) == 1, np.log(q), np.log(1 - q))))


def test_metrics_of_one_class_and_none(spark):
    one = M.binary_metrics(spark.createDataFrame([(0, 0.2), (0, 0.3), (None, 0.1)], "label int, p double")).first()
    assert one["roc_auc"] is None and one["average_precision"] is None and one["precision"] == 0 and one["accuracy"] == 1
    assert set(M.binary_metrics(spark.createDataFrame([], "label int, p double")).first()) == {None}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5])
def test_stratified_guards(spark, n):
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "article_id long, label int")
    if n == 0:
        assert D.stratified_holdout(rows, 0).count() == 0
    elif n == 3:
        assert D.stratified_holdout(rows, 3).count() == 3
    else:
        with pytest.raises(RuntimeError):
            D.stratified_holdout(rows, n)
    with pytest.raises(RuntimeError):
        D.stratified_holdout(rows.where("article_id > 1"), 2)


def test_quotas():
    assert D.quotas({0: 70, 1: 30}, 10) == {0: 7, 1: 3}
    assert D.quotas({0: 5, 1: 5}, 3) == {0: 2, 1: 1}
    assert sum(D.quotas({0: 13, 1: 999}, 17).values()) == 17


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([([1.0], 1, 1.0), ([0.0], 0, 1.0)], "embedding array<double>, label int, weight double")
    model = H.fit(rows, 1.0)
    for date, n in (("2024-01-01", 99), ("2024-01-01", 100), ("2023-12-31", 500)):
        H.save(model, H.artifact_path(str(tmp_path), "rel", date, good=n, bad=1), c=1.0)
    assert H.latest_artifact(str(tmp_path), "rel", clean_old=False).endswith("2024-01-01_100_good_1_bad") and len(H.artifacts(str(tmp_path), "rel")) == 3
    loaded, meta = H.load(H.latest_artifact(str(tmp_path), "rel"))
    assert meta == {"c": 1.0} and np.allclose(loaded.coefficients.toArray(), model.coefficients.toArray())
    assert len(H.artifacts(str(tmp_path), "rel")) == 1
    with pytest.raises(FileNotFoundError):
        H.latest_artifact(str(tmp_path), "other")
    (tmp_path / "checkpoint-5").mkdir()
    assert H.clean_checkpoints(str(tmp_path)) == 1


# --- labels ---

GOOD = {"score": 1, "explanation": "x"}


@pytest.mark.parametrize(
    "answer, ok",
    [
        (json.dumps(GOOD), True),
        ("```json\n" + json.dumps(GOOD) + "\n```", True),
        ("  " + json.dumps(GOOD) + "\n", True),
        ('{"score": "1", "explanation": "x"}', False),
        ('{"score": 7, "explanation": "x"}', False),
        ('{"score": 1}', False),
        ('{"score": 1, "explanation": null}', False),
        ('{"score": 1, "explanation": 5}', False),
        ("{'score': 1, 'explanation': 'x'}", False),
        (json.dumps(GOOD) + " Hope this helps.", False),
        ('{"score": 1, "explanation": "x",}', False),
        ("no json", False),
        ("", False),
        (None, False),
    ],
)
def test_answers_are_parsed_strictly(spark, answer, ok):
    rows = L.parsed(spark.createDataFrame([(1, answer)], "article_id long, answer string"), (0, 1))
    assert rows.first()["ok"] is ok
    assert (L.accepted(rows).count(), L.rejected(rows).count()) == (int(ok), int(not ok))


def test_keywords(spark):
    rows = spark.createDataFrame([("Breaking: live REPORTS",), ("who wins",), ("a policy of opinion",), ("alive",), ("",)], "t string")
    assert [r[0] for r in rows.select(L.keyword_score(F.col("t"))).collect()] == [5, 4, 3, 1, 1]
    prompts = [L.SCALE_PROMPT.replace("{title}", t[0]).replace("{content}", "") for t in rows.collect()]
    assert [json.loads(a)["score"] for a in L.keyword_labeller()(prompts)] == [5, 4, 3, 1, 1]


# --- freshness ---


def test_freshness(spark):
    row = spark.range(1).select(P.bucket_probabilities([F.lit(x) for x in (0.9, 0.5, 0.7, 0.2, 0.1)]).alias("p"), F.lit(3).alias("bucket"), F.lit(3).alias("guess"))
    assert np.allclose(row.first()["p"], [0.1, 0.2, 0.2, 0.3, 0.1, 0.1])
    assert np.isclose(row.select(P.expected_lifetime(F.col("p"))).first()[0], np.dot([0.1, 0.2, 0.2, 0.3, 0.1, 0.1], P.LIFETIMES))
    cdf = np.cumsum([0.1, 0.2, 0.2, 0.3, 0.1, 0.1])[:5]
    assert np.isclose(P.ranked_probability_score(row).first()["rps"], np.mean((cdf - np.array([0, 0, 1, 1, 1])) ** 2))
    pairs = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (1, 3)], "bucket int, guess int")
    assert np.isclose(P.macro_f1(pairs).first()[0], np.mean([2 / 3, 1, 2 / 3]))
    assert P.quadratic_kappa(pairs).first()[0] < 1 and P.quadratic_kappa(row).first()[0] is None
    assert tuple(P.fingerprint(pairs).first()) == tuple(P.fingerprint(pairs.orderBy("guess")).first()) != tuple(P.fingerprint(pairs.limit(3)).first())
    labels = spark.createDataFrame([(1, 2, True), (1, 3, False), (2, 1, False), (2, 2, False), (3, 4, True), (3, 4, True)], "article_id long, bucket int, reviewed boolean")
    assert rows_of(P.reviewed_labels(labels)) == [(1, 2), (3, 4)]


def test_fingerprint_of_many_rows(spark):
    from hashlib import md5, sha256

    n = 100_000
    texts = [md5(f"{k}".encode()).hexdigest() for k in range(n)]
    both = 0
    for t in texts:
        both ^= int(t[12:24], 16)
    total = sum(int(t[:12], 16) for t in texts)
    assert total >= 1 << 63
    assert tuple(P.fingerprint(spark.range(n)).first()) == (n, sha256(f"{n}|{total}|{both}".encode()).hexdigest())


def test_freshness_heads_follow_the_buckets(spark):
    rng = np.random.default_rng(8)
    made = [([float(b) - 3.5, float(rng.normal())], b) for b in rng.integers(1, 7, 400).tolist()]
    rows = spark.createDataFrame([*made, (None, 3)], "embedding array<double>, bucket int")
    heads = P.fit_heads(rows.where("embedding is not null"))
    assert len(heads) == 5 and all(h.intercept == 0 for h in heads)
    got = P.predicted(heads, rows).collect()
    assert all((r["buckets"] is None) == (r["embedding"] is None) for r in got)
    sums = [sum(r["buckets"]) for r in got if r["buckets"]]
    assert np.allclose(sums, 1)
    mean = {b: np.mean([np.dot(r["buckets"], range(1, 7)) for r in got if r["buckets"] and r["bucket"] == b]) for b in range(1, 7)}
    assert all(mean[b] < mean[b + 1] for b in range(1, 6))


def test_evaluation_folders_go(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "eval_old").mkdir()
    (tmp_path / "kept").mkdir()
    assert H.clean_evaluations(root) == 1
    with pytest.raises(KeyError), H.evaluation_folder(root) as path:
        assert files.exists(path)
        raise KeyError
    assert files.names(root) == ["kept"]
