import functools
import json

import pyspark.sql.functions as F
import pytest

from rankspark.config import Config
from rankspark.operators.encode import HashingEncoder
from rankspark.operators import label as L
from rankspark.operators import model as H
from rankspark.plans import commands as C
from rankspark.plans import migrations as M
from rankspark.plans import pipelines as P
from rankspark.schema import violations
from rankspark.sources import register, sql, table
from rankspark.streaming import labels as S

AS_OF = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def tables(spark, data):
    t = lambda name: table(spark, data, name)
    return P.Tables(*map(t, ("entries", "feeds", "time_sensitivity", "urgency_inference", "relevance_embeddings", "user_tags", "entry_user_tags")))


make = functools.partial(HashingEncoder, 16)


def _stand_in():
    # nested, so that workers needn't import this module
    def labeller():
        return lambda prompts: [json.dumps({"score": len(p) % 2, "explanation": "x"}) if len(p) % 5 else "no answer" for p in prompts]

    return labeller


labeller = _stand_in()


def test_train_refresh_and_evaluate(spark, tables):
    config = Config(relevance_max_length=64, validation_size=5)
    relevance, metrics = P.train_relevance(tables, config, make, 16, AS_OF)
    assert metrics.first()["log_loss"] > 0
    urgency, metrics = P.train_urgency(tables, Config(relevance_max_length=64, validation_size=4), make, 16, AS_OF)
    assert metrics.count() == 1
    done = P.refresh(tables, relevance, urgency, config, make, 16, AS_OF)
    scores = done.scores.toPandas()
    assert len(scores) and scores["article_id"].is_unique and scores["urgency_score"].between(0, 1).all()
    assert done.entries.count() == tables.entries.count()
    changed = done.entries.join(done.scores.select(F.col("article_id").alias("id"), F.col("score").alias("s")), "id")
    assert changed.where("score <> s").count() == 0
    assert done.urgency_inference.where(F.col("model_key") == config.urgency_model_key).count() == len(scores)
    # the second run finds every vector in the cache and gives the same scores
    warm = P.Tables(**{**tables.__dict__, "relevance_embeddings": done.relevance_embeddings})
    again = P.refresh(warm, relevance, urgency, config, make, 16, AS_OF).scores.toPandas()
    assert scores.sort_values("article_id").equals(again.sort_values("article_id")) or len(scores) == len(again.merge(scores))
    row = P.evaluation_row(P.evaluate_relevance(tables, config, make, 16, AS_OF), "relevance", "2024-02-01", {"good": 1}, {"good": 1})
    assert row.count() == 1
    assert P.evaluate_relevance(tables, Config(relevance_max_length=64, validation_size=100_000), make, 16, AS_OF) is None


def test_evaluate_infer_and_reuse(spark, tables, tmp_path):
    config = Config(relevance_max_length=32, validation_size=4)
    assert P.evaluate_urgency(tables, config, make, 16, AS_OF).count() == 1
    for size in (0, 1, 100_000):
        assert P.evaluate_urgency(tables, Config(relevance_max_length=32, validation_size=size), make, 16, AS_OF) is None
    path, calls = str(tmp_path / "model"), []

    def train():
        calls.append(1)
        return P.train_urgency(tables, Config(relevance_max_length=32), make, 16, AS_OF)[0]

    models = [P.load_or_train(path, train, c=1.0) for _ in range(2)]
    assert len(calls) == 1 and models[0].coefficients == models[1].coefficients
    scores = P.infer(tables, models[1], config, make, 16, AS_OF, days=60)
    assert scores.where("score between 0 and 100").count() == scores.count() > 0


def test_sql_over_views(spark, data):
    register(spark, data, "entries", "feeds")
    query = "select count(*) n from entries e join feeds f on f.id = e.feed_id where status = :status and array_contains(:votes, vote)"
    n = sql(spark, query, status="read", votes=F.array(F.lit(0), F.lit(1))).first()["n"]
    assert n == table(spark, data, "entries").join(table(spark, data, "feeds").withColumnRenamed("id", "feed_id").drop("title"), "feed_id").where("status = 'read' and vote in (0, 1)").count() > 0


def test_labels_and_tags(spark, tables):
    labels = spark.createDataFrame([], "article_id long, score short")
    new, links, rejects = P.label_simplified(tables, labels, labeller, AS_OF)
    asked = P.R.without_simplified(tables.articles(), labels, AS_OF).count()
    assert new.count() + rejects.count() == asked > 0
    assert links.join(new.withColumnRenamed("article_id", "entry_id"), "entry_id", "left_anti").count() == 0
    # labelled articles aren't asked for again
    assert P.R.without_simplified(tables.articles(), new, AS_OF).count() == rejects.count()


def test_label_stream(spark, data, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "labels")
    rows = table(spark, data, "entries")
    rows.write.parquet(source)
    run = lambda: S.label_batches(S.article_stream(spark, source), labeller, out, str(tmp_path / "rejects"), str(tmp_path / "check")).awaitTermination()
    run()
    first = spark.read.parquet(out).count()
    assert first > 0 and spark.read.parquet(out).select("article_id").distinct().count() == first
    rows.withColumn("id", F.col("id") + F.when(F.col("id") % 2 == 0, 10_000_000).otherwise(0)).write.mode("append").parquet(source)
    run()
    ids = [r[0] for r in spark.read.parquet(out).select("article_id").collect()]
    assert len(ids) == len(set(ids)) > first


def test_arrivals_stream(spark, data, tmp_path):
    table(spark, data, "entries").write.parquet(str(tmp_path / "in"))
    stream = S.arrivals(S.article_stream(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert spark.table("arrivals").agg(F.sum("articles")).first()[0] == table(spark, data, "entries").where("changed_at is not null").count()


def test_ratings_with_confidence(spark, tables):
    none = P.Tables(**{**tables.__dict__, "time_sensitivity": tables.time_sensitivity.limit(0)})
    new, rejects = P.label_time_sensitivity(none, L.keyword_labeller, AS_OF, 60)
    assert new.count() > 0 and rejects.count() == 0 and new.columns == tables.time_sensitivity.columns
    assert violations(new, "time_sensitivity").count() == 0 and new.select("article_id").distinct().count() == new.count()
    # those with a row aren't asked for again
    labelled = P.Tables(**{**none.__dict__, "time_sensitivity": new})
    assert P.label_time_sensitivity(labelled, L.keyword_labeller, AS_OF, 60)[0].count() == 0
    bad = lambda: lambda prompts: ['{"score": 3, "explanation": "x"}' for _ in prompts]
    new, rejects = P.label_time_sensitivity(none, bad, AS_OF, 60)
    assert new.count() == 0 and rejects.count() > 0


def test_device_guard():
    for allowed, present in ((True, False), (False, True), (True, True)):
        P.checked_device(allowed, present)
    with pytest.raises(RuntimeError):
        P.checked_device(False, False)


def test_migrations(spark, tmp_path):
    root = str(tmp_path / "lake")
    assert M.version(root) == 0
    spark.createDataFrame([(1,)], "id long").write.parquet(f"{root}/entries.parquet")
    assert M.up(spark, root, 1) == 1 and table(spark, root, "time_sensitivity").count() == 0
    assert M.up(spark, root, 2) == 3 and "model_key" not in table(spark, root, "urgency_inference").columns
    rows = [(1, 0.5, "2024-01-01"), (2, 0.25, "2024-01-01")]
    spark.createDataFrame(rows, "article_id long, urgency_score double, at string").selectExpr("article_id", "urgency_score", "cast(at as timestamp_ntz) last_updated").write.mode("append").parquet(f"{root}/urgency_inference.parquet")
    assert M.up(spark, root) == 5
    keyed = table(spark, root, "urgency_inference")
    assert {r["model_key"] for r in keyed.collect()} == {M.FIRST_KEY}
    newer = keyed.where("article_id = 1").selectExpr("article_id", "0.75d urgency_score", "cast('2024-02-01' as timestamp_ntz) last_updated", "'other' model_key")
    newer.write.mode("append").parquet(f"{root}/urgency_inference.parquet")
    M.pruned(spark, root, "urgency_inference")
    assert [r["article_id"] for r in table(spark, root, "urgency_inference").collect()] == [1, 1]
    assert M.down(spark, root, 1) == 4
    assert [(r["article_id"], r["urgency_score"]) for r in table(spark, root, "urgency_inference").collect()] == [(1, 0.75)]
    assert M.down(spark, root) == 0 and M.version(root) == 0
    with pytest.raises(Exception):
        table(spark, root, "time_sensitivity").count()


def test_commands(spark, tables, tmp_path, monkeypatch):
    for name, value in (("ALLOW_TRAINING_WO_GPU", "true"), ("ALLOW_INFERENCE_WO_GPU", "true"), ("VALIDATION_SIZE", "4"), ("RELEVANCE_MAX_LENGTH", "32"), ("LOGGING_CONFIG", "")):
        monkeypatch.setenv(name, value)
    root, models = str(tmp_path / "lake"), str(tmp_path / "models")
    for name, df in tables.__dict__.items():
        df.write.parquet(f"{root}/{name}.parquet")

    def run(command):
        assert C.main([command, "--data", root, "--models", models, "--as-of", AS_OF, "--dimensions", "16", "--days", "60"], spark) == 0
        return lambda name: spark.read.parquet(f"{root}/{name}.parquet")

    with pytest.raises(FileNotFoundError):
        run("infer")
    run("train")
    run("train_urgency")
    config = C.Config.from_env()
    assert len(H.artifacts(models, config.relevance_family)) == len(H.artifacts(models, config.urgency_family)) == 1
    now = run("infer_urgency")
    scored = now("urgency_inference").where(F.col("model_key") == config.urgency_model_key).count()
    assert scored > 0 and now("relevance_embeddings").count() > tables.relevance_embeddings.dropDuplicates(["article_id", *config.cache_key]).count()
    before = tables.entries.count()
    for command in ("infer", "full_infer"):
        assert run(command)("entries").count() == before
    assert run("eval")("model_evals").count() == 2
    assert run("time")("time_sensitivity").count() >= tables.time_sensitivity.count()
    now = run("time_simple")
    labels = now("time_sensitivity_simplified")
    # of the stand-in's ratings from 1 to 5 only those of 1 are answers here
    assert labels.count() > 0 and labels.where("score <> 1").count() == 0
    assert 0 < now("entry_user_tags").count() - tables.entry_user_tags.count() <= labels.count()


def test_inference_needs_a_gpu_or_leave(spark, tables, tmp_path):
    with pytest.raises(RuntimeError, match="GPU"):
        P.infer_relevance(tables, str(tmp_path), Config(), make, 16, AS_OF, gpu=False)
