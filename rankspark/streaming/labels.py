"""Labelling as a stream: new article files are labelled in micro-batches.

An extension: the batch pipelines label what has no label yet.  A stream reads a
folder of article files once each (the checkpoint remembers them), asks the
labeller, and appends accepted labels and rejects.  A batch that is run again
after a failure appends only articles that aren't labelled yet, so a restart
leaves no second label.
"""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rankspark.operators import label as L
from rankspark.plans.pipelines import label_answers
from rankspark.schema import RELATIONS


def article_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(RELATIONS["entries"].columns).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def label_batches(entries: DataFrame, labeller: Callable[[], Callable[[list[str]], list[str]]], labels: str, rejects: str, checkpoint: str, scores: tuple[int, ...] = (0, 1)) -> StreamingQuery:
    """Run through all files that are there (trigger: available now)."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        done = _existing(spark, labels, "article_id long, score int, explanation string").select("article_id")
        rows = batch.withColumnRenamed("id", "article_id").where("article_id is not null").dropDuplicates(["article_id"]).join(done, "article_id", "left_anti")
        parsed = L.parsed(label_answers(rows, labeller), scores).persist()
        try:
            L.accepted(parsed).select("article_id", "score", "explanation").write.mode("append").parquet(labels)
            L.rejected(parsed).select("article_id", "answer").write.mode("append").parquet(rejects)
        finally:
            parsed.unpersist()

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(entries: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, feed_id, articles): articles by day of ``changed_at``, each window closed once it is ``late`` old."""
    timed = entries.where("changed_at is not null").withColumn("at", F.col("changed_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "feed_id").agg(F.count("*").alias("articles")).select(F.col("w.start").alias("start"), "feed_id", "articles")
