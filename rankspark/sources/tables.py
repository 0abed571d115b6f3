"""Table scans.  Every scan is a lazy Parquet read, so filters and column lists reach the files."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Rows of ``entries`` whose feed exists, with the feed's title as ``feed_name``.

    ``columns`` are the entry columns to keep; ``id`` comes out as ``article_id``.
    The feed table is a dimension; Spark broadcasts it while it is small.  Rows
    delivered more than once stay; an operator that needs one row an article
    removes them where that is cheapest.
    """
    feeds = table(spark, sf_dir, "feeds").select(F.col("id").alias("feed_id"), F.col("title").alias("feed_name"))
    entries = table(spark, sf_dir, "entries").select(F.col("id").alias("article_id"), "feed_id", *columns)
    return entries.join(feeds, "feed_id")


def jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1, **options: str) -> DataFrame:
    """A table of a database, read in ``partitions`` ranges of a numeric column; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Tables as temporary views, for SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def sql(spark: SparkSession, query: str, **values) -> DataFrame:
    """A statement over registered views with named parameters (``:name``), bound as values and never as text."""
    return spark.sql(query, args=values)
