"""Queries on training data, by the numbers of the problems."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from rankspark.llm.oracles import oracle_sql  # noqa: F401  (the driver asks this module)
from rankspark.llm import encode, garbled, mixing, near_duplicates, similar_vectors, site_lines, split_overlap, truncation
from rankspark.sources import articles, table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "relevance_embeddings").where("model_name = 'cobble-64'")
    return similar_vectors.usable(rows, 64)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_vectors.neighbours(_vectors(spark, sf_dir), 64, k=5, min_cosine=0.9)
    return similar_vectors.neighbour_pairs(found, 0.9)


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_vectors.neighbours(_vectors(spark, sf_dir), 64, k=5, every=50)
    return found.select(F.col("id").alias("article_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 3).alias("cosine"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.group_pairs(near_duplicates.duplicate_groups(articles(spark, sf_dir, "title", "content")))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.duplicate_groups(articles(spark, sf_dir, "title", "content"))


def _overlaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, splits = articles(spark, sf_dir, "title", "content"), table(spark, sf_dir, "article_splits")
    return split_overlap.split_overlaps(rows, splits), rows, splits


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _overlaps(spark, sf_dir)[0]
    return found.select(F.least("train_id", "eval_id").alias("article_id_a"), F.greatest("train_id", "eval_id").alias("article_id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlap_report(*_overlaps(spark, sf_dir))


def _by_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir, "content").withColumn("source", F.col("feed_name"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_off(_by_feed(spark, sf_dir))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(_by_feed(spark, sf_dir)).withColumnRenamed("source", "feed_name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_places(_by_feed(spark, sf_dir))


def p5_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.cleaned(_by_feed(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.token_ids(table(spark, sf_dir, "documents"))


def p7_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.found(table(spark, sf_dir, "documents"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.restored(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_neighbours": p1_neighbours,
        "p2_found": p2_found,
        "p2_groups": p2_groups,
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p4_found": p4_found,
        "p4_rates": p4_rates,
        "p5_found": p5_found,
        "p5_cleaned": p5_cleaned,
        "p6_ids": p6_ids,
        "p7_chosen": p7_chosen,
        "p7_shares": p7_shares,
        "p8_found": p8_found,
        "p8_restored": p8_restored,
    }
