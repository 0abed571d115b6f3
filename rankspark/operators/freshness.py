"""Ordered freshness buckets (an extension of the ranking).

Six buckets from hours to evergreen are learnt as five cumulative targets, put
together again to bucket probabilities, and turned into an expected lifetime.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame

from rankspark.operators import model as H

BUCKETS = 6
# The lifetime in days that stands for each bucket.
LIFETIMES = (0.5, 2.0, 5.5, 19.0, 90.0, 365.0)


def cumulative_targets(bucket: Column) -> list[Column]:
    """over_1 ... over_5: whether the bucket (from 1) lies above each bound."""
    return [(bucket > k).cast("int").alias(f"over_{k}") for k in range(1, BUCKETS)]


def bucket_probabilities(over: list[Column]) -> Column:
    """Six probabilities from five cumulative ones, put in falling order first; they add up to 1."""
    falling = F.sort_array(F.array(*over), asc=False)
    upper = F.concat(F.array(F.lit(1.0)), falling)
    lower = F.concat(falling, F.array(F.lit(0.0)))
    return F.zip_with(upper, lower, lambda a, b: a - b)


def expected_lifetime(buckets: Column) -> Column:
    return F.aggregate(F.zip_with(buckets, F.array(*map(F.lit, LIFETIMES)), lambda p, days: p * days), F.lit(0.0), lambda s, x: s + x)


def class_weights(rows: DataFrame, label: str = "label", exponent: float = 0.375) -> DataFrame:
    """``rows`` with ``weight``: (n / (2 * rows of the class)) to the exponent."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*")).scalar()
    return rows.join(F.broadcast(counts.select(label, F.pow(total / (2.0 * F.col("_n")), F.lit(exponent)).alias("weight"))), label)


def fit_heads(rows: DataFrame, bucket: str = "bucket", features: str = "embedding", c: float = 20.0) -> list[LogisticRegressionModel]:
    """Five heads without intercept, one for each cumulative target, with class weights; an error if a target has one class only."""
    made = rows.select(features, *cumulative_targets(F.col(bucket))).persist()
    try:
        return [H.fit(class_weights(made, f"over_{k}"), c, intercept=False, features=features, label=f"over_{k}") for k in range(1, BUCKETS)]
    finally:
        made.unpersist()


def predicted(heads: list[LogisticRegressionModel], rows: DataFrame, features: str = "embedding") -> DataFrame:
    """``rows`` with ``buckets``, the six probabilities; null features give null."""
    names = [f"_over_{k}" for k in range(1, BUCKETS)]
    for head, name in zip(heads, names):
        rows = H.probabilities(head, rows, features).withColumnRenamed("p", name)
    made = bucket_probabilities([F.col(n) for n in names])
    return rows.withColumn("buckets", F.when(F.col(features).isNotNull(), made)).drop(*names)


def reviewed_labels(labels: DataFrame) -> DataFrame:
    """(article_id, bucket) from (article_id, bucket, reviewed): reviewed labels go before automatic ones; articles whose counting labels differ drop out."""
    best = labels.groupBy("article_id").agg(F.max("reviewed").alias("reviewed"))
    counting = labels.join(best, ["article_id", "reviewed"])
    return counting.groupBy("article_id").agg(F.min("bucket").alias("bucket"), F.max("bucket").alias("_b")).where(F.col("bucket") == F.col("_b")).select("article_id", "bucket")


def fingerprint(rows: DataFrame) -> DataFrame:
    """(rows, fingerprint): the same for the same bag of rows in any order; sums of hashes, so nothing is gathered."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in rows.columns])
    number = lambda start: F.conv(F.substring(F.md5(text), start, 12), 16, 10).cast("long")
    # 48 bits a row: a long overflows from some 65,000 rows on
    parts = [F.count("*"), F.coalesce(F.sum(number(1).cast("decimal(28,0)")), F.lit(0)), F.coalesce(F.bit_xor(number(13)), F.lit(0))]
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256).alias("fingerprint"))


def ranked_probability_score(rows: DataFrame) -> DataFrame:
    """One row from (bucket from 1, p: six probabilities): rps, bucket_mae, log_duration_mae."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(BUCKETS - 1)), lambda k: F.aggregate(F.slice("p", F.lit(1), k), F.lit(0.0), lambda s, x: s + x) - F.when(F.col("bucket") <= k, 1.0).otherwise(0.0))
    rps = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x * x) / (BUCKETS - 1)
    mean = F.aggregate(F.zip_with("p", F.sequence(F.lit(1), F.lit(BUCKETS)), lambda p, k: p * k), F.lit(0.0), lambda s, x: s + x)
    true = F.element_at(F.array(*map(F.lit, LIFETIMES)), F.col("bucket"))
    return rows.agg(F.avg(rps).alias("rps"), F.avg(F.abs(mean - F.col("bucket"))).alias("bucket_mae"), F.avg(F.abs(F.ln(expected_lifetime(F.col("p"))) - F.ln(true))).alias("log_duration_mae"))


def quadratic_kappa(rows: DataFrame) -> DataFrame:
    """(kappa) of (bucket, guess): 1 less observed over expected squared distance; null without any spread."""
    s = rows.agg(*[f.alias(n) for n, f in (("n", F.count("*")), ("d", F.sum(F.pow(F.col("bucket") - F.col("guess"), 2))), ("b", F.sum("bucket")), ("g", F.sum("guess")), ("b2", F.sum(F.col("bucket") * F.col("bucket"))), ("g2", F.sum(F.col("guess") * F.col("guess"))))])
    expected = F.col("b2") + F.col("g2") - 2.0 * F.col("b") * F.col("g") / F.col("n")
    return s.select(F.when(expected > 0, 1 - F.col("d") / expected).alias("kappa"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """(macro_f1) of (bucket, guess) over the buckets that occur in either."""
    both = rows.select(F.explode(F.array_distinct(F.array("bucket", "guess"))).alias("c"), "bucket", "guess")
    per = both.groupBy("c").agg(F.count_if((F.col("bucket") == F.col("c")) & (F.col("guess") == F.col("c"))).alias("tp"), F.count_if(F.col("bucket") == F.col("c")).alias("t"), F.count_if(F.col("guess") == F.col("c")).alias("g"))
    return per.agg(F.avg(2.0 * F.col("tp") / (F.col("t") + F.col("g"))).alias("macro_f1"))
