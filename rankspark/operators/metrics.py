"""Binary metrics from (label, p), exact and in parallel.

Rows are first counted by distinct probability, so what is sorted are the
distinct values.  Null labels or probabilities are left out.  AUC and average
precision are null where a class is missing; precision, recall and F1 are 0
where their denominator is.  No rows give nulls.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from rankspark.functions.scores import clipped

THRESHOLD = 0.5
BLOCKS = 1024


def by_probability(rows: DataFrame) -> DataFrame:
    """(p, tp, fp): positives and negatives at each distinct probability."""
    known = rows.where(F.col("label").isNotNull() & F.col("p").isNotNull())
    return known.groupBy("p").agg(F.sum(F.col("label").cast("long")).alias("tp"), F.sum(1 - F.col("label").cast("long")).alias("fp"))


def cumulated(groups: DataFrame) -> DataFrame:
    """``groups`` with ctp, cfp: sums over this and all greater probabilities.

    Probabilities lie in [0, 1] and are cut into blocks of equal width; sums run
    inside each block and the blocks' offsets come from a table of ``BLOCKS``
    rows, so no task sees all values.
    """
    blocked = groups.withColumn("block", F.least(F.floor(F.col("p") * BLOCKS), F.lit(BLOCKS - 1)).cast("int"))
    inside = Window.partitionBy("block").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    sums = blocked.groupBy("block").agg(F.sum("tp").alias("btp"), F.sum("fp").alias("bfp"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("block", F.coalesce(F.sum("btp").over(above), F.lit(0)).alias("otp"), F.coalesce(F.sum("bfp").over(above), F.lit(0)).alias("ofp"))
    joined = blocked.join(F.broadcast(offsets), "block")  # BLOCKS rows at most
    return joined.select("p", "tp", "fp", (F.col("otp") + F.sum("tp").over(inside)).alias("ctp"), (F.col("ofp") + F.sum("fp").over(inside)).alias("cfp"))


def binary_metrics(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: accuracy, precision, recall, f1, roc_auc, average_precision, log_loss."""
    c = cumulated(by_probability(rows))
    p = clipped(F.col("p"))
    up = F.col("p") >= threshold
    s = c.agg(
        F.sum("tp").alias("P"),
        F.sum("fp").alias("N"),
        F.sum(F.when(up, F.col("tp")).otherwise(0)).alias("tp"),
        F.sum(F.when(up, F.col("fp")).otherwise(0)).alias("fp"),
        # each positive with the negatives below it, and half of those at its probability
        F.sum(F.col("tp") * F.col("cfp")).alias("above"),
        F.sum(F.col("tp") * F.col("fp")).alias("beside"),
        F.sum(F.col("tp") * F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("ap"),
        F.sum(-F.col("tp") * F.ln(p) - F.col("fp") * F.ln(1 - p)).alias("loss"),
    )
    P, N, tp, fp = (F.col(x).cast("double") for x in ("P", "N", "tp", "fp"))
    ratio = lambda a, b: F.when(F.col("P").isNotNull(), F.when(b > 0, a / b).otherwise(0.0))
    return s.select(
        F.when(P + N > 0, (tp + N - fp) / (P + N)).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, P).alias("recall"),
        ratio(2 * tp, tp + fp + P).alias("f1"),
        F.when((P > 0) & (N > 0), (P * N - F.col("above") + 0.5 * F.col("beside")) / (P * N)).alias("roc_auc"),
        F.when((P > 0) & (N > 0), F.col("ap") / P).alias("average_precision"),
        F.when(P + N > 0, F.col("loss") / (P + N)).alias("log_loss"),
    )
