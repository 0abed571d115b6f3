"""Sinks: Parquet states that are swapped in whole or by buckets of their key, appends, and a JSON history.

A relation of which runs change few rows (scores, titles) is kept in buckets:
folders by hash of its key.  :func:`update_buckets` reads and writes only the
buckets with a changed key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from rankspark.sources import files
from rankspark.sources.shared import stored

BUCKET = "_bucket"


def swap(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write the new state of a relation and put it in the place of the old one.

    The new files are complete before the old ones go, so a failed write leaves
    the old state; ``df`` may be computed from ``path`` itself.  One writer; for a
    moment between two renames readers find no relation.
    """
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(fresh)
    there = files.exists(path)
    if there:
        files.rename(path, old)
    files.rename(fresh, path)
    if there:
        files.delete(old)


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: list[str], buckets: int) -> None:
    """A relation in buckets of its key; one file a bucket and task at most."""
    df.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def update_buckets(path: str, changes: DataFrame, key: list[str], buckets: int, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Put ``apply(rows, changes)`` in the place of the rows in the buckets that ``changes`` has keys of; which these are.

    The other buckets are neither read nor written.  The new rows are complete in
    the shared folder before the old ones are overwritten.
    """
    changes, _ = stored(changes.withColumn(BUCKET, bucket_of(key, buckets)), "changes")
    touched = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())  # as many as buckets at most
    if not touched:
        return []
    rows = changes.sparkSession.read.parquet(path).where(F.col(BUCKET).isin(*touched))
    new, _ = stored(apply(rows.drop(BUCKET), changes.drop(BUCKET)).withColumn(BUCKET, bucket_of(key, buckets)), "buckets")
    new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_history(path: str) -> list[dict]:
    """The records of a JSON history; a missing or broken file counts as none."""
    try:
        records = json.loads(files.read_text(path)) if files.exists(path) else []
    except ValueError:
        return []
    return records if isinstance(records, list) else []


def append_history(path: str, record: dict) -> None:
    """The file rewritten with one more record, by way of a second file."""
    files.write_text(path, json.dumps([*read_history(path), record], indent=2))
