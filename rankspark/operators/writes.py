"""Writes: keyed updates and upserts, inserts that respect what is there, appends, swaps.

Plain Parquet has no MERGE, so each operator gives the new state of a relation
as a DataFrame; :func:`rankspark.sinks.swap` puts it in place.  Incoming rows
carry an ``ordinal`` where their order matters (later wins, or first wins).
Grouped maxima with a partial step before the shuffle do the work of sorts and
windows, so a hot key is harmless.  Rows with a null key never match and are
left out of the incoming side.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from rankspark.operators.select import URGENCY_TITLES, latest, tag_ids
from rankspark.schema import RELATIONS


def _keyed(df: DataFrame, key: list[str]) -> DataFrame:
    for k in key:
        df = df.where(F.col(k).isNotNull())
    return df


def last_of(incoming: DataFrame, key: list[str], ordinal: str = "ordinal") -> DataFrame:
    """One row a key: the one with the greatest ordinal (ties: the greatest values)."""
    rest = [c for c in incoming.columns if c not in (*key, ordinal)]
    return latest(_keyed(incoming, key), key, [ordinal, *rest]).drop(ordinal)


def first_of(incoming: DataFrame, key: list[str], ordinal: str = "ordinal") -> DataFrame:
    """One row a key: the one with the least ordinal."""
    rest = [c for c in incoming.columns if c not in (*key, ordinal)]
    best = _keyed(incoming, key).groupBy(*key).agg(F.min(F.struct(ordinal, *rest)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def update(current: DataFrame, changes: DataFrame, key: str, column: str, ordinal: str = "ordinal") -> DataFrame:
    """``current`` with ``column`` set where ``changes`` (key, column, ordinal) has the key; unmatched keys are ignored."""
    new = last_of(changes.select(key, column, ordinal), [key], ordinal).select(key, F.struct(F.col(column).alias("v")).alias("_new"))
    joined = current.join(new, key, "left")
    return joined.withColumn(column, F.when(F.col("_new").isNotNull(), F.col("_new.v").cast(current.schema[column].dataType)).otherwise(F.col(column))).select(*current.columns)


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], ordinal: str = "ordinal") -> DataFrame:
    """``current`` with rows of ``incoming`` put in place of those with their key, or added; of one key the last counts."""
    new = last_of(incoming, key, ordinal).select(*current.columns)
    return current.join(new.select(*key), key, "left_anti").select(*current.columns).unionByName(new)


def insert_missing(current: DataFrame, incoming: DataFrame, key: list[str], ordinal: str | None = None) -> DataFrame:
    """The rows of ``incoming`` whose key isn't there yet; of one key the first counts."""
    rows = first_of(incoming, key, ordinal) if ordinal else _keyed(incoming, key).dropDuplicates(key)
    return rows.join(current.select(*key).distinct(), key, "left_anti")


def append_unique(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``current`` and ``incoming``; running it fails if a key of ``incoming`` is there already or stands twice in it."""
    taken = current.select(*key).distinct().withColumn("_taken", F.lit(True))
    twice = incoming.groupBy(*key).agg(F.count("*").alias("_times"))
    checked = incoming.join(twice, key).join(taken, key, "left")
    clash = F.coalesce("_taken", F.lit(False)) | (F.col("_times") > 1)
    ok = F.when(clash, F.raise_error(F.concat(F.lit("duplicate key: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]))).cast("boolean")).otherwise(F.lit(True))
    return current.unionByName(checked.where(ok).select(*current.columns))


def cascade(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """The rows whose parent exists: what deleting parents leaves."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def keep_newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by ``order`` descending."""
    return latest(rows, key, order)


def with_constant(rows: DataFrame, column: str, value) -> DataFrame:
    """A new column with one value in every row: the backfill of a migration."""
    return rows.withColumn(column, F.lit(value))


def ensure_tags(user_tags: DataFrame, user_id: int, titles: tuple[str, ...] = URGENCY_TITLES) -> DataFrame:
    """The tag table with the user's tags, those missing added under the next ids."""
    spark = user_tags.sparkSession
    wanted = spark.createDataFrame([(user_id, t, k) for k, t in enumerate(titles, 1)], "user_id int, title string, n int")
    new = wanted.join(user_tags.select("user_id", "title").distinct(), ["user_id", "title"], "left_anti")
    top = user_tags.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return user_tags.unionByName(new.select((top + F.col("n")).alias("id"), "user_id", "title"))


def assign_tags(links: DataFrame, user_tags: DataFrame, incoming: DataFrame) -> DataFrame:
    """New rows of the link table from (article_id, label, ordinal): the tag of the label for each article that has none.

    A tag that is there, set by hand or before, stays; within the batch the
    first row of an article wins.
    """
    tags = tag_ids(user_tags)
    urgent = links.join(F.broadcast(tags.select(F.col("id").alias("user_tag_id"))), "user_tag_id", "left_semi").select(F.col("entry_id").alias("article_id")).distinct()
    by_label = F.broadcast(tags.select(F.when(F.col("title") == URGENCY_TITLES[0], 0).otherwise(1).alias("label"), F.col("id").alias("user_tag_id")))
    first = first_of(incoming.select("article_id", "label", "ordinal"), ["article_id"])
    return first.join(urgent, "article_id", "left_anti").join(by_label, "label").select(F.col("article_id").alias("entry_id"), "user_tag_id")


def upsert_embeddings(cache: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(cache, incoming, list(RELATIONS["relevance_embeddings"].key))


def upsert_urgency(inference: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(inference, incoming, list(RELATIONS["urgency_inference"].key))
