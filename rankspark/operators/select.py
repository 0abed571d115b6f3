"""Readers: the sets of articles that the pipelines work on.

All take the clock as a parameter, so a run sees one time.  An entry that was
delivered again counts in its latest state (latest ``changed_at``, null being
earliest; then the greatest status); status and ``changed_at`` are all that a
later delivery changes.  So the readers work on narrow rows (``NARROW``): a bound
on the date, which can't change, is put on the scan and reaches the Parquet files,
what can change is tested after the latest state is known, and titles, texts and
the like are fetched for the articles that are left (:func:`completed`).  The feed
and tag tables are dimensions.  Rows whose feed is missing drop out, and so do rows where a null
makes a filter unknown.  Repeated links, and a second row of an article in
``time_sensitivity``, are the data's to avoid: the readers dedupe the latter by
its latest row.  Empty tables give empty results.
"""

from __future__ import annotations

from datetime import datetime

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from rankspark.schema import RELATIONS
from rankspark.sources.shared import stored

# The titles of the two urgency tags, and the user whose tags count.
URGENCY_TITLES = ("0-urgency", "1-urgency")
TAG_USER = 1
COLUMNS = tuple(c.split()[0] for c in RELATIONS["entries"].columns.split(", "))
#: What the readers filter on.
NARROW = ("feed_id", "published_at", "vote", "starred")
_NAMED = {"id": "article_id", "url": "link", "published_at": "date_entered", "changed_at": "last_read"}


def clock(at: datetime | str) -> Column:
    return F.lit(str(at)).cast("timestamp_ntz")


def days_before(at: datetime | str, days: int) -> Column:
    return clock(at) - F.make_dt_interval(F.lit(days))


def months_before(at: datetime | str, months: int) -> Column:
    return clock(at) - F.make_ym_interval(months=F.lit(months))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the greatest by ``order`` (nulls least).

    A partial maximum is taken before the shuffle, so a key with very many rows
    is no hot spot.  Strings keep Spark from aggregating by hash: it sorts, so the
    columns should be few.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def current_entries(entries: DataFrame, *columns: str, since: Column | None = None) -> DataFrame:
    """Entries in their latest state, the named columns only (all if none are named), published from ``since`` on."""
    if since is not None:
        entries = entries.where(F.col("published_at") >= since)
    wanted = list(dict.fromkeys(["id", "changed_at", "status", *(columns or entries.columns)]))
    return latest(entries.select(*wanted), ["id"], ["changed_at", "status"])


def articles(entries: DataFrame, feeds: DataFrame, time_sensitivity: DataFrame | None = None) -> DataFrame:
    """Entries as articles, with the names of the article row; without a score table the score is null."""
    known = feeds.select(F.col("id").alias("feed_id"), F.col("title").alias("feed_name"))
    # other columns of the entries, whose names may clash, stay behind
    rows = entries.select(*[c for c in entries.columns if c in COLUMNS]).join(known, "feed_id")
    if time_sensitivity is None:
        rows = rows.withColumn("time_sensitivity_score", F.lit(None).cast("int"))
    else:
        scores = time_sensitivity.groupBy(F.col("article_id").alias("id")).agg(F.max_by("score", "last_updated").alias("time_sensitivity_score"))
        rows = rows.join(scores, "id", "left")
    rows = rows.withColumnsRenamed(_NAMED)
    if "tags" in rows.columns:
        rows = rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    order = ["article_id", "title", "starred", "feed_name", "content", "link", "author", "date_entered", "last_read", "time_sensitivity_score", "tags", "vote", "status"]
    return rows.select(*[c for c in order if c in rows.columns])


def completed(rows: DataFrame, entries: DataFrame, *columns: str) -> DataFrame:
    """Articles with more columns of their entries, which all deliveries of an entry share.

    Only the entries of ``rows`` are moved: their ids are few beside the entries,
    and Spark broadcasts them while they are small or filters the scan by them.
    """
    more = entries.select("id", *columns).withColumnsRenamed(_NAMED)
    if "tags" in columns:
        more = more.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    wanted = more.join(rows.select("article_id").distinct(), "article_id", "left_semi").dropDuplicates(["article_id"])
    return rows.join(wanted, "article_id")


def first_k(df: DataFrame, k: int, key: str = "article_id") -> DataFrame:
    """The ``k`` rows of least key (a distributed top-k)."""
    return df.orderBy(F.asc_nulls_last(key)).limit(k)


def skip_k(df: DataFrame, k: int, key: str = "article_id") -> DataFrame:
    """All but the ``k`` rows of least key; the key is unique.

    A row number over everything would send all rows to one task.  The boundary
    is the greatest of the first ``k`` keys, found as a top-k and compared in
    parallel.  The rows, which should be narrow, are stored, so that what gives
    them runs once.
    """
    if k <= 0:
        return df
    df, _ = stored(df, "rows")
    boundary = first_k(df.select(key), k, key).agg(F.max(key)).scalar()
    return df.where(F.col(key) > boundary)


def good(rows: DataFrame, as_of: datetime | str) -> DataFrame:
    """Read without a bad vote in the last three years."""
    return rows.where((F.col("status") == "read") & (F.col("vote") >= 0) & (F.col("date_entered") > months_before(as_of, 36)))


def bad(rows: DataFrame, as_of: datetime | str) -> DataFrame:
    """Voted down in the last three years, in any status."""
    return rows.where((F.col("vote") == -1) & (F.col("date_entered") > months_before(as_of, 36)))


def _open(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("status") == "unread") & (F.col("vote") != -1) & ~F.col("starred"))


def unlabelled(rows: DataFrame, as_of: datetime | str, limit: int = 2000) -> DataFrame:
    return first_k(_open(rows).where(F.col("date_entered") > months_before(as_of, 12)), limit)


def recent_unread(rows: DataFrame, as_of: datetime | str, days: int = 14) -> DataFrame:
    return _open(rows).where(F.col("date_entered") >= days_before(as_of, days))


def by_hash(key: str, seed: int) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def old_unread(rows: DataFrame, as_of: datetime | str, days: int = 30, max_days: int = 365, limit: int = 1500, seed: int = 42) -> DataFrame:
    """A random sample of the unread ones between two ages, both included: a top-k by hash, no global sort."""
    aged = _open(rows).where((F.col("date_entered") >= days_before(as_of, max_days)) & (F.col("date_entered") <= days_before(as_of, days)))
    return aged.orderBy(by_hash("article_id", seed), "article_id").limit(limit)


def active_set(rows: DataFrame, as_of: datetime | str, days: int = 40, max_days: int = 365, limit: int = 1500, seed: int = 42) -> DataFrame:
    """Recent and sampled old unread articles, as a bag: one exactly ``days`` old may stand twice."""
    return recent_unread(rows, as_of, days).unionByName(old_unread(rows, as_of, days, max_days, limit, seed))


def missing(rows: DataFrame, known: DataFrame, **equals: str) -> DataFrame:
    """Rows without a partner in ``known``, of which only the rows with the given column values count."""
    for column, value in equals.items():
        known = known.where(F.col(column) == value)
    return rows.join(known.select("article_id"), "article_id", "left_anti")


def without_time_sensitivity(rows: DataFrame, scores: DataFrame, as_of: datetime | str, days: int = 14) -> DataFrame:
    return missing(rows.where(F.col("date_entered") >= days_before(as_of, days)), scores)


def without_simplified(rows: DataFrame, labels: DataFrame, as_of: datetime | str) -> DataFrame:
    return missing(rows.where(F.col("date_entered") > months_before(as_of, 6)), labels)


def without_urgency(rows: DataFrame, inference: DataFrame, model_key: str, as_of: datetime | str, days: int = 14) -> DataFrame:
    return missing(recent_unread(rows, as_of, days), inference, model_key=model_key)


def tag_ids(user_tags: DataFrame, user_id: int = TAG_USER, titles: tuple[str, ...] = URGENCY_TITLES) -> DataFrame:
    return user_tags.where((F.col("user_id") == user_id) & F.col("title").isin(*titles)).select("title", "id")


def tagged(rows: DataFrame, entry_user_tags: DataFrame, user_tags: DataFrame, read_only: bool = False) -> DataFrame:
    """Articles with an urgency tag of the user, once for each link, with the label of the tag: two tags give two labels."""
    label = F.when(F.col("title") == URGENCY_TITLES[0], 0).when(F.col("title") == URGENCY_TITLES[1], 1)
    # two rows: a tag table restricted to one user and two titles
    labels = F.broadcast(tag_ids(user_tags).select(F.col("id").alias("user_tag_id"), label.alias("urgency_label")))
    links = entry_user_tags.join(labels, "user_tag_id").select(F.col("entry_id").alias("article_id"), "urgency_label")
    if read_only:
        rows = rows.where(F.col("status") == "read")
    return rows.join(links, "article_id")


def conflicting(labelled: DataFrame) -> DataFrame:
    """(article_id): articles with both labels."""
    return labelled.groupBy("article_id").agg(F.min("urgency_label").alias("a"), F.max("urgency_label").alias("b")).where("a <> b").select("article_id")


def embeddings_of(ids: DataFrame, cache: DataFrame, key: dict) -> DataFrame:
    """(article_id, text_hash, embedding) of the ids under one configuration; the latest row of a key counts."""
    rows = cache
    for column, value in key.items():
        rows = rows.where(F.col(column) == F.lit(value))
    rows = rows.select("article_id", "text_hash", "embedding", "last_updated").join(ids.select("article_id"), "article_id", "left_semi")
    return latest_embeddings(rows)


def latest_embeddings(rows: DataFrame) -> DataFrame:
    """(article_id, text_hash, embedding) of cache rows of one configuration; the latest row of an article counts."""
    rows = rows.select("article_id", "text_hash", "embedding", "last_updated")
    return latest(rows, ["article_id"], ["last_updated", "text_hash"]).select("article_id", "text_hash", "embedding")


def latest_urgency(inference: DataFrame, model_key: str) -> DataFrame:
    """(article_id, urgency_score) of this model; the latest row of a key counts."""
    rows = inference.where(F.col("model_key") == model_key).select("article_id", "urgency_score", "last_updated")
    return latest(rows, ["article_id"], ["last_updated", "urgency_score"]).select("article_id", "urgency_score")


def urgency_of(ids: DataFrame, inference: DataFrame, model_key: str) -> DataFrame:
    """The latest urgency of the ids that have one of this model."""
    wanted = inference.join(ids.select("article_id"), "article_id", "left_semi")
    return latest_urgency(wanted, model_key)
