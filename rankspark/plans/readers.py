"""Queries of the readers, lookups and the flagship ranking, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from rankspark.functions import scores as S
from rankspark.operators import select as R
from rankspark.sources import table

AS_OF = "2024-02-01 00:00:00"
NOW = f"timestamp '{AS_OF}'"
MODEL_KEY = "brisk-linear"
COLUMNS = ("feed_id", "title", "url", "author", "published_at", "vote", "starred", "tags")

CUR = "cur as (select * exclude (rn) from (select *, row_number() over (partition by id order by changed_at desc nulls last, status desc) rn from entries) where rn = 1)"
ART = f"""{CUR}, ts as (select article_id, arg_max(score, last_updated) score from time_sensitivity group by article_id),
art as (select c.id article_id, c.title, c.starred, f.title feed_name, c.url link, c.author, c.published_at date_entered, c.changed_at last_read,
  t.score time_sensitivity_score, coalesce(c.tags, []) tags, c.vote, c.status
  from cur c join feeds f on f.id = c.feed_id left join ts t on t.article_id = c.id)"""
SHOWN = "article_id, title, starred, feed_name, link, author, date_entered, last_read, time_sensitivity_score, cast(len(tags) as int) n_tags, vote, status"
OPEN = "status = 'unread' and vote <> -1 and not starred"
GOOD = f"status = 'read' and vote >= 0 and date_entered > {NOW} - interval 3 year"
BAD = f"vote = -1 and date_entered > {NOW} - interval 3 year"
HASH = "md5(article_id::varchar || '|42')"
OLD = f"{OPEN} and date_entered >= {NOW} - to_days(365) and date_entered <= {NOW} - to_days({{days}}) order by {HASH}, article_id limit {{limit}}"
K = 20


def article_rows(spark: SparkSession, d: str, *columns: str, since: Column | None = None) -> DataFrame:
    entries = R.current_entries(table(spark, d, "entries"), *(columns or COLUMNS), since=since)
    return R.articles(entries, table(spark, d, "feeds"), table(spark, d, "time_sensitivity"))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("n_tags", F.size("tags")).select("article_id", "title", "starred", "feed_name", "link", "author", "date_entered", "last_read", "time_sensitivity_score", "n_tags", "vote", "status")


def _reader(make: Callable[[SparkSession, str, DataFrame], DataFrame], since: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """A reader on narrow rows published from ``since`` on; what it keeps is completed."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = make(spark, d, article_rows(spark, d, *R.NARROW, since=since()))
        return _shown(R.completed(rows, table(spark, d, "entries"), "title", "url", "author", "tags"))

    return run


def _days(days: int) -> Callable[[], Column]:
    return lambda: R.days_before(AS_OF, days)


def _months(months: int) -> Callable[[], Column]:
    return lambda: R.months_before(AS_OF, months)


def active_set_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The active set with decayed scores: the raw score stands in by a formula on the id."""
    rows = R.active_set(article_rows(spark, d, *R.NARROW, since=R.days_before(AS_OF, 365)), AS_OF).dropDuplicates(["article_id"])
    urgency = R.latest_urgency(table(spark, d, "urgency_inference"), MODEL_KEY)
    rows = rows.join(urgency, "article_id", "left").withColumn("raw_score", (F.col("article_id") * 37 % 101).cast("int"))
    score = S.decayed(F.col("raw_score"), S.age_days(R.clock(AS_OF), F.col("date_entered")), F.col("urgency_score"))
    return rows.withColumn("score", score).select("article_id", "feed_name", "date_entered", "urgency_score", "raw_score", "score").orderBy(F.desc("score"), "article_id")


ACTIVE = f"""act as (select * from art where {OPEN} and date_entered >= {NOW} - to_days(40)
  union all (select * from art where {OLD.format(days=40, limit=1500)}))"""
URGENCY = f"urg as (select article_id, urgency_score from (select *, row_number() over (partition by article_id order by last_updated desc nulls last, urgency_score desc) rn from urgency_inference where model_key = '{MODEL_KEY}') where rn = 1)"
DECAY = "cast(round_even({s} * exp(-(ln(2.0) / (120 + {u} * (10 - 120))) * ((epoch_us({now}) - epoch_us({at})) / 86400000000.0)), 0) as int)"


def _boundary(spark: SparkSession, d: str) -> DataFrame:
    """Articles that stand in both halves of the active set, and how often."""
    rows = article_rows(spark, d, *R.NARROW, since=R.days_before(AS_OF, 365))
    return R.active_set(rows, AS_OF).groupBy("article_id").agg(F.count("*").alias("times"))


def lookback_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    age = S.age_days(F.lit("2002-01-01").cast("timestamp_ntz"), F.col("o_orderdate"))
    recent = orders.where(F.col("o_orderdate") >= R.days_before("2002-01-01", 1200))
    return recent.select("o_orderkey", "o_orderdate", F.floor(age).cast("long").alias("age_days"))


def decay_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    urgency = (F.col("o_orderkey") % 101).cast("double") / 100
    age = S.age_days(F.lit("2002-01-01").cast("timestamp_ntz"), F.col("o_orderdate"))
    return orders.select("o_orderkey", S.decayed((F.col("o_custkey") % 101).cast("int"), age, urgency).alias("score"))


def _simplified(spark: SparkSession, d: str) -> DataFrame:
    """Two-step labels, from the five-step ones."""
    return table(spark, d, "time_sensitivity").select("article_id", F.when(F.col("score") >= 4, 1).otherwise(0).cast("short").alias("score"))


QUERIES = {
    "active_set_ranked": (
        active_set_ranked,
        f"""with {ART}, {ACTIVE}, {URGENCY}, d as (select distinct article_id, feed_name, date_entered from act)
        select d.article_id, feed_name, date_entered, urgency_score, cast(d.article_id * 37 % 101 as int) raw_score,
        case when urgency_score is null then cast(d.article_id * 37 % 101 as int) else {DECAY.format(s='(d.article_id * 37 % 101)', u='urgency_score', now=NOW, at='date_entered')} end score
        from d left join urg on urg.article_id = d.article_id""",
    ),
    "active_set": (_boundary, f"with {ART}, {ACTIVE} select article_id, count(*) times from act group by article_id"),
    "good_train": (_reader(lambda s, d, a: R.skip_k(R.good(a, AS_OF), K), _months(36)), f"with {ART}, g as (select *, row_number() over (order by article_id) rn from art where {GOOD}) select {SHOWN} from g where rn > {K}"),
    "good_sample": (_reader(lambda s, d, a: R.first_k(R.good(a, AS_OF), K), _months(36)), f"with {ART}, g as (select *, row_number() over (order by article_id) rn from art where {GOOD}) select {SHOWN} from g where rn <= {K}"),
    "bad_train": (_reader(lambda s, d, a: R.skip_k(R.bad(a, AS_OF), K), _months(36)), f"with {ART}, g as (select *, row_number() over (order by article_id) rn from art where {BAD}) select {SHOWN} from g where rn > {K}"),
    "bad_sample": (_reader(lambda s, d, a: R.first_k(R.bad(a, AS_OF), K), _months(36)), f"with {ART}, g as (select *, row_number() over (order by article_id) rn from art where {BAD}) select {SHOWN} from g where rn <= {K}"),
    "unlabelled_pool": (_reader(lambda s, d, a: R.unlabelled(a, AS_OF), _months(12)), f"with {ART} select {SHOWN} from art where {OPEN} and date_entered > {NOW} - interval 1 year order by article_id limit 2000"),
    "recent_unread": (_reader(lambda s, d, a: R.recent_unread(a, AS_OF, 40), _days(40)), f"with {ART} select {SHOWN} from art where {OPEN} and date_entered >= {NOW} - to_days(40)"),
    "old_unread_sample": (_reader(lambda s, d, a: R.old_unread(a, AS_OF, 30, 365, 30), _days(365)), f"with {ART} select {SHOWN} from art where {OLD.format(days=30, limit=30)}"),
    "missing_time_sensitivity": (_reader(lambda s, d, a: R.without_time_sensitivity(a, table(s, d, "time_sensitivity"), AS_OF, 200), _days(200)), f"with {ART} select {SHOWN} from art a where date_entered >= {NOW} - to_days(200) and not exists (select 1 from time_sensitivity t where t.article_id = a.article_id)"),
    "missing_binary_label": (_reader(lambda s, d, a: R.without_simplified(a, _simplified(s, d), AS_OF), _months(6)), f"with {ART} select {SHOWN} from art a where date_entered > {NOW} - interval 6 month and not exists (select 1 from time_sensitivity t where t.article_id = a.article_id)"),
    "missing_urgency": (_reader(lambda s, d, a: R.without_urgency(a, table(s, d, "urgency_inference"), MODEL_KEY, AS_OF, 200), _days(200)), f"with {ART} select {SHOWN} from art a where {OPEN} and date_entered >= {NOW} - to_days(200) and not exists (select 1 from urgency_inference t where t.article_id = a.article_id and t.model_key = '{MODEL_KEY}')"),
    "tagged_all": (
        lambda s, d: R.tagged(article_rows(s, d, "feed_id"), table(s, d, "entry_user_tags"), table(s, d, "user_tags")).select("article_id", "feed_name", "status", "urgency_label"),
        f"with {ART} select article_id, feed_name, status, case u.title when '0-urgency' then 0 when '1-urgency' then 1 end urgency_label from art join entry_user_tags l on l.entry_id = article_id join user_tags u on u.id = l.user_tag_id and u.user_id = 1 and u.title in ('0-urgency', '1-urgency')",
    ),
    "tagged_read": (
        lambda s, d: R.tagged(article_rows(s, d, "feed_id"), table(s, d, "entry_user_tags"), table(s, d, "user_tags"), read_only=True).select("article_id", "feed_name", "status", "urgency_label"),
        f"with {ART} select article_id, feed_name, status, case u.title when '0-urgency' then 0 when '1-urgency' then 1 end urgency_label from art join entry_user_tags l on l.entry_id = article_id join user_tags u on u.id = l.user_tag_id and u.user_id = 1 and u.title in ('0-urgency', '1-urgency') where status = 'read'",
    ),
    "conflicting_labels": (
        lambda s, d: R.conflicting(R.tagged(article_rows(s, d, "feed_id"), table(s, d, "entry_user_tags"), table(s, d, "user_tags"))),
        f"with {ART} select article_id from art join entry_user_tags l on l.entry_id = article_id join user_tags u on u.id = l.user_tag_id and u.user_id = 1 and u.title in ('0-urgency', '1-urgency') group by article_id having count(distinct u.title) > 1",
    ),
    "tag_ids": (lambda s, d: R.tag_ids(table(s, d, "user_tags")), "select title, id from user_tags where user_id = 1 and title in ('0-urgency', '1-urgency')"),
    "embedding_lookup": (
        lambda s, d: R.embeddings_of(article_rows(s, d, "feed_id").select("article_id"), table(s, d, "relevance_embeddings"), {"model_name": "cobble-64", "max_length": 2048, "text_prep_mode": "title_head", "prep_version": 2}).select("article_id", "text_hash", F.size("embedding").cast("long").alias("dimensions")),
        f"""with {ART}, e as (select *, row_number() over (partition by article_id order by last_updated desc nulls last, text_hash desc) rn from relevance_embeddings
        where model_name = 'cobble-64' and max_length = 2048 and text_prep_mode = 'title_head' and prep_version = 2 and article_id in (select article_id from art))
        select article_id, text_hash, len(embedding) dimensions from e where rn = 1""",
    ),
    "urgency_lookup": (
        lambda s, d: R.urgency_of(article_rows(s, d, "feed_id").select("article_id"), table(s, d, "urgency_inference"), MODEL_KEY),
        f"with {ART}, {URGENCY} select article_id, urgency_score from urg where article_id in (select article_id from art)",
    ),
    "lookback_orders": (lookback_orders, "select o_orderkey, o_orderdate, cast(floor((epoch_us(timestamp '2002-01-01') - epoch_us(o_orderdate)) / 86400000000.0) as bigint) age_days from orders where o_orderdate >= timestamp '2002-01-01' - to_days(1200)"),
    "decay_orders": (decay_orders, f"select o_orderkey, {DECAY.format(s='(o_custkey % 101)', u='((o_orderkey % 101)::double / 100)', now=chr(39).join(['timestamp ', '2002-01-01', '']), at='o_orderdate')} score from orders"),
}
