"""Queries of the writes, each with its SQL."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from rankspark.operators import writes as U
from rankspark.operators.select import current_entries
from rankspark.plans.readers import CUR
from rankspark.sources import table

#: The time that parts a stored state from what comes in.
CUT = "2023-07-01"
NEWEST = "row_number() over (partition by article_id, model_key order by last_updated desc nulls last, urgency_score desc) rn"


def _current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_entries(table(spark, d, "entries"), *columns)


def urgency_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows up to a time as the stored state, the later ones upserted in the order of their time."""
    rows = table(spark, d, "urgency_inference")
    late = F.coalesce(F.col("last_updated") >= F.lit(CUT).cast("timestamp_ntz"), F.lit(False))
    key = ["article_id", "model_key"]
    state = U.keep_newest(rows.where(~late), key, ["last_updated", "urgency_score"])
    return U.upsert_urgency(state, rows.where(late).withColumn("ordinal", F.struct("last_updated", "urgency_score")))


def score_update(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "time_sensitivity").select(F.col("article_id").alias("id"), (F.col("score") * 20).alias("score"), F.col("last_updated").alias("ordinal"))
    return U.update(_current(spark, d, "score").select("id", "score"), changes, "id", "score")


def title_update(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "time_sensitivity").select(F.col("article_id").alias("id"), F.col("explanation").alias("title"), F.col("last_updated").alias("ordinal"))
    return U.update(_current(spark, d, "title").select("id", "title"), changes, "id", "title")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "time_sensitivity").select("article_id", F.when(F.col("score") >= 4, 1).otherwise(0).alias("label"), F.col("last_updated").alias("ordinal"))


def label_append(spark: SparkSession, d: str) -> DataFrame:
    """Two-step labels: the stored ones up to a time, and the later ones appended under a unique key."""
    rows = U.last_of(_labels(spark, d).withColumn("at", F.col("ordinal")), ["article_id"])
    late = F.coalesce(F.col("at") >= F.lit(CUT).cast("timestamp_ntz"), F.lit(False))
    return U.append_unique(rows.where(~late), rows.where(late), ["article_id"]).select("article_id", "label")


def model_eval_row(spark: SparkSession, d: str) -> DataFrame:
    """One row of the history of evaluations: counts as JSON maps, as they are stored."""
    votes = _current(spark, d, "vote").agg(F.count_if(F.col("vote") == 1).alias("good"), F.count_if(F.col("vote") == -1).alias("bad"))
    return votes.select(F.lit("2024-02-01").cast("date").alias("eval_date"), F.lit("relevance").alias("model"), F.to_json(F.create_map(F.lit("good"), "good", F.lit("bad"), "bad")).alias("training"))


QUERIES = {
    "urgency_upsert": (urgency_upsert, f"with l as (select *, {NEWEST}, last_updated >= timestamp '{CUT}' late from urgency_inference) select article_id, model_key, urgency_score, last_updated from l where rn = 1"),
    "keep_newest_score": (
        lambda s, d: U.keep_newest(table(s, d, "urgency_inference"), ["article_id"], ["last_updated", "model_key", "urgency_score"]).drop("model_key"),
        "select article_id, urgency_score, last_updated from (select *, row_number() over (partition by article_id order by last_updated desc nulls last, model_key desc, urgency_score desc) rn from urgency_inference) where rn = 1",
    ),
    "backfill_model_key": (
        lambda s, d: U.with_constant(table(s, d, "urgency_inference").drop("model_key"), "model_key", "first-model"),
        "select article_id, urgency_score, last_updated, 'first-model' model_key from urgency_inference",
    ),
    "score_update": (score_update, f"with {CUR}, c as (select article_id, arg_max(score * 20, last_updated) score from time_sensitivity group by article_id) select id, coalesce(c.score, cur.score) score from cur left join c on c.article_id = id"),
    "title_update": (title_update, f"with {CUR}, c as (select article_id, explanation, row_number() over (partition by article_id order by last_updated desc) rn from time_sensitivity) select id, case when c.article_id is not null then c.explanation else cur.title end title from cur left join c on c.article_id = id and rn = 1"),
    "tag_ensure": (
        lambda s, d: U.ensure_tags(table(s, d, "user_tags"), 3),
        "select * from user_tags union all select (select max(id) from user_tags) + n, 3, t from (values (1, '0-urgency'), (2, '1-urgency')) v(n, t)",
    ),
    "tag_assign": (
        lambda s, d: U.assign_tags(table(s, d, "entry_user_tags"), table(s, d, "user_tags"), _labels(s, d)),
        """with tag as (select id, case title when '0-urgency' then 0 else 1 end label from user_tags where user_id = 1 and title in ('0-urgency', '1-urgency')),
        n as (select article_id, arg_min(case when score >= 4 then 1 else 0 end, last_updated) label from time_sensitivity group by article_id)
        select article_id entry_id, tag.id user_tag_id from n join tag on tag.label = n.label
        where not exists (select 1 from entry_user_tags l join tag t on t.id = l.user_tag_id where l.entry_id = n.article_id)""",
    ),
    "label_append": (label_append, "select article_id, cast(arg_max(case when score >= 4 then 1 else 0 end, last_updated) as int) label from time_sensitivity group by article_id"),
    "cascade_prune": (lambda s, d: U.cascade(table(s, d, "entry_user_tags"), table(s, d, "entries"), "entry_id"), "select * from entry_user_tags where entry_id in (select id from entries)"),
    "insert_missing_links": (
        lambda s, d: U.insert_missing(table(s, d, "entry_user_tags"), _labels(s, d).select(F.col("article_id").alias("entry_id"), F.lit(3).cast("long").alias("user_tag_id")), ["entry_id", "user_tag_id"]),
        "select distinct article_id entry_id, 3::bigint user_tag_id from time_sensitivity t where not exists (select 1 from entry_user_tags l where l.entry_id = t.article_id and l.user_tag_id = 3)",
    ),
    "model_eval_row": (model_eval_row, f"with {CUR} select date '2024-02-01' eval_date, 'relevance' model, '{{\"good\":' || count(*) filter (vote = 1) || ',\"bad\":' || count(*) filter (vote = -1) || '}}' training from cur"),
}
