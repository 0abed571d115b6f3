"""Queries of weights, splits, fits, scores and metrics, each with its SQL where SQL can express it."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from rankspark.functions import scores as S
from rankspark.functions import vectors as V
from rankspark.operators import freshness as P
from rankspark.operators import metrics as M
from rankspark.operators import model as H
from rankspark.operators import select as R
from rankspark.operators import splits as D
from rankspark.plans.readers import CUR, MODEL_KEY, URGENCY
from rankspark.plans.texts import IS_KEY, KEY, current
from rankspark.sources import table

WEIGHTS = [((k * 37) % 64 - 32) / 64 for k in range(64)]
FINITE = "len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
VECTOR = f"v as (select * from (select *, row_number() over (partition by article_id order by last_updated desc nulls last, text_hash desc) rn from relevance_embeddings where {IS_KEY}) where rn = 1 and {FINITE})"
VOTED = f"{CUR}, voted as (select id article_id, case when vote = 1 then 1 else 0 end label, vote, starred from cur where vote in (-1, 1))"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "relevance_embeddings").where(IS_KEY).where("article_id is not null")
    return R.latest_embeddings(rows).where(V.usable(F.col("embedding"), 64))


def voted(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, label, vote, starred): votes as labels, 1 for up and 0 for down."""
    rows = current(spark, d, "vote", "starred").where(F.col("vote").isin(-1, 1))
    return rows.select(F.col("id").alias("article_id"), F.when(F.col("vote") == 1, 1).otherwise(0).alias("label"), "vote", "starred")


def tagged_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = current(spark, d, "feed_id").withColumnRenamed("id", "article_id")
    return R.tagged(rows, table(spark, d, "entry_user_tags"), table(spark, d, "user_tags"), read_only=True).select("article_id", F.col("urgency_label").alias("label"))


def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    """(label, p): votes against the stored urgency scores."""
    rows = voted(spark, d)
    return rows.join(R.urgency_of(rows, table(spark, d, "urgency_inference"), MODEL_KEY), "article_id").select("label", F.col("urgency_score").alias("p"))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) for c in df.columns])


def _linear(spark: SparkSession, d: str) -> DataFrame:
    z = V.dot(F.col("embedding"), WEIGHTS)
    return vectors(spark, d).select("article_id", F.round(1 / (1 + F.exp(-z)), 6).alias("p"))


def lr_fit_relevance(spark: SparkSession, d: str) -> DataFrame:
    rows = H.sample_weights(voted(spark, d)).join(vectors(spark, d), "article_id")
    model = H.fit(rows, c=5.0)
    return H.probabilities(model, rows).select("article_id", "label", F.round("p", 4).alias("p"))


def lr_fit_urgency(spark: SparkSession, d: str) -> DataFrame:
    rows = H.balanced_weights(tagged_labels(spark, d)).join(vectors(spark, d), "article_id")
    model = H.fit(rows, c=1.0)
    return H.probabilities(model, rows).select("article_id", "label", F.round("p", 4).alias("p"))


def freshness_heads(spark: SparkSession, d: str) -> DataFrame:
    """Expected lifetimes by five heads; buckets are not stored, so ratings and the parity of the id stand in for them."""
    ratings = table(spark, d, "time_sensitivity").where("score between 1 and 5").select("article_id", (F.col("score") + F.when(F.pmod("article_id", F.lit(2)) == 0, 1).otherwise(0)).alias("bucket"))
    rows = ratings.join(vectors(spark, d), "article_id")
    return P.predicted(P.fit_heads(rows), rows).select("article_id", "bucket", F.round(P.expected_lifetime(F.col("buckets")), 1).alias("days"))


def _codec(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("packed", V.pack("embedding"))
    return rows.select("article_id", F.octet_length("packed").alias("bytes"), (V.unpack("packed") == F.col("embedding")).alias("same"))


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "urgency_inference").where("urgency_score is not null").select("article_id", "model_key", "last_updated", P.bucket_probabilities([F.col("urgency_score") * w for w in (0.9, 0.8, 0.6, 0.4, 0.2)]).alias("b"))
    return rows.select("article_id", "model_key", "last_updated", F.round(P.expected_lifetime(F.col("b")), 6).alias("days")).distinct()


SIZE = 20
METRICS = """g as (select p, sum(label) tp, sum(1 - label) fp from m group by p), c as (select *, sum(tp) over (order by p desc) ctp, sum(fp) over (order by p desc) cfp from g),
s as (select sum(tp) pp, sum(fp) nn, sum(tp) filter (p >= 0.5) a, sum(fp) filter (p >= 0.5) b, sum(tp * cfp) above, sum(tp * fp) beside, sum(tp * ctp / (ctp + cfp)::double) ap,
sum(-tp * ln(greatest(least(p, 1 - 1e-7), 1e-7)) - fp * ln(1 - greatest(least(p, 1 - 1e-7), 1e-7))) loss from c), t as (select *, coalesce(a, 0) tp, coalesce(b, 0) fp from s)
select round((tp + nn - fp) / (pp + nn), 6) accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) "precision", round(tp / pp, 6) recall, round(2 * tp / (tp + fp + pp), 6) f1,
round((pp * nn - above + 0.5 * beside) / (pp * nn), 6) roc_auc, round(ap / pp, 6) average_precision, round(loss / (pp + nn), 6) log_loss from (select tp::double tp, fp::double fp, pp::double pp, nn::double nn, above::double above, beside::double beside, ap, loss from t)"""

QUERIES = {
    "sample_weights": (lambda s, d: H.sample_weights(voted(s, d)).select("article_id", "label", "weight"), f"with {VOTED} select article_id, label, case when vote = 1 or coalesce(starred, false) then 3.0::double else 1.0::double end weight from voted"),
    "balanced_weights": (
        lambda s, d: H.balanced_weights(voted(s, d)).select("article_id", "label", F.round("weight", 6).alias("weight")),
        f"with {VOTED} select article_id, label, round((select count(*) from voted) / (2.0::double * count(*) over (partition by label)), 6) weight from voted",
    ),
    "class_counts": (lambda s, d: D.class_counts(voted(s, d)), f"with {VOTED} select label, count(*) \"rows\" from voted group by label"),
    "holdout_random": (
        lambda s, d: D.random_holdout(voted(s, d), SIZE).select("article_id", "label"),
        f"with {VOTED} select article_id, label from voted order by md5(article_id::varchar || '|42'), article_id limit {SIZE}",
    ),
    "holdout_stratified": (
        lambda s, d: D.stratified_holdout(voted(s, d), SIZE).select("article_id", "label"),
        f"""with {VOTED}, n as (select label, count(*) n, {SIZE} * count(*) / sum(count(*)) over ()::double x from voted group by label),
        q as (select label, floor(x) + case when row_number() over (order by floor(x) - x, -n, label) <= {SIZE} - sum(floor(x)) over () then 1 else 0 end q from n),
        r as (select article_id, label, row_number() over (partition by label order by md5(article_id::varchar || '|42'), article_id) rn from voted)
        select article_id, r.label from r join q on q.label = r.label where rn <= q""",
    ),
    "holdout_rest": (
        lambda s, d: D.rest_of(voted(s, d), D.random_holdout(voted(s, d), SIZE)).select("article_id", "label"),
        f"with {VOTED}, h as (select article_id from voted order by md5(article_id::varchar || '|42'), article_id limit {SIZE}) select article_id, label from voted where article_id not in (select article_id from h)",
    ),
    "linear_score": (_linear, f"with {VECTOR} select article_id, round(1 / (1 + exp(-list_dot_product(embedding::double[], {WEIGHTS}::double[]))), 6) p from v"),
    "prob_to_score": (lambda s, d: table(s, d, "urgency_inference").select("article_id", "model_key", "last_updated", S.to_score(F.col("urgency_score")).alias("score")), "select article_id, model_key, last_updated, cast(round_even(urgency_score * 100, 0) as int) score from urgency_inference"),
    "clip_prob": (lambda s, d: table(s, d, "urgency_inference").select("article_id", "model_key", "last_updated", S.clipped(F.col("urgency_score"), 0.25).alias("p")), "select article_id, model_key, last_updated, case when urgency_score is not null then greatest(least(urgency_score, 0.75), 0.25) end p from urgency_inference"),
    "byte_codec": (_codec, f"with {VECTOR} select article_id, cast(4 * len(embedding) as int) bytes, true same from v"),
    "vector_norms": (lambda s, d: vectors(s, d).select("article_id", F.round(V.norm(F.col("embedding")), 4).alias("norm")), f"with {VECTOR} select article_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 4) norm from v"),
    "binary_metrics": (lambda s, d: _rounded(M.binary_metrics(scored_labels(s, d))), f"with {VOTED}, {URGENCY}, m as (select label, urgency_score p from voted join urg using (article_id) where urgency_score is not null), {METRICS}"),
    "lr_fit_relevance": (lr_fit_relevance, None),
    "lr_fit_urgency": (lr_fit_urgency, None),
    "freshness_targets": (
        lambda s, d: table(s, d, "time_sensitivity").where("score between 1 and 5").select("article_id", *P.cumulative_targets(F.col("score"))),
        "select article_id, cast(score > 1 as int) over_1, cast(score > 2 as int) over_2, cast(score > 3 as int) over_3, cast(score > 4 as int) over_4, cast(score > 5 as int) over_5 from time_sensitivity where score between 1 and 5",
    ),
    "freshness_heads": (freshness_heads, None),
    "freshness_lifetime": (
        _buckets,
        """select distinct article_id, model_key, last_updated, round((1 - 0.9::double * u) * 0.5 + (0.9::double * u - 0.8::double * u) * 2 + (0.8::double * u - 0.6::double * u) * 5.5 + (0.6::double * u - 0.4::double * u) * 19
        + (0.4::double * u - 0.2::double * u) * 90 + 0.2::double * u * 365, 6) as "days" from (select *, urgency_score u from urgency_inference where urgency_score is not null)""",
    ),
    "dataset_fingerprint": (
        lambda s, d: P.fingerprint(voted(s, d).select("article_id", "label")),
        f"""with {VOTED}, h as (select md5(concat_ws('|', article_id::varchar, label::varchar)) h from voted),
        n as (select ('0x' || h[1:12])::bigint a, ('0x' || h[13:24])::bigint b from h)
        select count(*) "rows", sha256(count(*)::varchar || '|' || coalesce(sum(a), 0)::varchar || '|' || coalesce(bit_xor(b), 0)::varchar) fingerprint from n""",
    ),
    "chronological_holdout": (
        lambda s, d: D.newest_share(current(s, d, "published_at", "vote").where(F.col("vote").isin(-1, 1)), 0.3, "published_at", "id").select("id", "published_at"),
        f"with {CUR}, v as (select * from cur where vote in (-1, 1)) select id, published_at from v order by published_at desc nulls last, id desc limit (select cast(floor(count(*) * 0.3) as bigint) from v)",
    ),
}
