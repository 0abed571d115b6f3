"""Pipelines end to end: refresh the scores, train, evaluate, label and tag.

Each takes its tables as DataFrames and one clock, and gives DataFrames or
models; writing them is up to the caller (:mod:`rankspark.sinks`), so a run can
be repeated.  The encoded articles are used by both heads and are stored once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

import pyspark.sql.functions as F
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame

from rankspark.config import Config
from rankspark.functions import scores as S
from rankspark.functions import text as T
from rankspark.operators import label as L
from rankspark.operators import metrics as M
from rankspark.operators import model as H
from rankspark.operators import select as R
from rankspark.operators import splits as D
from rankspark.operators import writes as U
from rankspark.operators.cache import encode_with_cache
from rankspark.operators.encode import Encoder
from rankspark.sources import files
from rankspark.sources.shared import stored


@dataclass(frozen=True)
class Tables:
    entries: DataFrame
    feeds: DataFrame
    time_sensitivity: DataFrame
    urgency_inference: DataFrame
    relevance_embeddings: DataFrame
    user_tags: DataFrame
    entry_user_tags: DataFrame

    def articles(self, since: Column | None = None) -> DataFrame:
        """All articles, published from ``since`` on, with what the readers filter on: no text moves here."""
        return R.articles(R.current_entries(self.entries, *R.NARROW, since=since), self.feeds, self.time_sensitivity)

    def completed(self, rows: DataFrame) -> DataFrame:
        """What a reader left, with titles, contents and the rest."""
        return R.completed(rows, self.entries, "title", "content", "url", "author", "tags")


def texts(rows: DataFrame, config: Config) -> DataFrame:
    return rows.withColumn("text", T.prepared(config.relevance_text_prep_mode, F.col("title"), F.col("content"), config.relevance_max_length))


def embedded(rows: DataFrame, tables: Tables, config: Config, make: Callable[[], Encoder], dimensions: int, at: datetime | str) -> tuple[DataFrame, DataFrame]:
    """(rows with embeddings, new cache rows), both stored."""
    out, fresh = encode_with_cache(texts(rows, config).drop("content"), tables.relevance_embeddings, config.cache_key, make, dimensions, at)
    out, _ = stored(out.drop("text"), "encoded")
    keys = {c: F.lit(v) for c, v in config.cache_key.items()}
    new = out.where("cache_state <> 'hit' and text_hash is not null").select("article_id", "text_hash", "embedding").withColumns({**keys, "last_updated": R.clock(at), "ordinal": F.lit(0)})
    return out, new


@dataclass(frozen=True)
class Refresh:
    scores: DataFrame  # article_id, relevance, urgency_score, score
    entries: DataFrame  # the new state of entries
    urgency_inference: DataFrame
    relevance_embeddings: DataFrame


def active_articles(tables: Tables, config: Config, as_of: datetime | str) -> DataFrame:
    """The active set, each article once, with clean titles and contents."""
    rows = tables.articles(R.days_before(as_of, max(config.lookback_days, config.max_lookback_days)))
    active = R.active_set(rows, as_of, config.lookback_days, config.max_lookback_days, config.sampling).dropDuplicates(["article_id"])
    return tables.completed(active).withColumn("title", T.clean_title(F.col("title")))


def refresh(tables: Tables, relevance: LogisticRegressionModel, urgency: LogisticRegressionModel, config: Config, make: Callable[[], Encoder], dimensions: int, as_of: datetime | str) -> Refresh:
    """Score the active set: relevance decayed by an urgency-dependent half-life.  An empty set changes nothing."""
    rows, fresh = embedded(active_articles(tables, config, as_of), tables, config, make, dimensions, as_of)
    urgent = H.probabilities(urgency, rows).withColumnRenamed("p", "urgency_score")
    both = H.probabilities(relevance, urgent).withColumn("relevance", S.to_score(F.col("p")))
    decayed = S.decayed(F.col("relevance"), S.age_days(R.clock(as_of), F.col("date_entered")), F.col("urgency_score"), config.half_life_evergreen, config.half_life_urgent)
    scores, _ = stored(both.select("article_id", "relevance", "urgency_score", decayed.alias("score")), "scores")
    inferred = scores.select("article_id", F.lit(config.urgency_model_key).alias("model_key"), "urgency_score", R.clock(as_of).alias("last_updated"), F.lit(0).alias("ordinal"))
    return Refresh(scores, scored_entries(tables, scores), U.upsert_urgency(tables.urgency_inference, inferred), U.upsert_embeddings(tables.relevance_embeddings, fresh))


def scored_entries(tables: Tables, scores: DataFrame) -> DataFrame:
    """The entries with new scores, from (article_id, score).  Entries kept in buckets take them by
    :func:`rankspark.sinks.update_buckets`, which leaves the other buckets alone."""
    return U.update(tables.entries, scores.select(F.col("article_id").alias("id"), "score", F.lit(0).alias("ordinal")), "id", "score")


def relevance_set(tables: Tables, config: Config, as_of: datetime | str, held_out: bool = False) -> DataFrame:
    """Good (label 1) and bad (label 0) articles with weights: the training part, or the hold-out of the oldest ids."""
    k = config.validation_size
    take = (lambda rows: R.first_k(rows, k)) if held_out else (lambda rows: R.skip_k(rows, k))
    rows = tables.articles(R.months_before(as_of, 36))
    both = take(R.good(rows, as_of)).withColumn("label", F.lit(1)).unionByName(take(R.bad(rows, as_of)).withColumn("label", F.lit(0)))
    return H.sample_weights(tables.completed(both), config.excellent_weight)


def urgency_set(tables: Tables) -> DataFrame:
    rows = R.tagged(tables.articles(), tables.entry_user_tags, tables.user_tags, read_only=True)
    return tables.completed(rows).withColumnRenamed("urgency_label", "label")


def train_relevance(tables: Tables, config: Config, make: Callable[[], Encoder], dimensions: int, as_of: datetime | str) -> tuple[LogisticRegressionModel, DataFrame | None]:
    """The head, and the metrics on the hold-out if one is asked for."""
    rows, _ = embedded(relevance_set(tables, config, as_of), tables, config, make, dimensions, as_of)
    model = H.fit(rows, config.relevance_linear_c)
    if not config.validation_size:
        return model, None
    held, _ = embedded(relevance_set(tables, config, as_of, held_out=True), tables, config, make, dimensions, as_of)
    return model, M.binary_metrics(H.probabilities(model, held).select("label", "p"))


def train_urgency(tables: Tables, config: Config, make: Callable[[], Encoder], dimensions: int, as_of: datetime | str) -> tuple[LogisticRegressionModel, DataFrame | None]:
    rows, _ = embedded(urgency_set(tables), tables, config, make, dimensions, as_of)
    held = D.stratified_holdout(rows, config.validation_size)
    train = D.rest_of(rows, held) if config.validation_size else rows
    model = H.fit(H.balanced_weights(train), config.urgency_linear_c)
    return model, M.binary_metrics(H.probabilities(model, held).select("label", "p")) if config.validation_size else None


def evaluate_relevance(tables: Tables, config: Config, make: Callable[[], Encoder], dimensions: int, as_of: datetime | str, seed: int = 42) -> DataFrame | None:
    """Metrics of a head trained without a random hold-out of ``validation_size`` articles a class; none if a class has fewer."""
    k = config.validation_size
    rows, _ = embedded(relevance_set(tables, Config(**{**config.__dict__, "validation_size": 0}), as_of), tables, config, make, dimensions, as_of)
    counts = {r[0]: r[1] for r in D.class_counts(rows).collect()}
    if not k or min(counts.values()) < k:
        return None
    held = D.random_holdout(rows.where("label = 1"), k, seed=seed).unionByName(D.random_holdout(rows.where("label = 0"), k, seed=seed))
    model = H.fit(D.rest_of(rows, held), config.relevance_linear_c)
    return M.binary_metrics(H.probabilities(model, held).select("label", "p"))


def evaluate_urgency(tables: Tables, config: Config, make: Callable[[], Encoder], dimensions: int, as_of: datetime | str) -> DataFrame | None:
    """Metrics of a head trained without a stratified hold-out; none without rows, with too few of them, or a class of fewer than two."""
    k = config.validation_size
    rows, _ = embedded(urgency_set(tables), tables, config, make, dimensions, as_of)
    counts = [r[1] for r in D.class_counts(rows).collect()]
    if k < 2 or sum(counts) <= k or min(counts) < 2:
        return None
    held = D.stratified_holdout(rows, k)
    model = H.fit(H.balanced_weights(D.rest_of(rows, held)), config.urgency_linear_c)
    return M.binary_metrics(H.probabilities(model, held).select("label", "p"))


def load_or_train(path: str, train: Callable[[], LogisticRegressionModel], **metadata) -> LogisticRegressionModel:
    """The model at ``path``, trained and saved there first if there is none."""
    if not files.exists(path):
        H.save(train(), path, **metadata)
    return H.load(path)[0]


def infer(tables: Tables, model: LogisticRegressionModel, config: Config, make: Callable[[], Encoder], dimensions: int, as_of: datetime | str, days: int = 14) -> DataFrame:
    """(article_id, p, score) of the recent unread articles by one head, without decay."""
    recent = R.recent_unread(tables.articles(R.days_before(as_of, days)), as_of, days)
    rows = tables.completed(recent).withColumn("title", T.clean_title(F.col("title")))
    rows, _ = embedded(rows, tables, config, make, dimensions, as_of)
    return H.probabilities(model, rows).select("article_id", "p", S.to_score(F.col("p")).alias("score"))


def checked_device(allowed_without: bool, present: bool | None = None) -> None:
    """An error unless there is a GPU or the settings allow going on without; a missing driver library counts as none."""
    if present is None:
        try:
            from torch import cuda

            present = cuda.is_available()
        except ImportError:
            present = False
    if not present and not allowed_without:
        raise RuntimeError("no GPU is there, and the settings don't allow going on without")


def infer_relevance(tables: Tables, models: str, config: Config, make: Callable[[], Encoder], dimensions: int, as_of: datetime | str, days: int = 14, gpu: bool | None = None) -> DataFrame:
    """:func:`infer` by the newest relevance head below ``models``; older ones are deleted."""
    checked_device(config.allow_inference_wo_gpu, gpu)
    head, _ = H.load(H.latest_artifact(models, config.relevance_family))
    return infer(tables, head, config, make, dimensions, as_of, days)


def infer_urgency(tables: Tables, models: str, config: Config, make: Callable[[], Encoder], dimensions: int, as_of: datetime | str, gpu: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(new state of the stored urgency, new state of the cache): the active set by the newest urgency head, under the key
    of the configuration.  An empty set changes nothing and needs no head."""
    rows, fresh = embedded(active_articles(tables, config, as_of), tables, config, make, dimensions, as_of)
    if not rows.head(1):
        return tables.urgency_inference, tables.relevance_embeddings
    checked_device(config.allow_inference_wo_gpu, gpu)
    head, _ = H.load(H.latest_artifact(models, config.urgency_family))
    scored = H.probabilities(head, rows).select("article_id", F.lit(config.urgency_model_key).alias("model_key"), F.col("p").alias("urgency_score"), R.clock(as_of).alias("last_updated"), F.lit(0).alias("ordinal"))
    return U.upsert_urgency(tables.urgency_inference, scored), U.upsert_embeddings(tables.relevance_embeddings, fresh)


def evaluation_row(metrics: DataFrame, model: str, on: str, training: dict[str, int], evaluation: dict[str, int]) -> DataFrame:
    """The row of the history of evaluations."""
    counts = lambda d: F.create_map(*[x for k, n in d.items() for x in (F.lit(k), F.lit(n))]).cast("map<string,int>")
    named = [F.col(c).alias(f"metrics_{c}") for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "log_loss")]
    return metrics.select(F.lit(on).cast("date").alias("eval_date"), F.lit(model).alias("model"), counts(training).alias("training"), counts(evaluation).alias("eval"), *named)


PROMPT = "Rate how soon this article is out of date.\nTitle: {title}\nText: {content}\nAnswer with a JSON object with score and explanation."


def label_answers(rows: DataFrame, labeller: Callable[[], Callable[[list[str]], list[str]]], template: str = PROMPT, window: int = 1024, answer_words: int = 150) -> DataFrame:
    """(article_id, answer): prompts whose content is cut to what the model's window leaves."""
    title = F.coalesce("title", F.lit(""))
    content = T.prompt_content(T.strip_markup(F.coalesce("content", F.lit(""))), window, len(template.split()), F.size(F.split(title, r"\s+")), answer_words)
    return L.answers(rows.select("article_id", T.prompt(template, title, content).alias("prompt")), labeller)


def label_simplified(tables: Tables, labels: DataFrame, labeller: Callable[[], Callable[[list[str]], list[str]]], as_of: datetime | str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new label rows, new tag links, rejects) for the articles of the last six months without a label."""
    rows = tables.completed(R.without_simplified(tables.articles(R.months_before(as_of, 6)), labels, as_of))
    parsed, _ = stored(L.parsed(label_answers(rows, labeller), (0, 1)), "answers")
    good = L.accepted(parsed)
    new = good.select("article_id", F.col("score").cast("short").alias("score"), "explanation", R.clock(as_of).alias("last_updated"))
    links = U.assign_tags(tables.entry_user_tags, tables.user_tags, good.select("article_id", F.col("score").alias("label"), F.lit(0).alias("ordinal")))
    return new, links, L.rejected(parsed)


def label_time_sensitivity(tables: Tables, labeller: Callable[[], Callable[[list[str]], list[str]]], as_of: datetime | str, days: int = 14) -> tuple[DataFrame, DataFrame]:
    """(new rows of ``time_sensitivity``, rejects) for the articles of the last ``days`` days that have none.

    An answer needs a score from 1 to 5, a known confidence and an explanation; an
    article with another answer stays without a row and is asked for again.
    """
    recent = R.without_time_sensitivity(tables.articles(R.days_before(as_of, days)), tables.time_sensitivity, as_of, days)
    rows = tables.completed(recent).withColumn("title", T.clean_title(F.col("title")))
    parsed, _ = stored(L.parsed(label_answers(rows, labeller, L.SCALE_PROMPT, answer_words=200), (1, 2, 3, 4, 5), confidence=True), "answers")
    new = L.accepted(parsed).select("article_id", "score", R.clock(as_of).alias("last_updated"), "confidence", "explanation")
    return new, L.rejected(parsed)
