"""Schemas of the relations, their keys, and the checks on their rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Relation:
    """A stored relation: DDL of its columns, key columns, and named checks that hold for each row."""

    columns: str
    key: tuple[str, ...]
    checks: dict[str, str] = field(default_factory=dict)


RELATIONS = {
    "entries": Relation(
        "id long, feed_id long, title string, content string, url string, author string, published_at timestamp_ntz, "
        "changed_at timestamp_ntz, status string, vote int, starred boolean, score int, tags array<string>",
        ("id",),
        {"status": "status in ('read', 'unread', 'removed')", "vote": "vote in (-1, 0, 1)"},
    ),
    "feeds": Relation("id long, title string", ("id",)),
    "user_tags": Relation("id long, user_id int, title string", ("id",)),
    "entry_user_tags": Relation("entry_id long, user_tag_id long", ("entry_id", "user_tag_id")),
    "time_sensitivity": Relation(
        "article_id long, score int, last_updated timestamp_ntz, confidence string, explanation string",
        ("article_id",),
        {"score": "score between 1 and 5", "confidence": "confidence in ('low', 'medium', 'high')"},
    ),
    "time_sensitivity_simplified": Relation(
        "article_id long, score short, explanation string, last_updated timestamp_ntz", ("article_id",), {"score": "score in (0, 1)"}
    ),
    "urgency_inference": Relation(
        "article_id long, model_key string, urgency_score double, last_updated timestamp_ntz",
        ("article_id", "model_key"),
        {"urgency_score": "urgency_score between 0 and 1"},
    ),
    "relevance_embeddings": Relation(
        "article_id long, model_name string, max_length int, text_prep_mode string, prep_version int, text_hash string, "
        "embedding array<float>, last_updated timestamp_ntz",
        ("article_id", "model_name", "max_length", "text_prep_mode", "prep_version"),
    ),
    "model_evals": Relation(
        "eval_date date, model string, training map<string,int>, eval map<string,int>, metrics_accuracy double, "
        "metrics_precision double, metrics_recall double, metrics_f1 double, metrics_roc_auc double, "
        "metrics_average_precision double, metrics_log_loss double",
        (),
    ),
}

#: Columns of an article as the readers give it.
ARTICLE = (
    "article_id", "title", "starred", "feed_name", "content", "link", "author", "date_entered",
    "last_read", "time_sensitivity_score", "tags", "vote", "status",
)


def broken_checks(relation: str) -> Column:
    """Names of the checks that a row breaks, in the order of the relation.  As in SQL, a null breaks none."""
    checks = RELATIONS[relation].checks
    names = [F.when(~F.expr(test), F.lit(name)) for name, test in checks.items()]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def violations(df: DataFrame, relation: str) -> DataFrame:
    """(check, rows): rows of ``df`` that break each check; checks that hold everywhere are absent."""
    return df.select(F.explode(broken_checks(relation)).alias("check")).groupBy("check").agg(F.count("*").alias("rows"))


def valid(df: DataFrame, relation: str) -> DataFrame:
    """The rows that break no check."""
    return df.where(F.size(broken_checks(relation)) == 0)


def asserted(df: DataFrame, relation: str) -> DataFrame:
    """The same rows; running it fails at the first row that breaks a check."""
    broken = F.array_join(broken_checks(relation), ", ")
    return df.where(F.when(broken == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{relation}: broken check "), broken)).isNull()))
