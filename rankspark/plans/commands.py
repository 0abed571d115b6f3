"""The pipelines as commands.

    python -m rankspark train --data /lake/reader --models /lake/models --encoder my.module:make

``--data`` is a folder with a Parquet folder for each relation, ``--models`` one for
the heads.  Settings come from the environment (:class:`rankspark.config.Config`).
``--encoder`` and ``--labeller`` name functions without parameters that make an
encoder or a labeller in a worker; without them the stand-ins are used.  New
states are swapped in; with several in one command each is complete before the
first is swapped.
"""

from __future__ import annotations

import argparse
import functools
import logging
import logging.config
import os
from collections.abc import Callable
from datetime import UTC, datetime
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from rankspark import sinks
from rankspark.config import Config
from rankspark.operators import model as H
from rankspark.operators import splits as D
from rankspark.operators.encode import HashingEncoder
from rankspark.operators.label import keyword_labeller
from rankspark.operators.writes import append_unique
from rankspark.plans import migrations
from rankspark.plans import pipelines as P
from rankspark.schema import RELATIONS
from rankspark.session import ship
from rankspark.sources import files, table
from rankspark.sources.shared import clean_stored, stored

log = logging.getLogger("rankspark")


class Run:
    """One command: its session, tables, settings and clock."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.root, self.models, self.as_of, self.days = spark, args.data, args.models, args.as_of, args.days
        self.config = Config.from_env()
        self.make = _named(args.encoder) if args.encoder else functools.partial(HashingEncoder, args.dimensions)
        self.labeller = _named(args.labeller) if args.labeller else keyword_labeller
        self.dimensions = args.dimensions

    def relation(self, name: str) -> DataFrame:
        if files.exists(f"{self.root}/{name}.parquet"):
            return table(self.spark, self.root, name)
        return self.spark.createDataFrame([], RELATIONS[name].columns)

    @functools.cached_property
    def tables(self) -> P.Tables:
        return P.Tables(*map(self.relation, ("entries", "feeds", "time_sensitivity", "urgency_inference", "relevance_embeddings", "user_tags", "entry_user_tags")))

    @property
    def encoder(self) -> tuple:
        return self.config, self.make, self.dimensions, self.as_of

    def swap(self, **states: DataFrame) -> None:
        ready = {name: stored(df, name)[0] for name, df in states.items()}
        for name, df in ready.items():
            sinks.swap(df, f"{self.root}/{name}.parquet")
        self.__dict__.pop("tables", None)

    def save(self, head, family: str, rows: DataFrame) -> str:
        counts = {r[0]: r[1] for r in D.class_counts(rows).collect()}
        path = H.artifact_path(self.models, family, str(self.as_of)[:10], good=counts[1], bad=counts[0])
        H.save(head, path, family=family, counts={str(k): n for k, n in counts.items()})
        H.clean_checkpoints(path)
        return path


def _named(text: str) -> Callable:
    module, _, name = text.partition(":")
    return getattr(import_module(module), name)


def train(run: Run) -> str:
    """Fit the relevance head and save it."""
    P.checked_device(run.config.allow_training_wo_gpu)
    head, metrics = P.train_relevance(run.tables, *run.encoder)
    if metrics is not None:
        log.info("hold-out: %s", metrics.first().asDict())
    return run.save(head, run.config.relevance_family, P.relevance_set(run.tables, run.config, run.as_of))


def train_urgency(run: Run) -> str:
    """Fit the urgency head and save it."""
    P.checked_device(run.config.allow_training_wo_gpu)
    head, metrics = P.train_urgency(run.tables, *run.encoder)
    if metrics is not None:
        log.info("hold-out: %s", metrics.first().asDict())
    return run.save(head, run.config.urgency_family, P.urgency_set(run.tables))


def infer(run: Run) -> int:
    """Score the recent unread articles by the newest relevance head, without decay."""
    found, _ = stored(P.infer_relevance(run.tables, run.models, *run.encoder, run.days), "scores")
    run.swap(entries=P.scored_entries(run.tables, found))
    return found.count()


def infer_urgency(run: Run) -> int:
    """Score the active set by the newest urgency head and store it under the configuration's key."""
    urgency, cache = P.infer_urgency(run.tables, run.models, *run.encoder)
    run.swap(urgency_inference=urgency, relevance_embeddings=cache)
    return run.tables.urgency_inference.count()


def full_infer(run: Run) -> int:
    """Score the active set by both heads, decayed."""
    P.checked_device(run.config.allow_inference_wo_gpu)
    heads = [H.load(H.latest_artifact(run.models, family))[0] for family in (run.config.relevance_family, run.config.urgency_family)]
    done = P.refresh(run.tables, *heads, *run.encoder)
    run.swap(entries=done.entries, urgency_inference=done.urgency_inference, relevance_embeddings=done.relevance_embeddings)
    return done.scores.count()


def time(run: Run) -> int:
    """Ask for a rating from 1 to 5 of the recent articles without one."""
    new, _ = P.label_time_sensitivity(run.tables, run.labeller, run.as_of, run.days)
    run.swap(time_sensitivity=append_unique(run.tables.time_sensitivity, new, ["article_id"]))
    return new.count()


def time_simple(run: Run) -> int:
    """Ask for a rating of 0 or 1 of the articles without one, and tag them."""
    labels = run.relation("time_sensitivity_simplified")
    new, links, _ = P.label_simplified(run.tables, labels, run.labeller, run.as_of)
    run.swap(time_sensitivity_simplified=append_unique(labels, new, ["article_id"]), entry_user_tags=run.tables.entry_user_tags.unionByName(links))
    return new.count()


def evaluate(run: Run) -> int:
    """Metrics of heads trained without a hold-out, appended to the history."""
    rows = 0
    H.clean_evaluations(run.models)
    for name, on, labelled in (("relevance", P.evaluate_relevance, lambda: P.relevance_set(run.tables, Config(**{**run.config.__dict__, "validation_size": 0}), run.as_of)), ("urgency", P.evaluate_urgency, lambda: P.urgency_set(run.tables))):
        metrics = on(run.tables, *run.encoder)
        if metrics is None:
            log.warning("%s: too few rows for a hold-out of %d", name, run.config.validation_size)
            continue
        counts = {str(r[0]): r[1] for r in D.class_counts(labelled()).collect()}
        row = P.evaluation_row(metrics, name, str(run.as_of)[:10], counts, {"held_out": run.config.validation_size})
        sinks.append(row, f"{run.root}/model_evals.parquet")
        rows += 1
    return rows


COMMANDS: dict[str, Callable[[Run], object]] = {
    "train": train,
    "train_urgency": train_urgency,
    "infer": infer,
    "infer_urgency": infer_urgency,
    "full_infer": full_infer,
    "time": time,
    "time_simple": time_simple,
    "eval": evaluate,
    "up": lambda run: migrations.up(run.spark, run.root, 1),
    "down": lambda run: migrations.down(run.spark, run.root, 1),
    "up_all": lambda run: migrations.up(run.spark, run.root),
    "down_all": lambda run: migrations.down(run.spark, run.root),
    "clean": lambda run: clean_stored(run.spark, 24 * run.days),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rankspark", description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--data", required=True)
    parser.add_argument("--models", default="models")
    parser.add_argument("--as-of", default=None, help="the clock; now if not given")
    parser.add_argument("--days", type=int, default=14)
    parser.add_argument("--encoder", default="")
    parser.add_argument("--labeller", default="")
    parser.add_argument("--dimensions", type=int, default=64)
    args = parser.parse_args(argv)
    args.as_of = args.as_of or str(datetime.now(UTC).replace(tzinfo=None))
    settings = Config.from_env().logging_config
    if os.path.exists(settings):
        logging.config.fileConfig(settings, disable_existing_loggers=False)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    log.info("%s: %s", args.command, COMMANDS[args.command](Run(spark, args)))
    return 0
