"""Logistic-regression heads on embeddings: weights, fit, scores, artifacts.

Spark's objective is the weighted mean loss plus an L2 term; the usual one is C
times the weighted sum of losses plus half the squared norm.  Both have the same
optimum for ``regParam = 1 / (C * sum of weights)`` without standardisation.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame

from rankspark.functions.scores import clipped
from rankspark.sources import files


def sample_weights(rows: DataFrame, excellent: float = 3.0) -> DataFrame:
    """``rows`` with ``weight``: ``excellent`` for an upvote or a star, whatever the label; 1 otherwise, nulls included."""
    best = F.coalesce(F.col("vote") == 1, F.lit(False)) | F.coalesce("starred", F.lit(False))
    return rows.withColumn("weight", F.when(best, F.lit(excellent)).otherwise(F.lit(1.0)))


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with ``weight``: n / (2 * rows of the class), so that both classes weigh the same."""
    rows = rows.drop("weight")
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*")).scalar()
    weights = counts.select(label, (total / (2.0 * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)  # a row for each class


def fit(rows: DataFrame, c: float, max_iter: int = 4000, intercept: bool = True, features: str = "embedding", label: str = "label", weight: str = "weight") -> LogisticRegressionModel:
    """The L2-regularised head of (features array, label, weight); an error if a class has no row."""
    made = rows.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"))
    made = made.persist()
    try:
        sums = made.agg(F.sum("weight"), F.count_distinct("label")).first()
        if sums[1] != 2:
            raise RuntimeError("both classes need rows")
        return LogisticRegression(regParam=1 / (c * sums[0]), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10, fitIntercept=intercept, weightCol="weight").fit(made)
    finally:
        made.unpersist()


def probabilities(model: LogisticRegressionModel, rows: DataFrame, features: str = "embedding") -> DataFrame:
    """``rows`` with ``p``, the clipped probability of class 1; rows without features get null."""
    rows = rows.drop("p")
    model = model.copy().setFeaturesCol("_x").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")
    ready = rows.withColumn("_x", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    none = rows.where(F.col(features).isNull()).withColumn("p", F.lit(None).cast("double"))
    scored = model.transform(ready.where(F.col(features).isNotNull()))
    return scored.withColumn("p", clipped(vector_to_array("_probability")[1])).select(*rows.columns, "p").unionByName(none)


# --- artifacts: a folder with the model and its metadata ---

NAME = re.compile(r"^(?P<prefix>.+)_(?P<date>\d{4}[-_]\d{2}[-_]\d{2})_(?P<counts>\d+(?:_[a-z]+)?(?:_\d+(?:_[a-z]+)?)*)$")


@dataclass(frozen=True)
class Artifact:
    path: str
    date: str
    counts: tuple[int, ...]


def artifact_path(root: str, prefix: str, date: str, **counts: int) -> str:
    return f"{root}/{prefix}_{date}_" + "_".join(f"{n}_{name}" for name, n in counts.items())


def save(model: LogisticRegressionModel, path: str, **metadata) -> None:
    model.write().overwrite().save(f"{path}/classifier")
    files.write_text(f"{path}/metadata.json", json.dumps(metadata, indent=2, sort_keys=True))


def load(path: str) -> tuple[LogisticRegressionModel, dict]:
    return LogisticRegressionModel.load(f"{path}/classifier"), json.loads(files.read_text(f"{path}/metadata.json"))


def artifacts(root: str, prefix: str) -> list[Artifact]:
    """Models of a prefix, oldest first: by date, then by counts as numbers (not as text)."""
    found = []
    for name in files.names(root, folders=True):
        m = NAME.match(name)
        if m and m["prefix"] == prefix:
            found.append(Artifact(f"{root}/{name}", m["date"].replace("_", "-"), tuple(map(int, re.findall(r"\d+", m["counts"])))))
    return sorted(found, key=lambda a: (a.date, a.counts, a.path))


def latest_artifact(root: str, prefix: str, clean_old: bool = True) -> str:
    """The newest model of a prefix; older ones are deleted unless they are to stay."""
    found = artifacts(root, prefix)
    if not found:
        raise FileNotFoundError(f"no model {prefix} in {root}")
    if clean_old:
        for old in found[:-1]:
            files.delete(old.path)
    return found[-1].path


def clean_checkpoints(path: str) -> int:
    """Delete the folders ``checkpoint-*`` of a path; how many there were."""
    old = [name for name in files.names(path, folders=True) if name.startswith("checkpoint-")]
    for name in old:
        files.delete(f"{path}/{name}")
    return len(old)


EVALUATION = "eval_"


def clean_evaluations(root: str) -> int:
    """Delete the folders ``eval_*`` that a broken evaluation left below ``root``; how many there were."""
    old = [name for name in files.names(root, folders=True) if name.startswith(EVALUATION)]
    for name in old:
        files.delete(f"{root}/{name}")
    return len(old)


@contextmanager
def evaluation_folder(root: str) -> Iterator[str]:
    """A folder for the models of one evaluation, which goes with it."""
    path = f"{root}/{EVALUATION}{uuid.uuid4().hex}"
    files.make_folder(path)
    try:
        yield path
    finally:
        files.delete(path)
