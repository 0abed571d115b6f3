"""Steps that make and change the stored relations, up and down.

A step works on a folder with a Parquet folder for each relation
(``<root>/<relation>.parquet``); the file ``migrations.json`` there holds the
number of the last step done.  Foreign keys cascade: what a step makes refers to
entries, and :func:`pruned` drops the rows whose entry is gone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from rankspark.operators.writes import cascade, keep_newest, with_constant
from rankspark.schema import RELATIONS
from rankspark.sinks import swap
from rankspark.sources import files, table

# Fixed value: the key that rows get which are older than the keys.
FIRST_KEY = "legacy-modernbert"


@dataclass(frozen=True)
class Step:
    name: str
    up: Callable[[SparkSession, str], None]
    down: Callable[[SparkSession, str], None]


def _path(root: str, relation: str) -> str:
    return f"{root}/{relation}.parquet"


def _relation(name: str, without: str = "") -> Step:
    """A relation made empty, and dropped."""
    columns = ", ".join(c for c in RELATIONS[name].columns.split(", ") if c.split()[0] != without)

    def up(spark: SparkSession, root: str) -> None:
        if files.exists(_path(root, name)):
            raise RuntimeError(f"{name} is there already")
        spark.createDataFrame([], columns).write.parquet(_path(root, name))

    def down(spark: SparkSession, root: str) -> None:
        if not files.exists(_path(root, name)):
            raise RuntimeError(f"there is no {name}")
        files.delete(_path(root, name))

    return Step(name, up, down)


def _keyed(spark: SparkSession, root: str) -> None:
    swap(with_constant(table(spark, root, "urgency_inference"), "model_key", FIRST_KEY), _path(root, "urgency_inference"))


def _unkeyed(spark: SparkSession, root: str) -> None:
    rows = table(spark, root, "urgency_inference")
    swap(keep_newest(rows, ["article_id"], ["last_updated", "model_key", "urgency_score"]).drop("model_key"), _path(root, "urgency_inference"))


STEPS = (
    _relation("time_sensitivity"),
    _relation("time_sensitivity_simplified"),
    _relation("urgency_inference", without="model_key"),
    _relation("relevance_embeddings"),
    Step("urgency_inference_model_key", _keyed, _unkeyed),
)


def version(root: str) -> int:
    """The number of the last step done."""
    at = f"{root}/migrations.json"
    return json.loads(files.read_text(at))["version"] if files.exists(at) else 0


def _done(root: str, number: int) -> None:
    files.write_text(f"{root}/migrations.json", json.dumps({"version": number}))


def up(spark: SparkSession, root: str, steps: int | None = None) -> int:
    """The next ``steps`` steps (all if none is given); the number of the last step done then."""
    at = version(root)
    for step in STEPS[at : len(STEPS) if steps is None else at + steps]:
        step.up(spark, root)
        at += 1
        _done(root, at)
    return at


def down(spark: SparkSession, root: str, steps: int | None = None) -> int:
    """The last ``steps`` steps undone (all if none is given)."""
    at = version(root)
    for step in STEPS[: at][::-1][: len(STEPS) if steps is None else steps]:
        step.down(spark, root)
        at -= 1
        _done(root, at)
    return at


def pruned(spark: SparkSession, root: str, relation: str, key: str = "article_id") -> None:
    """The relation without rows whose entry is gone."""
    swap(cascade(table(spark, root, relation), table(spark, root, "entries"), key), _path(root, relation))
