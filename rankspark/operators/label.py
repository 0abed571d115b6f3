"""Labels from a language model's answers: prompt, parse, validate, and a keyword stand-in.

The labeller is a parameter: a function from a list of prompts to a list of
answers, built once in each Python worker.  Answers that are no JSON object or
break the schema are rejects; they are kept apart, and the article stays
unlabelled, so a later run asks again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

CONFIDENCES = ("low", "medium", "high")


def answer_json(answer: Column) -> Column:
    """The text between code fences, if there are any."""
    bare = F.replace(F.replace(answer, F.lit("```json\n"), F.lit("")), F.lit("\n```"), F.lit(""))
    return F.trim(bare)


def parsed(answers: DataFrame, scores: tuple[int, ...], confidence: bool = False, answer: str = "answer") -> DataFrame:
    """``answers`` with score, explanation, (confidence,) and ``ok``.

    Strict: one JSON object without trailing text, an integer score in the
    domain (not a string), an explanation, and a known confidence if asked for.
    """
    schema = "score int, explanation string, confidence string"
    text = answer_json(F.col(answer))
    made = F.from_json(text, schema, {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"})
    rows = answers.withColumn("_j", F.when(text.rlike(r"(?s)^\{.*\}$") & (F.json_object_keys(text).isNotNull()), made))
    # an explanation must be a JSON string: numbers and objects would be turned into text
    string = F.get_json_object(text, "$.explanation").isNotNull() & text.rlike(r'(?s)"explanation"\s*:\s*"')
    ok = F.coalesce(F.col("_j.score").isin(*scores), F.lit(False)) & F.col("_j.explanation").isNotNull() & F.coalesce(string, F.lit(False))
    if confidence:
        ok &= F.coalesce(F.col("_j.confidence").isin(*CONFIDENCES), F.lit(False))
    columns = {"score": F.col("_j.score"), "explanation": F.col("_j.explanation")} | ({"confidence": F.col("_j.confidence")} if confidence else {})
    return rows.withColumns({**columns, "ok": ok}).drop("_j")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("ok").drop("ok")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("not ok").drop("ok")


def keyword_labeller() -> Callable[[list[str]], list[str]]:
    """A labeller by cues, for trying pipelines out: it reads the title and text of :data:`SCALE_PROMPT` or a like prompt."""

    def one(prompt: str) -> str:
        text = prompt[prompt.find("Title: ") :].lower()
        found = [k for k, cues in CUES.items() if any(re.search(rf"\b{c}\b", text) for c in cues)]
        return json.dumps({"score": max(found, default=1), "confidence": "low", "explanation": "by the words it uses"})

    return lambda prompts: [one(p) for p in prompts]


def answers(prompts: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], key: str = "article_id", prompt: str = "prompt", batch: int = 10) -> DataFrame:
    """(key, answer) by a labeller that each Python worker builds once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = make()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label(part.column(1).to_pylist()), pa.string())], names=[key, "answer"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, answer string")


# Cues of the five steps of the rating scale.
CUES = {
    1: ("history of", "profile", "explainer", "deep dive"),
    2: ("analysis", "opinion", "trend", "culture"),
    3: ("debate", "upcoming", "policy", "investigation"),
    4: ("announces", "reports", "wins", "results", "verdict"),
    5: ("live", "breaking", "unfolding", "evacuation", "alert"),
}
#: What each step says of a text, and how long it keeps.
STEPS = {
    1: "evergreen: history, lives, basics explained; keeps for years",
    2: "low: features, trends and views; keeps for months",
    3: "medium: something under way without hurry; keeps for days or weeks",
    4: "high: one recent event; out of date in a day or two",
    5: "critical: told while it happens; out of date in hours",
}
SCALE_PROMPT = "\n".join([
    "Rate how soon this article is out of date, whatever its weight, from 1 to 5:",
    *(f"{k} - {STEPS[k]} (typical words: {', '.join(CUES[k])})" for k in STEPS),
    'Answer with one JSON object and nothing else: {"score": 1 to 5, "confidence": "low", "medium" or "high", "explanation": one sentence}',
    "Title: {title}",
    "Text: {content}",
])


def keyword_score(text: Column) -> Column:
    """A rating from 1 (evergreen, or no cue) to 5 by the most urgent cue in the text: a deterministic stand-in for a language model."""
    low, out = F.lower(text), None
    for score in sorted(CUES, reverse=True):
        hit = low.rlike(rf"\b({'|'.join(CUES[score])})\b")
        out = F.when(hit, score) if out is None else out.when(hit, score)
    return out.otherwise(1).cast("int")
