"""Mixing sources to target weights by balanced sampling (the cube method).

The size of the mix is the number of tokens of all documents of the listed
sources, each taken once.  A source whose target is ``r`` times what it has uses
each document ``floor(r)`` times and draws the fraction that is left with equal
inclusion probabilities; a source with ``r`` above its ``max_repeats`` uses
every document that often and can't reach its target.

The draw is balanced on the number of documents and on tokens.  Flight phase:
among three documents with open probabilities there is one direction that
changes neither the sum of probabilities nor that of tokens; go along it, to
either side at random so that expectations stay, until a probability is 0 or 1,
and take the next document in.  It runs in parallel on salted chunks of each
source, which leave two open documents each, and in rounds of chunks on what is
left until that is one chunk a source at most.  Two of it and some that were
kept go to the landing phase, which rounds them so that the tokens come closest
to the target.

A source's tokens therefore miss its target by less than the size of its two
largest documents, whatever the number of documents.

Nulls: documents with a null id, null or unlisted source are left out, and so
are those without tokens (null, empty text): they add nothing.  A null share
counts as 0, null ``max_repeats`` as 1, repeated rows of a target as the first
by share and repeats.  Repeated ids are separate documents.  Empty documents or
targets give an empty mix; each target stays in the report.  Extra columns are
ignored.  The same input and seed give the same mix.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame, Window

from rankspark.llm.encode import RANKS, token_counts
from rankspark.sources.shared import stored

CHUNK = 4096
#: Documents of each source that skip the flight and land with the last two: 2^16 ways at most.
KEPT = 14
_DUST = 1e-9


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved to 0 or 1 but for two at most; the sums of ``p`` and ``p * tokens`` stay."""
    p = p.astype(float).tolist()
    t = tokens.astype(float).tolist()
    rest = [k for k in range(len(p)) if _DUST < p[k] < 1 - _DUST][::-1]
    draws, at = rng.random(len(rest) + 1).tolist(), 0
    open_: list[int] = []
    while True:
        while len(open_) < 3 and rest:
            open_.append(rest.pop())
        if len(open_) < 3:
            break
        i, j, k = open_
        u = (t[k] - t[j], t[i] - t[k], t[j] - t[i])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for x, v in zip(open_, u):
            if v > 0:
                up, down = min(up, (1 - p[x]) / v), min(down, p[x] / v)
            elif v < 0:
                up, down = min(up, -p[x] / v), min(down, -(1 - p[x]) / v)
        step = up if draws[at] < down / (up + down) else -down
        at += 1
        for x, v in zip(open_, u):
            p[x] += step * v
            if p[x] < _DUST or p[x] > 1 - _DUST:
                p[x] = float(round(p[x]))
        before = len(open_)
        open_ = [x for x in open_ if 0 < p[x] < 1]
        assert len(open_) < before
    return np.array(p)


def landing(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The few open probabilities rounded so that the tokens come closest to their expectation.

    All ways are tried; ties go to the number of documents closest to its
    expectation, then to the first documents left out.
    """
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    off = np.abs(ways @ tokens[left] - (p[left] * tokens[left]).sum())
    p[left] = ways[np.lexsort((np.abs(ways.sum(axis=1) - p[left].sum()), off.round(6)))[0]]
    return p


def _rng(seed: int, source: str, chunk: int) -> np.random.Generator:
    return np.random.default_rng(xxhash.xxh3_64_intdigest(f"{seed}\n{chunk}\n{source}"))


def _flown(seed: int, turn: int = 0):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["salt", "doc_id", "tokens"])
        p, tokens, chunk = frame["p"].to_numpy(), frame["tokens"].to_numpy(), int(frame["chunk"].iat[0])
        kept = np.zeros(len(p), bool)
        if turn:
            kept = frame["kept"].to_numpy()
        elif chunk == 0:  # documents of all sizes wait for the landing
            order = np.argsort(tokens, kind="stable")
            kept[order[np.unique(np.linspace(0, len(p) - 1, min(KEPT, len(p))).astype(int))]] = True
        p = p.copy()
        p[~kept] = flight(p[~kept], tokens[~kept], _rng(seed + turn, frame["source"].iat[0], chunk))
        return frame.assign(p=p, kept=kept)

    return run


def _landed(seed: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["salt", "doc_id", "tokens"])
        p, tokens, kept = frame["p"].to_numpy().copy(), frame["tokens"].to_numpy(), frame["kept"].to_numpy()
        p[~kept] = flight(p[~kept], tokens[~kept], _rng(seed, frame["source"].iat[0], -1))
        return frame.assign(p=landing(p, tokens))

    return run


def source_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: what its source has, needs, how often its documents are used at least, and the fraction to draw.

    The table of targets names each source once, so it and the plan are small
    beside the documents whatever their number.
    """
    first = Window.partitionBy("source").orderBy(F.desc_nulls_last("target_share"), F.desc_nulls_last("max_repeats"))
    goals = targets.where("source is not null").withColumn("n", F.row_number().over(first)).where("n = 1")
    goals = goals.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    # partial sums are taken before the shuffle, so a source with a third of all rows is no hot spot
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    plan = goals.join(have, "source", "left").fillna(0, ["available", "documents"])
    total = plan.agg(F.coalesce(F.sum("available"), F.lit(0))).scalar()
    plan = plan.withColumn("total", total).withColumn("need", F.col("target_share") * F.col("total"))
    ratio = F.when(F.col("available") > 0, F.col("need") / F.col("available"))
    # a need above what all repeats give can't be met; one token is the tolerance of the shares' rounding
    plan = plan.withColumn("reachable", F.col("need") <= F.col("available") * F.col("max_repeats") + 1)
    base = F.when(F.col("reachable"), F.least(F.floor(ratio).cast("int"), F.col("max_repeats"))).otherwise(F.col("max_repeats"))
    plan = plan.withColumn("base", F.coalesce(base, F.lit(0)))
    part = F.when(F.col("reachable") & (F.col("base") < F.col("max_repeats")), ratio - F.col("base")).otherwise(0.0)
    return plan.withColumn("part", F.coalesce(part, F.lit(0.0))).withColumn("chunks", F.ceil(F.col("documents") / CHUNK).cast("long"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42, path: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(chosen, report): chosen (doc_id, source, tokens, uses); report one row a target."""
    listed = documents.join(targets.select("source").where("source is not null").distinct(), "source", "left_semi").where("doc_id is not null and text is not null")
    sized, _ = stored(token_counts(listed, "doc_id", "source", path=path).where("tokens > 0"), "sized")
    plan, _ = stored(source_plan(sized, targets), "plan")
    rows = sized.join(plan.where("documents > 0").select("source", "base", "part", "chunks"), "source")
    salt = F.xxhash64("doc_id", F.lit(seed))
    rows = rows.select("doc_id", "source", "tokens", "base", salt.alias("salt"), F.pmod(F.xxhash64(salt), "chunks").cast("int").alias("chunk"), F.col("part").alias("p"), F.lit(False).alias("kept"))
    drawn = rows.where("p > 0").groupBy("source", "chunk").applyInPandas(_flown(seed), rows.schema)
    drawn, _ = stored(drawn, "flown")
    every = rows.where("p = 0").unionByName(drawn.where("p = 0 or p = 1"))
    chunks, turn = plan.agg(F.coalesce(F.max("chunks"), F.lit(0))).first()[0], 0
    while 2 * chunks + KEPT > CHUNK:  # what the chunks of a source left may still be too much for one
        chunks, turn = -(-2 * chunks // CHUNK), turn + 1
        again = drawn.where("p > 0 and p < 1").withColumn("chunk", F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(chunks)).cast("int"))
        drawn, _ = stored(again.groupBy("source", "chunk").applyInPandas(_flown(seed, turn), rows.schema), "flown")
        every = every.unionByName(drawn.where("p = 0 or p = 1"))
    every = every.unionByName(drawn.where("p > 0 and p < 1").groupBy("source").applyInPandas(_landed(seed), rows.schema))
    chosen = every.select("doc_id", "source", "tokens", (F.col("base") + F.col("p").cast("int")).alias("uses")).where("uses > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.sum("uses").alias("uses"))
    mixed = got.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    report = plan.join(got, "source", "left").fillna(0, ["tokens", "uses"]).withColumn("mixed", mixed)
    report = report.select(
        "source", "target_share", "max_repeats", "documents", "available", F.col("need").alias("target_tokens"), "tokens", "uses",
        F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).alias("actual_share"),
        F.when(F.col("mixed") > 0, F.col("tokens") / F.col("mixed")).alias("share_of_mix"),
        F.col("reachable").alias("reaches_target"),
    )
    return chosen, report
