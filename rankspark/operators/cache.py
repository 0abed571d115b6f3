"""The embedding cache: look up by configuration and text hash, encode what is missing, write back."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from rankspark.functions.text import text_hash
from rankspark.operators.encode import Encoder, encoded
from rankspark.operators.select import clock, embeddings_of
from rankspark.operators.writes import upsert_embeddings


def with_cache_state(texts: DataFrame, cache: DataFrame, key: dict, dimensions: int) -> DataFrame:
    """``texts`` (article_id, text or text_hash, ...) with ``text_hash``, ``cache_state`` and the cached ``embedding``.

    A hit has the same hash and a vector of the encoder's length; a row with
    another hash or length is stale; without a row it is a miss.  A null text
    has a null hash and never hits.
    """
    texts = texts.drop("cache_state", "embedding")
    hashed = texts if "text_hash" in texts.columns else texts.withColumn("text_hash", text_hash(F.col("text")))
    known = embeddings_of(hashed, cache, key).withColumnsRenamed({"text_hash": "cached_hash", "embedding": "cached"}).withColumn("_known", F.lit(True))
    state = F.when(F.col("_known").isNull(), "miss").when((F.col("cached_hash") == F.col("text_hash")) & (F.size("cached") == dimensions), "hit").otherwise("stale")
    joined = hashed.join(known, "article_id", "left").withColumn("cache_state", state)
    return joined.withColumn("embedding", F.when(F.col("cache_state") == "hit", F.col("cached"))).drop("cached", "cached_hash", "_known")


def cache_counts(states: DataFrame) -> DataFrame:
    """(hits, stale, misses): a stale row counts as a miss too."""
    count = lambda *names: F.count_if(F.col("cache_state").isin(*names))
    return states.agg(count("hit").alias("hits"), count("stale").alias("stale"), count("miss", "stale").alias("misses"))


def encode_with_cache(texts: DataFrame, cache: DataFrame, key: dict, make: Callable[[], Encoder], dimensions: int, at: datetime | str) -> tuple[DataFrame, DataFrame]:
    """(rows with an embedding each, new cache rows): only what doesn't hit is encoded.

    The first is used by every model; keep it (``persist`` or a stored table)
    before using it twice.
    """
    states = with_cache_state(texts, cache, key, dimensions)
    new = encoded(states.where("cache_state <> 'hit'"), make)
    rows = states.where("cache_state = 'hit'").unionByName(new)
    constants = {c: F.lit(v) for c, v in key.items()}
    fresh = new.where(F.col("text_hash").isNotNull()).select("article_id", "text_hash", "embedding").withColumns({**constants, "last_updated": clock(at), "ordinal": F.lit(0)})
    return rows, fresh


def updated_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert_embeddings(cache, fresh)
