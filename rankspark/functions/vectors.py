"""Vectors: byte codec, norms, dot products."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def pack(vectors: pd.Series) -> pd.Series:
    """Little-endian float32 bytes; null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack(packed: pd.Series) -> pd.Series:
    return packed.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def usable(vector: Column, length: int) -> Column:
    """Whether a vector has this length and finite values; false for null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == length) & finite, F.lit(False))


def dot(vector: Column, weights: list[float]) -> Column:
    """The dot product with fixed weights; vectors of another length give null."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    total = F.aggregate(F.zip_with(vector, w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(vector) == len(weights), total)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(vector)
    return F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)).cast("float"))
