"""Scores, decay and probabilities as column expressions.  Nulls stay null."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

EPSILON = 1e-7


def decay_rate(urgency: Column, evergreen: float = 120.0, urgent: float = 10.0) -> Column:
    """ln 2 over the half-life in days, which falls linearly from ``evergreen`` to ``urgent``."""
    return F.ln(F.lit(2.0)) / (evergreen + urgency * (urgent - evergreen))


def age_days(at: Column, published: Column) -> Column:
    """Days between two times, with fractions; negative for a date after the clock."""
    return (F.unix_micros(at.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / F.lit(86_400_000_000.0)


def decayed(score: Column, days: Column, urgency: Column, evergreen: float = 120.0, urgent: float = 10.0) -> Column:
    """The score after so many days, rounded half to even; an age below 0 raises it, up to the greatest int.

    Without an urgency the score stays as it is.
    """
    value = F.least(F.rint(score * F.exp(-decay_rate(urgency, evergreen, urgent) * days)), F.lit(2147483647.0)).cast("int")
    return F.when(urgency.isNull(), score.cast("int")).otherwise(value)


def to_score(probability: Column) -> Column:
    """Hundredths, rounded half to even."""
    return F.rint(probability * 100).cast("int")


def clipped(probability: Column, epsilon: float = EPSILON) -> Column:
    """Into [epsilon, 1 - epsilon]; null stays null."""
    return F.when(probability.isNotNull(), F.greatest(F.least(probability, F.lit(1 - epsilon)), F.lit(epsilon)))
