"""Hold-outs of exact size, by an order that hashes give: random, stratified, and by time."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from rankspark.operators.select import by_hash
from rankspark.sources.shared import stored


def random_holdout(rows: DataFrame, size: int, key: str = "article_id", seed: int = 42) -> DataFrame:
    """``size`` rows drawn without replacement: a top-k by hash."""
    return rows.orderBy(by_hash(key, seed), key).limit(size)


def rest_of(rows: DataFrame, drawn: DataFrame, key: str = "article_id") -> DataFrame:
    return rows.join(drawn.select(key), key, "left_anti")


def class_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, rows) of both classes; a class without rows counts 0."""
    both = rows.sparkSession.createDataFrame([(0,), (1,)], f"{label} int")
    return both.join(rows.groupBy(label).agg(F.count("*").alias("rows")), label, "left").fillna(0, ["rows"])


def quotas(counts: dict[int, int], size: int) -> dict[int, int]:
    """Rows of each class in a hold-out of ``size``: proportional, the largest remainders rounded up (ties: larger class, then label)."""
    total = sum(counts.values())
    exact = {c: size * n / total for c, n in counts.items()}
    out = {c: int(x) for c, x in exact.items()}
    for c in sorted(counts, key=lambda c: (out[c] - exact[c], -counts[c], c))[: size - sum(out.values())]:
        out[c] += 1
    return out


def stratified_holdout(rows: DataFrame, size: int, label: str = "label", key: str = "article_id", seed: int = 42) -> DataFrame:
    """A hold-out of exactly ``size`` rows with each class in proportion.

    No hold-out (empty) for size 0; an error if the size is below 2 or leaves no
    row, or if a class has fewer than two rows.  Per class it is a top-k by hash,
    so a class of any size is never sorted in one task.
    """
    if size == 0:
        return rows.limit(0)
    counts = {r[0]: r[1] for r in class_counts(rows, label).collect()}  # two rows
    if size < 2 or size >= sum(counts.values()) or min(counts.values()) < 2:
        raise RuntimeError(f"cannot hold out {size} of {counts}")
    parts = [random_holdout(rows.where(F.col(label) == c), n, key, seed) for c, n in quotas(counts, size).items()]
    return parts[0].unionByName(parts[1])


#: Intervals into which a step of the search for a boundary cuts its range, and rows that a top-k may settle.
INTERVALS = 1024
SETTLED = 100_000


def _narrowed(rows: DataFrame, number: str, size: int) -> tuple[int, int, int]:
    """(low, high, left): all ``rows`` with a number from ``high`` on belong to the greatest ``size``, and ``left`` more of those from ``low`` on.

    Each step counts the rows of ``INTERVALS`` equal intervals and goes on in the
    one in which the boundary lies, until it holds ``SETTLED`` rows at most or one
    number.
    """
    ends = rows.agg(F.min(number), F.max(number)).first()
    low, high = ends[0], ends[1] + 1
    while True:
        width = -(-(high - low) // INTERVALS)
        inside = rows.where((F.col(number) >= low) & (F.col(number) < high))
        place = F.expr(f"(`{number}` - ({low}L)) div {width}L").cast("int")
        counts = {r[0]: r[1] for r in inside.groupBy(place).agg(F.count("*")).collect()}  # INTERVALS rows at most
        for k in sorted(counts, reverse=True):
            if counts[k] >= size:
                break
            size -= counts[k]
        low, high = low + k * width, min(high, low + (k + 1) * width)
        if counts[k] <= SETTLED or high - low <= 1:
            return low, high, size


def newest_share(rows: DataFrame, share: float, at: str, key: str = "article_id") -> DataFrame:
    """The newest ``share`` of the rows by time, null being oldest (ties: the greater key, a whole number): a chronological hold-out.

    The time at the boundary is found by counting in intervals, ties there by
    key in the same way; a top-k settles the few rows that are left.
    """
    rows, _ = stored(rows, "rows")
    size = int(rows.count() * share)
    # null goes below all times
    timed = rows.withColumn("_at", F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 62))))
    if not size:
        return rows.limit(0)
    low, high, left = _narrowed(timed, "_at", size)
    newer, edge = timed.where(F.col("_at") >= high), timed.where((F.col("_at") >= low) & (F.col("_at") < high))
    if high - low <= 1:
        low, high, left = _narrowed(edge, key, left)
        newer, edge = newer.unionByName(edge.where(F.col(key) >= high)), edge.where((F.col(key) >= low) & (F.col(key) < high))
    return newer.unionByName(edge.orderBy(F.desc("_at"), F.desc(key)).limit(left)).drop("_at")
