"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped aggregations over the links; a node with very many
neighbours costs rows, never one task's memory beyond its own neighbour list's
minimum, and where the links of such a node meet its minimum they are spread over
``SALTS`` keys.  Rounds grow with the logarithm of the longest chain.  Each round is
checkpointed to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from rankspark.sources.shared import cut


SALTS = 8


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); a component is named by its smallest node.

    Self-links and repeated links are allowed; an empty table gives an empty result.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    before = None
    for _ in range(rounds):
        # large star: each node's larger neighbours go to its smallest neighbour or itself
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # all links of a star meet its centre's minimum: that of each node is repeated for each salt
        salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        up = both.where("b > a").withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS)))
        links = up.join(salted, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node's smaller neighbours, and itself, go to the smallest
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        joined = links.join(least, "a")
        links = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links = cut(links)
        now = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum("b")).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
