"""Connected components of a link table, by alternating large-star and small-star rounds.

No task sees a component whole, nor does the driver: each round is a minimum per vertex and a join, the
minimum's exchange combines on the map side, and the join's large side may be split where a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, store


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star on (v, u) edges, v > u."""
    both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v > u").distinct()
    low = large.groupBy("v").agg(F.min("u").alias("m"))
    joined = large.join(low, "v")
    return joined.where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, u): for each vertex but its component's least, that least vertex.  ``edges``: (v, u) in any order."""
    now = store(edges.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).where("v > u").distinct())
    state = None
    for _ in range(most_rounds):
        then, now = now, store(_star(now))
        discard(then)
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if told == state:
            return now
        state = told
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
