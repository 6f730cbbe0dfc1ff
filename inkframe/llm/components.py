"""Connected components as DataFrame jobs: alternating large-star and small-star joins.

Each round is one written table, so a lost executor costs at most the current round. The number
of rounds grows with the logarithm of a component's diameter. No node list reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of u and its neighbours; partial sums come before the shuffle."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, stage: Stage, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, class) for every node of ``edges`` (src, dst); class is its component's smallest node."""
    now = stage.put(f"{name}-0", edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    last, previous = f"{name}-0", None
    for k in range(1, most_rounds):
        if k == 1 and now.isEmpty():
            break
        # large-star: neighbours above u join the smallest of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage.put(f"{name}-l{k}", large.distinct())
        # small-star: neighbours below u, and u, join the smallest of them
        low = large.join(_smallest(large), "u")
        star = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = stage.put(f"{name}-{k}", star.filter("u <> v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stage.drop(last, f"{name}-l{k}")
        last = f"{name}-{k}"
        if mark == previous:
            break
        previous = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("class")).union(roots.select("node", F.col("node").alias("class")))
