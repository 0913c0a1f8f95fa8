"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is a group-by and a join on the link's upper end, so hubs are
pre-aggregated before the shuffle and skewed joins are split by AQE. The state
is one row per node at most; it is checkpointed each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabularium.llm.common import durable


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    return (
        both.join(least, "node")
        .where("other > node")
        .select(F.col("other").alias("hi"), F.least("node", "least").alias("lo"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("least"))
    return (
        links.join(least, "hi")
        .select(F.explode(F.array(F.struct("hi", "least"), F.struct(F.col("lo").alias("hi"), "least"))).alias("x"))
        .select("x.hi", F.col("x.least").alias("lo"))
        .where("hi > lo")
        .distinct()
    )


def connected_components(links: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    Links with a null end or from a node to itself are ignored; repeated links count once.
    """
    now = durable(
        links.where(f"{left} <> {right}")
        .select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen, now = state, durable(_small_star(_large_star(now)))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())
