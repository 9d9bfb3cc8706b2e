"""Connected components by alternating large-star and small-star rounds.

Links stay a DataFrame throughout; each round is written to the shared folder,
so lineage stays short and a lost executor costs one round at most; a round that
the next one replaces is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(links: DataFrame) -> DataFrame:
    """For each u and each neighbour v > u: v to the least of u and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("x")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links point down here: u and all it points to go to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
    moved = down.join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("x").alias("u"), F.col("m").alias("v")))


def roots(links: DataFrame) -> DataFrame:
    """(node, root): for every node of a link, the least node it can reach.

    ``links`` has columns u and v of one type; self links and repeats are fine.
    """
    now = common.stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    state = _state(now)
    while state[0]:
        after = common.stored(_small_star(_large_star(now)).filter("u > v").distinct(), "links")
        new = _state(after)
        common.discard(now)
        now, state, done = after, new, new == state
        if done:
            break
    # Stars now: every u points to its root; the roots themselves close the list.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
