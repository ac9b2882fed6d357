"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhopool.llm.store import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than its centre moves to the least node around the centre."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a centre, and the centre, move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(u, v)``; label is the least node reachable.

    Both steps are idempotent on a forest of stars, so the loop ends when a round changes nothing; the number of
    rounds grows with the logarithm of the diameter. Self-loops keep a node and link nothing; null ends are dropped.
    Only a count and a checksum reach the driver.
    """
    edges = edges.where("u is not null and v is not null")
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("label"))
    now = store(edges.where("u <> v").distinct(), "links")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = store(_small_star(_large_star(now)), "stars")
        before, state = state, _state(now)
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("label"))
    found = now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(centres).unionAll(loops)
    return found.groupBy("node").agg(F.min("label").alias("label"))
