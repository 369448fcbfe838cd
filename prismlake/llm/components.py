"""Connected components of a graph of links, by large-star and small-star rounds.

Every round replaces links by links to smaller ids, until each component is a
star around its smallest id. Rounds are written to the shared folder; the driver
sees two numbers for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """links (a, b) -> (id, component) of every node that has a link; component is the smallest id reachable. Ids are of any ordered type."""
    edges = scratch.save(links.select("a", "b").where("a <> b").distinct(), f"{label}-0")
    seen = None
    for i in range(1, MOST_ROUNDS + 1):
        edges = scratch.save(_small_star(_large_star(edges)), f"{label}-{i}")
        # A checksum of the links: equal in two rounds when nothing has changed.
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(f"{label}-{i - 1}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle within {MOST_ROUNDS} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
