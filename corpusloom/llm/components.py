"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoint

#: Keys that are joined by broadcast at most, and the rows of a key below which it never is.
MOST_HEAVY, LEAST_HEAVY = 50_000, 64


def join_weighted(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key) without gathering the rows of a heavy key.

    ``weight`` is how many of the ``total`` rows have a key. Keys of more than their
    MOST_HEAVY-th part, so at most MOST_HEAVY of them, are joined by broadcast, where
    the rows lie; the others by a shuffle, in which no key has more rows than that.
    ``rows`` is read twice and should be a written table or a checkpoint.
    """
    bound = max(LEAST_HEAVY, -(-total // MOST_HEAVY))
    heavy = F.broadcast(facts.where(F.col(weight) > bound).drop(weight))
    light = facts.where(F.col(weight) <= bound).drop(weight)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour larger than a node goes to the node's least neighbour; ``edges`` holds both directions."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_weighted(edges.where("v > u"), least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours go to the least of those."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_weighted(edges, least, "u", "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of every component that has an edge.

    ``edges`` has two long columns u and v; loops, repeats and nulls do no harm. Rounds
    alternate large and small stars until nothing moves, however many that takes (about
    the logarithm of the nodes); each is cut off by a checkpoint in the shared folder.
    The edges of a hub stay where they lie, see ``join_weighted``. Nothing but three
    numbers a round comes to the driver. An empty list gives no rows.
    """
    directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    stars, before = shared_checkpoint(directed), None
    while True:
        sign = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h"), F.sum(F.col("v") % 1_000_003).alias("v")).first()
        if tuple(sign) == before or not sign["n"]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(sign)
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = shared_checkpoint(_large_star(both, 2 * sign["n"]))
        stars = shared_checkpoint(_small_star(larger, sign["n"]))
