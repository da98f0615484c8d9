"""Connected components over links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


#: So many rows of two ids are broadcast at most (some 16 MB as a hash table).
SMALL = 400_000


def _beside(rows: DataFrame, n: int) -> DataFrame:
    """Aggregated rows, n at most, as a side of a join by their key. Few are broadcast; more are a table, so that the join is of two plain
    exchanges, of which a hub's partition can be split."""
    return F.broadcast(rows) if n <= SMALL else materialize(rows, "least")


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) of integer ids, in any order and repeated -> (id, component) of every id that has a link to another one.

    component is the smallest id reachable. Each round is two aggregations by id and two joins on it, so a hub's links
    are pre-aggregated and its join is split; rounds grow with the logarithm of the longest chain. Every round is
    written to the shared folder.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    state = _state(links)
    while True:
        n = state[0]
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _beside(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), 2 * n)
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        large = large if n <= SMALL else materialize(large, "large")
        least = _beside(large.groupBy("a").agg(F.min("b").alias("m")), 2 * n)
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(links)
        if before == state:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
