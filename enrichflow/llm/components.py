"""Connected components of a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from enrichflow.sources.scratch import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: larger (or smaller) neighbours of each node are linked to the least of node and neighbours."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    met = both.join(least, "a")
    if large:
        moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return moved.filter("a <> b").distinct()


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) that is not the least of its component.

    Stars are contracted until nothing moves, about as often as the logarithm of the longest path. A node with very many
    links is reduced by partial aggregation, and the joins may be split.
    """
    links = written(links.select("a", "b").filter("a <> b").distinct())
    seen = _print(links)
    while seen[0]:
        links = written(_star(written(_star(links, True)), False))
        now = _print(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
