"""Connected components of a link table, by alternating large and small stars.

Each round is two shuffles of the links; rounds grow with the logarithm of the
longest chain. Minima are aggregated before they are shuffled and joined back,
so a node with very many links is split like any skewed join key. Every round
is stored in the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node (larger ones, or itself and smaller ones) to its smallest."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _state(links: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(mark, 20)), F.bit_xor(mark)).first())


def components(links: DataFrame) -> DataFrame:
    """``a`` and its component's smallest node ``b``, for links (a long, b long).

    Nodes that are their component's smallest, or that have no link, are absent.
    """
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while state[0]:
        links = stored(_star(_star(links, large=True), large=False), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links
