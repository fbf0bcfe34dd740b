"""Connected components of links that Spark holds, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a``, ``b``); the component is its smallest node.

    Every round, each node's neighbours are tied to the smallest of them, first the larger
    ones, then the smaller ones, until nothing changes. The number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder. Minima are
    combined before they are shuffled, so a node with any number of links is no hot key.
    Links with a null or equal ends don't count. An empty input gives no rows.
    """
    proper = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = written(proper.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "links")
    seen = _digest(edges)
    for _ in range(rounds):
        edges, before = written(_small(_large(edges)), "links"), seen
        seen = _digest(edges)
        if seen == before:
            # Stable: every node points at its component's smallest node.
            return edges.selectExpr("a AS node", "b AS component").unionAll(edges.selectExpr("b AS node", "b AS component").distinct())
    raise RuntimeError(f"components not stable after {rounds} rounds")


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, tied to the smallest of the node and its neighbours."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    # An edge (a > b): seen from b, a is larger; b's smallest neighbour is least of b, if smaller.
    tied = edges.join(least.selectExpr("a AS b", "m"), "b", "left")
    return tied.select("a", F.coalesce(F.least("m", "b"), "b").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself, tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a")
    others = tied.where("b <> m").selectExpr("b AS a", "m AS b")
    return least.selectExpr("a", "m AS b").unionAll(others).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Number and sum of hashes: equal for the same edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
