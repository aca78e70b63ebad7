"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushtext.llm.common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (long columns ``a``, ``b``).

    ``root`` is the smallest node reachable.
    """
    found = members(edges)
    return found.union(found.select("root", "root").distinct())


def members(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for the nodes of ``edges`` that are not roots themselves.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until every component is one
    star.  A step is one join of the edges with partial minima, and no task needs a whole
    component.  Each step is written to the shared folder.
    """
    now, before = edges.where("a <> b").select("a", "b"), []
    while not _is_stars(now):
        half = saved(_large_star(now), "edges")
        now = saved(_small_star(half), "edges")
        discard(half, *before)
        before = [now]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether each edge goes down to a centre and each node has one edge or is a centre."""
    nodes = edges.select(F.expr("stack(2, a, 1, 0, a < b, b, 0, 1, a < b) AS (node, up, down, wrong)"))
    seen = nodes.groupBy("node").agg(
        F.sum("up").alias("up"), F.max("down").alias("down"), F.max("wrong").alias("wrong")
    )
    return seen.where("up + down > 1 OR wrong").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.expr("stack(2, a, b, b, a) AS (u, v)"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges whose ``a`` is the larger node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (
        edges.join(least, "a").select(F.expr("stack(2, a, m, b, m) AS (a, b)"))
        .where("a <> b").distinct()
    )
