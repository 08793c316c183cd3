"""Connected components of an undirected edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.llm.common import stored


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none that is itself somebody's larger one."""
    nodes = edges.select(F.explode(F.expr("array(struct(u AS n, 1 AS up, 0 AS down), struct(v AS n, 0 AS up, 1 AS down))")).alias("x")).select("x.*")
    roles = nodes.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (columns a, b; both long): the smallest id it can reach.

    Self-loops, repeated and reversed edges and rows with nulls are fine (nulls are ignored);
    an empty table gives an empty result. Each step only joins edges with one minimum per node,
    so a node with very many neighbours is split by the skew join, and a chain of n nodes
    takes a logarithmic number of steps. The driver sees one flag a step.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = stored(e.distinct(), "edges")
    while not _all_stars(e):
        both = e.select(F.explode(F.expr("array(struct(u, v), struct(v AS u, u AS v))")).alias("x")).select("x.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.expr("array(struct(u, m AS v), struct(v AS u, m AS v))")).alias("x")).select("x.*")
        e = stored(small.where("u <> v").distinct(), "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
