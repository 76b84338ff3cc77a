"""Connected components of a graph given as a table of links.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step
replaces links by links to the smallest neighbour, so trees flatten in a few
rounds. Steps are an aggregate and a join on a node; a node with very many
neighbours is pre-aggregated, and adaptive execution splits it in the join. Each
round is written to the shared folder, so lineage stays short, and nothing but two
counts reaches the driver. No round is run to see that nothing changes: one aggregate
tells whether all trees are flat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, gathered


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over rows (u, v), u > v."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def _deep(links: DataFrame) -> tuple[int, int]:
    """Number of links, and of nodes that keep them from being stars: with two smaller
    neighbours, or with a smaller and a larger one."""
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("low")).union(
        links.select(F.col("v").alias("node"), F.lit(None).cast("bigint").alias("low")))
    nodes = ends.groupBy("node").agg(
        F.count("low").alias("ups"), F.count("*").alias("n"), F.min("low").alias("lo"), F.max("low").alias("hi"))
    deep = (F.col("lo") != F.col("hi")) | ((F.col("ups") > 0) & (F.col("ups") < F.col("n")))
    found = nodes.agg(F.sum("ups"), F.count_if(deep)).first()
    return found[0] or 0, found[1] or 0


def components(work: Workspace, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of a link to another node; the
    component is its smallest node. Links to itself and with nulls are ignored,
    repeated links do no harm, no links give no rows."""
    current = work.table(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while True:
        count, deep = _deep(current)
        if not deep:
            break
        following = work.table(gathered(_stars(current), count))
        work.drop(current)
        current = following
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
