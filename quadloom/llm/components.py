"""Connected components by alternating large and small stars, each round a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour (large: the greater ones; small: the smaller ones) of a node to the
    least node of its neighbourhood.  ``edges(u, v)`` holds u > v."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = near.join(least, "u")
    out = moved.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no greater one, or greater ones only: the
    smaller ones are the components then."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
        "up > 1 OR up = 1 AND down = 1").count() == 0


def _by_component(links: DataFrame, known: DataFrame, *ends: str) -> DataFrame:
    """``links`` with the component in place of each end that has one in ``known``."""
    for end in ends:
        own = known.select(F.col("node").alias(end), F.col("component").alias("_own"))
        links = links.join(own, end, "left").withColumn(end, F.coalesce("_own", end)).drop("_own")
    return links


def components(pairs: DataFrame, keep=materialise, known: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node reachable from every node of ``pairs(a, b)``, written by
    ``keep``.  Only the links of the last round are held.

    ``known`` is an earlier result whose links hold as well: the new links then go between its
    components, so all links between two of them take part in the rounds as one."""
    with Scratch(pairs.sparkSession) as scratch:
        if known is not None:
            pairs = _by_component(pairs.select("a", "b"), known, "a", "b")
        edges = scratch.table(pairs.where("a <> b").select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        while not _are_stars(edges):
            last, edges = edges, scratch.table(_star(_star(edges, True), False), "edges")
            scratch.drop(last)
        nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        nodes = nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        if known is not None:
            # a component of before is a node here when it was linked
            nodes = _by_component(known.select("node", "component"), nodes, "component").unionByName(
                nodes.join(known, "node", "left_anti"))
        return keep(nodes, "components")
