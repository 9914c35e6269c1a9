"""Connected components of a table of links, without collecting any of it.

Alternates the large-star and small-star steps (Kiveris et al. 2014): every step is one
group-by, and each step's links are written to the shared folder, so lineage stays short and
lost executors cost one step at most.

A hub's links are joined with the hub's least neighbour from a written table, so that the join reads
plain shuffles on both sides and adaptive execution can split a hub over many tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Workspace, written


def _star(links: DataFrame, large: bool, work: Workspace) -> DataFrame:
    """Joins every node's neighbours to its least neighbour (or itself).

    large: larger neighbours only are moved, small: the smaller ones and the node itself.
    """
    if large:
        near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = work.written(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    moved = near.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: no node is both an end and a centre, or an end of two centres.

    Steps keep components connected and centres smaller than ends, so each star then is a component
    and its centre the least node.
    """
    roles = links.select(F.col("a").alias("node"), F.lit(1).alias("end"), F.lit(0).alias("centre")).union(
        links.select(F.col("b"), F.lit(0), F.lit(1)))
    bad = roles.groupBy("node").agg(F.sum("end").alias("ends"), F.max("centre").alias("centre")).where("ends > 1 or ends = 1 and centre = 1")
    return not bad.limit(1).count()


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component_id) of every node in links (a, b): the least node reachable.

    Links of a node to itself and repeated links don't matter; nulls are left out.
    """
    with Workspace(links.sparkSession) as work:
        now = work.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
            "a is not null and b is not null and a <> b").distinct(), "links")
        for _ in range(most_rounds):
            if _settled(now):
                break
            now = work.written(_star(work.written(_star(now, True, work), "links"), False, work), "links")
        else:
            raise RuntimeError("links did not settle")
        ends = now.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("component_id")).distinct()
        return written(ends.union(roots), "components")


def joined(whole: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component_id) after more links: only these are looked at, between components that are known already."""
    name = lambda side: F.coalesce(f"{side}.component_id", f"l.{side}")
    between = (links.alias("l").join(whole.alias("a"), F.col("l.a") == F.col("a.node"), "left")
               .join(whole.alias("b"), F.col("l.b") == F.col("b.node"), "left").select(name("a").alias("a"), name("b").alias("b")))
    new = connected(between).select(F.col("node").alias("old"), F.col("component_id").alias("new"))
    known = whole.join(new, whole["component_id"] == new["old"], "left").select("node", F.coalesce("new", "component_id").alias("component_id"))
    first = new.join(whole, new["old"] == whole["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component_id"))
    return known.union(first)
