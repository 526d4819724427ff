"""Reachability over references, and pins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import dropped, staged
from . import dml


def closure(roots: DataFrame, edges: DataFrame, most_levels: int | None = None, levels: int = 4) -> DataFrame:
    """node of everything reachable from roots (node) over edges (src, dst), roots included, known or not.

    A job takes so many levels at once: the frontier meets the edges again and again, then what was visited goes. The nodes
    that only the last of these levels reached are the next frontier. Each job's nodes are written to the shared folder, so the
    plan does not grow and a lost executor costs one job at most. Cycles end by themselves. With most_levels given, a closure
    that goes deeper raises."""
    roots = staged(roots.select("node").distinct().withColumn("level", F.lit(0)), "closure")
    edges = staged(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    found, frontier, depth = [roots], roots, 0
    while True:
        at, steps = frontier.select("node"), []
        for k in range(levels):
            at = edges.join(at.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
            steps.append(at.withColumn("level", F.lit(k)))
        reached = reduce(DataFrame.unionByName, steps).groupBy("node").agg(F.min("level").alias("level"))
        visited = reduce(DataFrame.unionByName, found).select("node")
        new = staged(reached.join(visited, "node", "left_anti"), "closure")
        deepest = new.agg(F.max("level")).first()[0]
        if deepest is None:
            break
        depth += deepest + 1
        if most_levels is not None and depth > most_levels:
            raise RuntimeError(f"the closure goes deeper than {most_levels} levels")
        found.append(new)
        frontier = new.where(F.col("level") == levels - 1)
        if len(found) > 16:
            whole = staged(reduce(DataFrame.unionByName, found), "closure")
            frontier = staged(frontier, "frontier")
            dropped(*found)
            found = [whole]
        if deepest < levels - 1:
            break
    dropped(edges)
    return reduce(DataFrame.unionByName, found).select("node")


def referrers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): who references the given nodes."""
    return edges.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def pin(pins: DataFrame, hashes: DataFrame, narinfos: DataFrame) -> DataFrame:
    """Pins added, once each, for hashes that exist."""
    return dml.insert_or_ignore(pins, hashes.select("hash").join(narinfos.select("hash"), "hash", "left_semi"), ["hash"])


def unpin(pins: DataFrame, hashes: DataFrame) -> DataFrame:
    return dml.delete_matching(pins, hashes.select("hash"), ["hash"])
