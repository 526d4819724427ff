"""Connected components of links between 64-bit nodes, by alternating large-star and small-star steps in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of each node in links (a, b). The links stay distributed; each round
    is written to the shared folder. The rounds end when no link changes, as they do after about the square of the logarithm of
    the number of nodes; there is no cap. No links, null nodes aside, give an empty result; repeated links count once."""
    links = links.where("a <> b").select("a", "b")
    now = staged(_once(links), "links")
    same = False
    while not same:
        then = staged(_star(_star(now, larger=True), larger=False), "links")
        # both are sets of links: the same number, and none that is new
        same = then.count() == now.count() and then.join(now, ["a", "b"], "left_anti").isEmpty()
        dropped(now)
        now = then
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())


def _once(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node a to the smaller b."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Large star: each node's larger neighbours go to its smallest neighbour or itself. Small star: its smaller ones do."""
    if larger:
        edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        edges = links
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = edges.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select("b", "least").unionByName(least.select(F.col("a").alias("b"), "least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.where("a <> b").distinct()
