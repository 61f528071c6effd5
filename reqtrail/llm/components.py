"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller and own (small star) neighbours to the least of them and itself."""
    if small:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = pairs.join(least, "u")
    if small:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for every node that has a link to another.

    Rounds grow with the logarithm of the nodes; each round's links are a table in the shared folder. Null ends and
    links of a node to itself are left out; repeated links change nothing.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = None
    while True:
        step = materialise(_starred(_starred(edges, small=False), small=True), "links")
        seen = tuple(step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(edges)
        edges = step
        if seen == mark:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out._scratch_path = edges._scratch_path
            return out
        mark = seen
