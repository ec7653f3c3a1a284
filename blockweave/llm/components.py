"""Connected components by alternating large and small stars, wholly in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Link neighbours to the least one. edges: (u, v), u > v."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if small:
        out = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u != v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b), longs -> (id, component): the least id reachable, for every id that has a link.

    Each round costs two joins; a star is done in one, a chain in a logarithmic number of rounds. Nulls and self links
    are left out. Rounds are written to the shared folder, so that plans stay short and lost executors are no loss.
    """
    edges = stage(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum("u"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        edges = stage(_stars(_stars(edges, small=False), small=True), "edges")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))
