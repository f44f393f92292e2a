"""Connected components by alternating star contraction (Kiveris et al., 2014), on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written


def _is_stars(e: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then every component is a star and nothing can change. Exact."""
    several = e.groupBy("u").agg(F.min("v").alias("x"), F.max("v").alias("y")).where("x <> y")
    return several.isEmpty() and e.join(e.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Labels of the nodes of an undirected graph.

    edges: columns a, b of one orderable type; nulls, loops and repeats are ignored. No edges: no rows.
    Returns (node, label), a row for each node that has an edge to another; label is the smallest node it reaches.
    Every round minima are pre-aggregated before the shuffle, so a hub costs one row for each task, and written, so
    that both sides of the joins back are plain shuffles, of which adaptive execution can split a skewed one.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    while not _is_stars(e):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        low = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "low")
        large = written(both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(least.select("u", "m")).distinct(), "edges")
        for done in (e, low, large, least):
            discard(done)
        e = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
