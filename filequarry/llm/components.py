"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a long, b long)``; label is the component's smallest node.

    Each step only takes minima per node, combined before the shuffle, and joins them back by an equi-join, whose hot
    nodes adaptive execution splits. The steps run until no edge changes; each ends in a written table. Loops and
    repeated edges are allowed; an empty input gives an empty result.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _state(e)
    while seen[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        forget(e)
        forget(large)
        e, last, seen = after, seen, _state(after)
        if seen == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
