"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import staged


def _minima(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with ``m``, the least of u and its neighbours.

    The least are found in every task before a shuffle, and written: the edges of
    a hub are then a skewed join that Spark splits.
    """
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``label``, the least node reachable, for the nodes of ``edges`` (``a``, ``b``: long).

    Large-star and small-star rounds in turn, each written to the shared
    checkpoint folder, until the edges stay as they are. Every edge then leads
    to the least node of its component.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minima(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = _minima(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
