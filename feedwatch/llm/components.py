"""Connected components of an edge table, by alternating star contractions on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.llm.tables import scalar, written


def _state(edges: DataFrame) -> tuple:
    row = scalar(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))))
    return row[0], row[1]


def star_roots(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to rows (node, root): ``root`` is the smallest node of the component.

    Every node with an edge to another node gets one row, but for the roots themselves.  Each round
    hangs the neighbours of a node below the smallest of them (greater neighbours, then smaller
    ones), until nothing changes; the number of rounds grows with the logarithm of the longest path.
    Only a count and a checksum reach the driver.  Self-edges and repeated edges do no harm.
    """
    edges = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(smallest.withColumnRenamed("m", "b")).distinct(), "edges")
        now = _state(edges)
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
