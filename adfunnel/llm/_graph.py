"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.llm._store import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): root is the least id of its component.

    Alternating large-star and small-star steps: each step points the
    neighbours of a vertex at their least, so a component becomes a star in a
    number of rounds that grows with the logarithm of its size. A vertex with a
    third of all links costs one pre-aggregated minimum and one join that can
    be split. Every round is a written table. No links: an empty table.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    stats, k = None, 0
    while True:
        edges = scratch.save(edges, f"{name}-{k}")
        if k:
            scratch.drop(f"{name}-{k - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == stats or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        stats, k = now, k + 1
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = small.where("u > v").distinct()
