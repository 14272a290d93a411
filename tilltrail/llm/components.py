"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilltrail.llm.store import discard, stored_at


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node in columns ``a``, ``b``.

    Large-star and small-star steps alternate until the links no longer change: then each node is
    linked to the smallest one of its component and to nothing else. A link is moved, never
    multiplied, so no step makes more rows than there are links. Each round is stored in the shared
    folder. Links that hold a null or join a node to itself are left out.
    """
    spark = links.sparkSession
    edges = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges, path = stored_at(edges.distinct(), "links")
    before = None
    while (now := _signature(edges)) != before:
        next_edges, next_path = stored_at(_small_star(_large_star(edges)), "links")
        discard(spark, path)
        edges, path, before = next_edges, next_path, now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """Each row with ``m``, the least of ``u`` and all its ``v``.

    The hash as a second join key gives both sides an exchange of their own, which lets adaptive
    execution split a node that most links share.
    """
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    keyed = [side.withColumn("_h", F.hash("u")) for side in (edges, least)]
    return keyed[0].join(keyed[1], ["u", "_h"]).drop("_h")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    placed = _with_least(edges)
    moved = placed.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(placed.select("u", F.col("m").alias("v"))).distinct()
