"""Positions and running sums over ranges of an order."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tilltrail.operators import ordering
from tilltrail.operators.cleaning import add_surrogate_id


def test_positions_follow_the_order_and_are_dense(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(5)]), rng.choice("abc"), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t string, i int").repartition(7)
    found = ordering.placed(df, [F.col("k").desc_nulls_last(), "t"]).orderBy("place").collect()
    assert [r.place for r in found] == list(range(500))
    assert sorted(r.i for r in found) == list(range(500))
    keys = [(r.k is None, -(r.k or 0), r.t) for r in found]
    assert keys == sorted(keys)


def test_repeated_rows_are_cut_apart(spark):
    """A third of all rows agree in the whole order; no range holds them all."""
    df = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = df.withColumn("_a", F.monotonically_increasing_id()).repartitionByRange(12, "k", "_a")
        sizes = ranges.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 6_000
        assert ordering.placed(df, ["k"]).select("place").distinct().count() == 30_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_running_sums_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK_BITS", 3)
    rng = random.Random(5)
    values = [rng.randrange(-5, 100) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(values)), "place long, v long").repartition(5)
    found = ordering.running(df, "place", {"total": "v", "twice": "v"}).orderBy("place").collect()
    total = 0
    for row, value in zip(found, values, strict=True):
        total += value
        assert row.total == row.twice == total


def test_empty_frames(spark):
    df = spark.createDataFrame([], "place long, v long")
    assert ordering.running(df, "place", {"s": "v"}).collect() == []
    assert ordering.placed(df, ["v"], "p").collect() == []


def test_ids_of_very_many_equal_and_missing_numbers(spark):
    rows = spark.range(0, 9_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id")).alias("serial_number"), (F.col("id") % 2).alias("x")
    )
    found = add_surrogate_id(rows).orderBy("id").collect()
    assert [r.id for r in found] == list(range(1, 9_001))
    keys = [(r.serial_number is None, r.serial_number or 0) for r in found]
    assert keys == sorted(keys)
