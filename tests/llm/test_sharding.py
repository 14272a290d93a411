"""Sharding: exact sizes, no gaps, every row once, and a uniform draw."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilltrail.llm import sharding

SCHEMA = "doc_id long, text string, shard int, size int, slot int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], SCHEMA)


def test_rows_sizes_and_slots(spark):
    rows = [(i, ("é" * (i % 50)) if i % 7 else None) for i in range(1000)] + [(5, "same")] * 300 + [(None, "x")] * 3
    found = sharding.shard_documents(docs_of(spark, rows)).collect()
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("rows", None)
    assert sorted(slots) == list(range(24))
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    sizes = [len(own) for own in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_same_result_however_the_input_is_split(spark):
    rows = [(i, "t" * (i % 9)) for i in range(500)]
    one = sharding.shard_documents(docs_of(spark, rows).coalesce(1)).collect()
    many = sharding.shard_documents(docs_of(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, many), key=str)


def test_fewer_rows_than_shards_and_none(spark):
    found = sharding.shard_documents(docs_of(spark, [(1, "a"), (2, "b")])).collect()
    assert sorted((r["shard"], r["slot"]) for r in found) == [(0, 0), (1, 0)]
    assert sharding.shard_documents(docs_of(spark, [])).count() == 0


def test_matrix_has_the_sums_it_must_have():
    parts, sizes = [7, 0, 30, 63], sharding.shard_sizes(100, 6)
    matrix = np.array(sharding.communication_matrix(parts, sizes, 1))
    assert matrix.sum(axis=1).tolist() == parts and matrix.sum(axis=0).tolist() == sizes
    large = [10**10, 3 * 10**10 + 5]
    sizes = sharding.shard_sizes(sum(large), 24)
    matrix = np.array(sharding.communication_matrix(large, sizes, 2))
    assert matrix.sum(axis=1).tolist() == large and matrix.sum(axis=0).tolist() == sizes
    assert matrix.min() >= 0


def test_counts_are_hypergeometric():
    draws = np.array([sharding.communication_matrix([10, 30], [20, 20], seed)[0][0] for seed in range(4000)])
    assert abs(draws.mean() - 5) < 0.1
    assert abs(draws.var() - 10 * 0.25 * 30 / 39) < 0.15


def test_neighbours_part_and_slots_are_mixed(spark):
    found = sharding.shard_documents(docs_of(spark, [(i, "t") for i in range(2400)])).collect()
    shard = {r["doc_id"]: r["shard"] for r in found}
    together = sum(shard[i] == shard[i + 1] for i in range(2399)) / 2399
    assert abs(together - 1 / 24) < 0.02
    slot = np.array([[r["doc_id"], r["slot"]] for r in found], dtype=float).T
    assert abs(np.corrcoef(slot)[0, 1]) < 0.1


def test_draws_follow_the_exact_law():
    draw = np.random.default_rng(5)
    for good, bad, rows in ((3, 4, 5), (20, 20, 10), (1, 9, 3), (6, 2, 7)):
        found = Counter(sharding.taken_of(draw, good, bad, rows) for _ in range(20_000))
        ways = {k: math.comb(good, k) * math.comb(bad, rows - k) for k in range(good + 1) if 0 <= rows - k <= bad}
        assert set(found) <= set(ways)
        for k, n in ways.items():
            p = n / math.comb(good + bad, rows)
            assert abs(found[k] / 20_000 - p) < 5 * math.sqrt(p * (1 - p) / 20_000) + 1e-9


def test_draws_beyond_a_thousand_million_rows():
    draw = np.random.default_rng(6)
    good, bad, rows = 4 * 10**10, 96 * 10**10, 4 * 10**9
    found = np.array([sharding.taken_of(draw, good, bad, rows) for _ in range(400)], dtype=float)
    mean, var = rows * 0.04, rows * 0.04 * 0.96 * (1 - rows / 10**12)
    assert abs(found.mean() - mean) < 5 * math.sqrt(var / 400)
    assert 0.7 < found.var() / var < 1.35
    assert sharding.taken_of(draw, 0, 10**12, 10**10) == 0 and sharding.taken_of(draw, 10**12, 0, 10**10) == 10**10
    assert sharding.taken_of(draw, 7, 5, 12) == 7 and sharding.taken_of(draw, 7, 5, 0) == 0


def test_matrix_and_permutations_by_hand(spark):
    """The same shuffle in plain Python; only the hashes come from Spark. Their order is that of unsigned numbers."""
    rows = [(i % 150, "t" * (i % 4)) for i in range(600)] + [(None, None)] * 40
    columns, parts, shards, seed = ["doc_id", "text"], 7, 5, 3
    df = docs_of(spark, rows)
    found = sorted(map(tuple, sharding.shuffle_into_shards(df, columns, shards, parts, seed).collect()), key=str)
    numbered, seen = [], Counter()
    for row in rows:
        numbered.append((*row, seen[row]))
        seen[row] += 1
    copies = spark.createDataFrame(numbered, "doc_id long, text string, copy long")
    first = F.xxhash64(F.lit(seed), F.struct(*columns), "copy")
    hashed = copies.select("doc_id", "text", first.alias("h")).withColumn("o", F.xxhash64(F.lit(seed + 1), "h")).collect()
    own = {p: sorted((r for r in hashed if r.h % parts == p), key=lambda r: r.o % 2**64) for p in range(parts)}
    assert min(map(len, own.values())) > 0
    sizes = sharding.shard_sizes(len(rows), shards)
    matrix = sharding.communication_matrix([len(own[p]) for p in range(parts)], sizes, seed)
    sent = []
    for p, ends in enumerate(np.cumsum(matrix, axis=1).tolist()):
        sent += [(r.doc_id, r.text, sum(e <= place for e in ends), r.h, place) for place, r in enumerate(own[p])]
    frame = spark.createDataFrame(sent, "doc_id long, text string, shard int, h long, place int")
    arrived = frame.withColumn("o", F.xxhash64(F.lit(seed + 2), "h", F.col("place").cast("long"))).collect()
    expected = []
    for s in range(shards):
        mine = sorted((r for r in arrived if r.shard == s), key=lambda r: r.o % 2**64)
        expected += [(r.doc_id, r.text, s, slot) for slot, r in enumerate(mine)]
    assert found == sorted(expected, key=str)


def test_equal_rows_lie_apart(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 4)
    rows = [(7, "same")] * 5000 + [(i, "other") for i in range(100)]
    df = docs_of(spark, rows)
    copies = sharding._copies(df, ["doc_id", "text"])
    assert Counter((r[0].doc_id, r[1]) for r in copies.collect()) == Counter(
        [(7, i) for i in range(5000)] + [(i, 0) for i in range(100)]
    )
    found = sharding.shuffle_into_shards(df, ["doc_id", "text"], 4).collect()
    same = Counter(r["shard"] for r in found if r["text"] == "same")
    assert sum(same.values()) == 5000 and max(same.values()) - min(same.values()) < 100
    with pytest.raises(ValueError, match="slot"):
        sharding.shuffle_into_shards(df, ["doc_id", "slot"])


def test_very_long_texts(spark):
    rows = [(1, "é" * 3_000_000), (2, ""), (3, None)]
    found = {r["doc_id"]: r for r in sharding.shard_documents(docs_of(spark, rows)).collect()}
    assert (found[1]["size"], found[1]["text_crc32"]) == (6_000_008, zlib.crc32(("é" * 3_000_000).encode()))
    assert found[2]["size"] == found[3]["size"] == 8
