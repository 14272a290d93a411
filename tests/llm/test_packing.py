"""Packing: whole documents, no overlaps, permitted sizes, and no worse than a plain best fit."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from tilltrail.llm import packing

CAPACITIES = (16, 32, 64)


def docs_of(spark, sizes):
    rows = [(i, None if n is None else "w " * n, 3, 4) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, text string, bin_id int, length int")


def checked(rows, sizes, capacities):
    """The layout must hold every document whole, without overlaps, in the smallest size that fits."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["bin_id"]].append((r["bin_offset"], r["length"], r["capacity"]))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == (n or 0) + 1
    for own in bins.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert {c for _, _, c in own} == {min(c for c in capacities if c >= at)}
    assert sorted(bins) == list(range(len(bins)))
    return bins


def plain_best_fit(lengths: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_layout(spark):
    rnd = random.Random(7)
    sizes = [rnd.choice([0, 3, 5, 9, 14, 20, 40, 63, 64, 150]) for _ in range(300)] + [None, 0, 1000]
    rows = packing.pack(docs_of(spark, sizes), CAPACITIES, buckets=4).collect()
    checked(rows, sizes, CAPACITIES)


def test_one_size_is_plain_best_fit_by_falling_length():
    rnd = random.Random(9)
    for _ in range(30):
        lengths = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 200))]
        bins = packing.plan(dict(Counter(lengths)), (50,))
        assert sum(b.count for b in bins) == plain_best_fit(lengths, 50)
        assert sum(b.count * b.used for b in bins) == sum(lengths)


def test_several_sizes_cost_no_more_than_the_best_single_one():
    rnd = random.Random(10)
    ours = single = 0
    for _ in range(20):
        lengths = [rnd.choice([rnd.randint(1, 16), rnd.randint(20, 32), rnd.randint(33, 64)]) for _ in range(300)]
        bins = packing.plan(dict(Counter(lengths)), CAPACITIES, 2)
        ours += sum(b.count * (b.capacity + 2) for b in bins)
        single += plain_best_fit(lengths, 64) * 66
    assert ours <= single


def test_plan_handles_many_equal_documents_at_once():
    bins = packing.plan({7: 10**9, 3: 10**9}, (16, 32))
    assert sum(b.count * b.used for b in bins) == 10**10
    assert len(bins) < 50


def test_repeated_rows_and_missing_ids(spark):
    docs = docs_of(spark, [5, 5])
    rows = docs.unionByName(docs).unionByName(docs.selectExpr("CAST(NULL AS long) AS doc_id", "text", "bin_id", "length"))
    found = packing.pack(rows, CAPACITIES).collect()
    assert len(found) == 6
    assert len({(r["bin_id"], r["bin_offset"]) for r in found}) == 6


def test_no_documents(spark):
    assert packing.pack(docs_of(spark, [])).count() == 0
