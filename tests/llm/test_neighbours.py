"""Neighbours against brute force: exact scores, order and ties; recall."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tilltrail.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.0, 0) for i, v in rows], SCHEMA)


def brute(rows, step, k):
    sound = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    out = {}
    for q, x in sound:
        if q % step == 0:
            scored = sorted({(-float((x * v).sum()), i) for i, v in sound if i != q})
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found_in(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("kind", ["random", "copies", "lengths"])
def test_all_leaves_opened_is_brute_force(spark, kind, monkeypatch):
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((600, 8)).astype(np.float32)
    if kind == "copies":
        vectors[::3] = vectors[0]
    if kind == "lengths":
        vectors *= draw.uniform(0.1, 5, (600, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "SEARCHED", 10)
    found = found_in(neighbours.nearest(table_of(spark, rows), 20, 20, trees=2, share=2.0, leaf_rows=20))
    expected = brute(rows, 20, 20)
    assert found.keys() == expected.keys()
    for q, own in expected.items():
        assert [i for i, _ in found[q]] == [i for i, _ in own]
        assert np.allclose([s for _, s in found[q]], [s for _, s in own], rtol=0, atol=1e-12)


def test_recall_at_production_parameters(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    expected = brute(rows, 20, 20)
    found = found_in(neighbours.nearest(table))
    hits = sum(len({i for i, _ in own} & {i for i, _ in found[q]}) for q, own in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_unusable_vectors_take_no_part(spark):
    bad = [None, [], [0.0, 0.0], [math.nan, 1.0], [math.inf, 1.0], [None, 1.0], [1.0, 2.0, 3.0]]
    rows = [(20 * i, v) for i, v in enumerate(bad)] + [(None, [1.0, 1.0]), (1000, [1.0, 2.0]), (1001, [3.0, 1.0]), (1001, [3.0, 1.0]), (1002, [1.0, 0.0])]
    found = found_in(neighbours.nearest(table_of(spark, rows)))
    assert found == {1000: [(1001, 5.0), (1002, 1.0)]}


def test_nothing_to_search(spark):
    assert neighbours.nearest(table_of(spark, [])).count() == 0
    assert neighbours.nearest(table_of(spark, [(20, [1.0])])).count() == 0


def test_repeated_rows_take_no_places(spark, monkeypatch):
    """Thirty equal rows of one id, and all vectors equal: neighbours are as many different ids as there are."""
    draw = np.random.default_rng(5)
    others = [(i, draw.standard_normal(4).astype(np.float32).tolist()) for i in range(2, 31)]
    rows = [(1, [9.0, 9.0, 9.0, 9.0])] * 30 + others + [(20, others[18][1])] * 5
    expected = brute(list({(i, tuple(v)) for i, v in rows}), 20, 20)
    for block in (32_768, 8):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
        found = found_in(neighbours.nearest(table_of(spark, rows), share=2.0, trees=2, leaf_rows=8))
        assert {q: [i for i, _ in own] for q, own in found.items()} == {q: [i for i, _ in own] for q, own in expected.items()}
    same = [(i // 3, [1.0, 2.0]) for i in range(120)]
    found = found_in(neighbours.nearest(table_of(spark, same), share=2.0))
    assert [i for i, _ in found[0]] == list(range(1, 21)) and [i for i, _ in found[20]] == list(range(20))


def test_ids_with_several_vectors_count_with_the_best(spark, monkeypatch):
    draw = np.random.default_rng(6)
    rows = [(i % 60, draw.standard_normal(5).astype(np.float32).tolist()) for i in range(400)]
    sound = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    expected = {}
    for q in (0, 20, 40):
        best = {}
        for i, v in sound:
            if i != q:
                best[i] = max([best.get(i, -np.inf), *[float((x * v).sum()) for j, x in sound if j == q]])
        expected[q] = sorted(best, key=lambda i: (-best[i], i))[:20]
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    found = found_in(neighbours.nearest(table_of(spark, rows), share=2.0, trees=2, leaf_rows=20))
    assert {q: [i for i, _ in own] for q, own in found.items()} == expected


def test_rows_are_sent_once_per_tree_and_queries_to_few_buckets(spark):
    """On structured vectors a query opens few leaves, and what is sent for it does not grow with the rows."""
    draw = np.random.default_rng(7)
    sent = {}
    for groups in (40, 160):
        centres = draw.standard_normal((groups, 16)) * 10
        vectors = np.repeat(centres, 50, axis=0) + draw.standard_normal((groups * 50, 16)) * 0.1
        forest = neighbours.fit(vectors, len(vectors), float(np.linalg.norm(vectors, axis=1).max()), 4, 50)
        leaves = forest.leaves(vectors)
        held = np.stack([np.bincount(leaves[:, t], minlength=forest.inner + 1) for t in range(4)])
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(neighbours, "BLOCK_ROWS", 100)
            index = neighbours._Index.of(forest, held, len(vectors), 400 / len(vectors))
        assert index.blocks.sum() <= 4 * len(vectors) / 100 + 4
        distances = forest.distances(forest.lifted(vectors[::20])[:, :-1])
        opened = [{int(index.buckets[t, leaf]) for t, leaf in neighbours.search(d, held, index.wanted)} for d in distances]
        sent[groups] = np.mean([len(b) for b in opened])
    assert sent[160] < 1.5 * sent[40]
