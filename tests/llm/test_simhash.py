"""SimHash against a brute-force version over all pairs."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from tilltrail.llm import simhash
from tilltrail.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7) for i, t in rows], DOCS)


def plain_fingerprint(text: str | None) -> int:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows) -> dict:
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    least = {}
    for i, one in prints:
        seen, todo = {one}, [one]
        while todo:
            x = todo.pop()
            for _, y in prints:
                if y not in seen and (x ^ y).bit_count() <= 3:
                    seen.add(y)
                    todo.append(y)
        ids = [j for j, y in prints if y in seen and j is not None]
        least.setdefault((i, one), min(ids, default=None))
    return least


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize(
    "text",
    [None, "", " \t\n", "one", "ONE Two", "a b c", "A b C d", "É é\x0bx y", "x " * 700, "nb sp one two three four"],
)
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == signed(plain_fingerprint(text))


def test_long_texts_are_cut_at_blanks(monkeypatch):
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9))) for _ in range(3000))
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 50)
    assert simhash.fingerprint(text.encode()) == signed(plain_fingerprint(text))


def near_texts() -> list[tuple]:
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([40, 150, 400]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((at, " ".join(copy)))
            at += 3
    rnd.shuffle(rows)
    return rows


EDGES = [(1, None), (2, ""), (4, "x"), (5, "x"), (5, "x"), (5, "other text of id five"), (None, "x"), (None, "lonely")]


@pytest.mark.parametrize("run_rows", [simhash.RUN_ROWS, 2])
def test_components_are_those_of_all_pairs(spark, run_rows):
    rows = near_texts() + EDGES
    found = simhash.near_duplicates(docs_of(spark, rows), run_rows=run_rows).collect()
    expected = plain_components(rows)
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in found} == {
        (i, signed(x)): root for (i, x), root in expected.items()
    }
    assert len({r["component_id"] for r in found}) < 0.7 * len(rows)


def test_links_within_any_distance(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(25)})
    table = spark.createDataFrame([(signed(x),) for x in prints], "fingerprint long")
    for max_bits in (0, 1, 2, 3, 5):
        pairs = {(r["a"], r["b"]) for r in simhash.links(table, max_bits).collect()}
        assert all((a ^ b).bit_count() <= max_bits if (a ^ b) >= 0 else ((a ^ b) + (1 << 64)).bit_count() <= max_bits for a, b in pairs)
        joined: dict = {x: x for x in prints}

        def root(x, joined=joined):
            while joined[x] != x:
                x = joined[x]
            return x

        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= max_bits:
                    joined[root(a)] = root(b)
        ours: dict = {x: x for x in prints}
        for a, b in pairs:
            ours[root(a % (1 << 64), ours)] = root(b % (1 << 64), ours)
        groups = lambda up: {frozenset(y for y in prints if root(y, up) == root(x, up)) for x in prints}
        assert groups(ours) == groups(joined)


def test_one_of_each_group_stays_with_its_columns(spark):
    rows = near_texts() + EDGES
    docs = docs_of(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs).collect()
    groups = {r["component_id"] for r in found if r["component_id"] is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(groups)
    assert ids.count(None) == 1


def test_no_documents(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert simhash.one_of_each(docs_of(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    table = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (5, None), (100, 101)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(table).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
