"""The prefix trie against a plain one; slots of the minimal perfect hash; edges."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tilltrail.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[conv].append(((turn is not None, turn or 0), said, (role, text)))
    plain = {c: [t[2] for t in sorted(turns)] for c, turns in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in plain.items():
        taken = zlib.crc32(str(c).encode()) % 6
        base = plain.get(c - c % 100 if c >= 0 else c + -c % 100, [])
        turns = tuple(base[:taken] + own[taken:])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    digest = {p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() for p in members}
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest[p])
            for p, m in members.items()
        ),
        key=str,
    )


def found(df):
    return sorted((tuple(r) for r in prefixtrie.prefix_trie(df).select(*COLUMNS).collect()), key=str)


def some_rows():
    """Conversations that share openings, of one group and of others, some without a first one."""
    rng = random.Random(7)
    rows = []
    for conv in [*range(40), *range(100, 160), *range(201, 230), 1000, 1003]:
        said = [("user", "hello"), ("assistant", "hi é")] if rng.random() < 0.5 else []
        said += [(rng.choice(["user", "assistant", None]), rng.choice("ab")) for _ in range(rng.randrange(1, 9))]
        rows += [(conv, i, role, text) for i, (role, text) in enumerate(said)]
    return rows


@pytest.mark.parametrize("wide, deep", [(1024, 1024), (2, 3), (5, 1)])
def test_equals_plain_trie(spark, monkeypatch, wide, deep):
    """Whatever the shards: small classes force sums to be passed on between them."""
    monkeypatch.setattr(prefixtrie, "WIDE", wide)
    monkeypatch.setattr(prefixtrie, "DEEP", deep)
    rows = some_rows()
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)


def test_small_batches_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "STRETCH", 3)
    monkeypatch.setattr(prefixtrie, "FLUSH_ROWS", 2)
    monkeypatch.setattr(prefixtrie, "CHUNK_IDS", 2)
    rows = some_rows()
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [
        (1, None, "user", "null turns come first"),
        (1, 0, "user", "b"),
        (1, 0, "user", "a"),
        (1, 2, None, None),
        (1, 2, None, None),
        (2, 5, "", ""),
        (None, 0, "user", "of no conversation"),
        (-7, 1, "user", "x" * 100_000),
        (-7, 2, "us", "er"),
        (-7, 3, "user", ""),
        (0, 0, "user", "opening"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1, "n") for r in rows], SCHEMA + ", node string, depth int, parent string")
    assert found(df) == plain_trie(rows)


def test_conversations_without_turns_end_at_the_root(spark):
    """Its own turns all replaced, and no first conversation to take any from."""
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(lone, 0, "user", "gone")]
    [root] = found(spark.createDataFrame(rows, SCHEMA))
    assert root[:7] == (lone, 0, None, 1, 0, 1, 0)
    assert root[7] == hashlib.sha256(str(lone).encode()).hexdigest()


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_many_equal_conversations(spark):
    rows = [(100 * i, t, "user", f"turn {t}") for i in range(3000) for t in range(3)] + [(7, 0, "user", "other")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        keys = rng.integers(0, 2**63, (n, 2)).astype(np.uint64)
        table = prefixtrie.SlotTable(keys)
        slots = table.slots(keys)
        assert sorted(slots) == list(range(n))
        assert (table.keys[slots] == keys).all()
        strangers = rng.integers(0, 2**63, (500, 2)).astype(np.uint64)
        assert (table.slots(strangers) == -1).all()


def test_repeated_digests_are_refused():
    with pytest.raises(ValueError, match="repeat"):
        prefixtrie.SlotTable(np.ones((2, 2), dtype=np.uint64))
