"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The trees are fitted on a bounded sample and index every row. A query searches all trees through
one shared priority queue that opens the most promising branch of any tree next, until the leaves
it has opened hold a given share of the rows. All rows of these leaves are scored exactly.

For the trees a vector gets one more coordinate that brings all to the same length, which makes the
largest inner product the least angle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilltrail.llm.store import stored

TREES = 6
SAMPLE_ROWS = 20_000
LEAF_ROWS = 50
SHARE = 1.3
BUCKETS = 4
BLOCK_ROWS = 32_768
SEARCHED = 64
TOLERANCE = 1e-9


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: node ``n`` has the children ``2n+1`` and ``2n+2``."""

    depth: int
    longest: float
    normals: np.ndarray
    limits: np.ndarray

    @property
    def inner(self) -> int:
        return 2**self.depth - 1

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.longest**2 - (vectors**2).sum(axis=1))
        return np.column_stack([vectors, np.sqrt(rest)])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector, a column per tree."""
        lifted = self.lifted(vectors)
        out = np.empty((len(lifted), len(self.normals)), dtype=np.int32)
        for tree, (normals, limits) in enumerate(zip(self.normals, self.limits, strict=True)):
            node = np.zeros(len(lifted), dtype=np.int64)
            for _ in range(self.depth):
                side = (lifted * normals[node]).sum(axis=1) > limits[node]
                node = 2 * node + 1 + side
            out[:, tree] = node - self.inner
        return out

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """How far each leaf is from each query: the farthest boundary on the way to it.

        By query, tree and leaf; negative where the query is inside by that much.
        """
        out = np.empty((len(queries), len(self.normals), self.inner + 1))
        for tree, (normals, limits) in enumerate(zip(self.normals, self.limits, strict=True)):
            margins = queries @ normals[:, :-1].T - limits
            far = np.full((len(queries), 1), -np.inf)
            for level in range(self.depth):
                own = margins[:, 2**level - 1 : 2 ** (level + 1) - 1]
                far = np.stack([np.maximum(far, own), np.maximum(far, -own)], axis=2).reshape(len(queries), -1)
            out[:, tree] = far
        return out


def search(distances: np.ndarray, held: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """The leaves that one query opens, as (tree, leaf), until they hold ``wanted`` rows.

    One priority queue holds the nearest unopened leaf of every tree.
    """
    order = np.argsort(distances, axis=1, kind="stable")
    near = np.take_along_axis(distances, order, axis=1).tolist()
    leaves = order.tolist()
    rows_of = np.take_along_axis(held, order, axis=1).tolist()
    queue = [(near[tree][0], tree, 0) for tree in range(len(near))]
    heapq.heapify(queue)
    found, rows = [], 0
    while queue and rows < wanted:
        _, tree, at = queue[0]
        if rows_of[tree][at]:
            rows += rows_of[tree][at]
            found.append((tree, leaves[tree][at]))
        if at + 1 < len(near[tree]):
            heapq.heapreplace(queue, (near[tree][at + 1], tree, at + 1))
        else:
            heapq.heappop(queue)
    return found


def fit(sample: np.ndarray, rows: int, longest: float, trees: int, leaf_rows: int, seed: int = 42) -> Forest:
    """Each node cuts its sample in half, along the line between two of its points.

    A tree is as deep as the number of rows asks for, but keeps some eight sample points to a leaf.
    """
    wanted = np.log2(max(1, rows / leaf_rows))
    possible = np.log2(max(1, len(sample) / 8))
    depth = max(0, round(float(min(wanted, possible))))
    draw = np.random.default_rng(seed)
    inner = 2**depth - 1
    shape = Forest(depth, longest, np.zeros((trees, inner, sample.shape[1] + 1)), np.zeros((trees, inner)))
    lifted = shape.lifted(sample)
    for tree in range(trees):
        members = {0: np.arange(len(lifted))}
        for node in range(inner):
            mine = members.pop(node)
            normal = draw.standard_normal(lifted.shape[1])
            if len(mine) > 1:
                a, b = draw.choice(mine, 2, replace=False)
                between = lifted[a] - lifted[b]
                normal = between if np.linalg.norm(between) > 0 else normal
            normal /= np.linalg.norm(normal)
            heights = lifted[mine] @ normal
            limit = float(np.median(heights)) if len(mine) else 0.0
            shape.normals[tree, node], shape.limits[tree, node] = normal, limit
            members[2 * node + 1], members[2 * node + 2] = mine[heights <= limit], mine[heights > limit]
    return shape


@dataclass(frozen=True)
class _Index:
    """The forest, rows per leaf, and how leaves are gathered into buckets and blocks."""

    forest: Forest
    held: np.ndarray
    buckets: np.ndarray
    blocks: np.ndarray
    wanted: float

    @staticmethod
    def of(forest: Forest, held: np.ndarray, rows: int, share: float) -> _Index:
        """Leaves side by side share a bucket of about ``BLOCK_ROWS``; one with a large leaf is dealt to blocks.

        So a query goes to as many buckets as its leaves lie in, and a tree sends each row to one place.
        """
        per_tree = max(BUCKETS, -(-rows // BLOCK_ROWS))
        before = np.cumsum(held, axis=1) - held
        part = np.minimum(per_tree - 1, before * per_tree // max(1, rows))
        buckets = part + np.arange(len(held))[:, None] * per_tree
        sizes = np.bincount(buckets.ravel(), held.ravel(), minlength=len(held) * per_tree)
        blocks = np.maximum(1, np.ceil(sizes / (2 * BLOCK_ROWS))).astype(int)
        return _Index(forest, held, buckets, blocks, share * rows)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _spread(ids: np.ndarray, parts: int) -> np.ndarray:
    """A part for each id, by multiplicative hashing."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


# --- tasks --------------------------------------------------------------------------------------


def _count_leaves(shared):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        counts = np.zeros((len(forest.normals), forest.inner + 1), dtype=np.int64)
        for batch in batches:
            if len(batch):
                for tree, leaves in enumerate(forest.leaves(_matrix(batch.column("vector"))).T):
                    counts[tree] += np.bincount(leaves, minlength=forest.inner + 1)
        trees, leaves = np.nonzero(counts)
        columns = [pa.array(trees, pa.int32()), pa.array(leaves, pa.int32()), pa.array(counts[trees, leaves])]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "n"])

    return of_batches


DEALT = ["bucket", "block", "asks", "leaves", "vec_id", "further", "vector"]


def _deal(shared, query_step: int):
    """Each row once per tree, to the bucket of its leaf; each query to every bucket it opens leaves of.

    Rows come with their leaf, queries with all leaves they open there and to every block of the bucket.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: _Index = shared.value
        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column("vec_id").to_numpy()
            vectors = _matrix(batch.column("vector"))
            leaves = index.forest.leaves(vectors)
            for tree in range(leaves.shape[1]):
                bucket = index.buckets[tree, leaves[:, tree]]
                block = _spread(ids, 1 << 30) % index.blocks[bucket]
                yield _dealt(batch, np.arange(len(ids)), bucket, block, False, leaves[:, tree, None].tolist())
            asks = np.flatnonzero(ids % query_step == 0)
            for some in np.split(asks, range(SEARCHED, len(asks), SEARCHED)):
                at, bucket, block, opened = [], [], [], []
                distances = index.forest.distances(vectors[some])
                for i, near in zip(some, distances, strict=True):
                    own: dict[int, list[int]] = {}
                    for tree, leaf in search(near, index.held, index.wanted):
                        own.setdefault(int(index.buckets[tree, leaf]), []).append(leaf)
                    for b, leaves_there in own.items():
                        for k in range(index.blocks[b]):
                            at.append(i)
                            bucket.append(b)
                            block.append(k)
                            opened.append(leaves_there)
                if at:
                    yield _dealt(batch, np.array(at), np.array(bucket), np.array(block), True, opened)

    return of_batches


def _dealt(batch: pa.RecordBatch, at: np.ndarray, bucket: np.ndarray, block: np.ndarray, asks: bool, leaves: list) -> pa.RecordBatch:
    rows = batch.take(pa.array(at, pa.int64()))
    own = [pa.array(bucket, pa.int32()), pa.array(block, pa.int32()), pa.array(np.full(len(at), asks)), pa.array(leaves, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([*own, *(rows.column(c) for c in ("vec_id", "further", "vector"))], DEALT)


def _first_of_equals(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of equal vectors the ``k`` least ids: no query can have a further one among its nearest."""
    order = np.argsort(ids, kind="stable")
    _, group = np.unique(vectors[order], axis=0, return_inverse=True)
    group = group.ravel()
    by_group = np.argsort(group, kind="stable")
    counts = np.bincount(group)
    place = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[by_group[place < k]]


class _Best:
    """Rows that can be among the ``k`` best of each query, so far.

    Rough scores come from matrix products, whose last bits depend on where a row stands. So what
    is close to the ``k``-th is kept too, and what is left at the end is scored pair by pair: equal
    vectors get equal scores. An id that has several vectors counts once: only one of them raises the limit.
    """

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _limits(self, who: np.ndarray | slice) -> np.ndarray:
        kth = self.scores[who].min(axis=1)
        return np.where(np.isfinite(kth), kth - TOLERANCE * np.maximum(1.0, np.abs(kth)), -np.finfo(float).max)

    def add(self, who: np.ndarray, rows: np.ndarray, rough: np.ndarray, further: np.ndarray) -> None:
        at, row = np.nonzero(rough >= self._limits(who)[:, None])
        self.found.append((who[at], rows[row], rough[at, row]))
        both = np.concatenate([self.scores[who], rough[:, ~further]], axis=1)
        self.scores[who] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        who, rows, rough = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = rough >= self._limits(slice(None))[who]
        return who[keep], rows[keep]


class _Block:
    """The rows of one block, to which its queries come batch by batch."""

    def __init__(self, key: tuple[int, int]) -> None:
        self.key = key
        self.parts: list[pa.RecordBatch] = []
        self.rows: tuple | None = None

    def _gathered(self) -> tuple:
        if self.rows is None:
            table = pa.Table.from_batches(self.parts)
            self.parts = []
            column = lambda name: table.column(name).combine_chunks()
            self.rows = (
                column("vec_id").to_numpy(),
                column("leaves").flatten().to_numpy(),
                column("further").to_numpy(zero_copy_only=False),
                _matrix(column("vector")),
            )
        return self.rows

    def best(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
        if not self.parts and self.rows is None:
            return None
        ids, leaf, further, vectors = self._gathered()
        query_ids, asked = queries.column("vec_id").to_numpy(), _matrix(queries.column("vector"))
        opened = queries.column("leaves")
        owner = np.repeat(np.arange(len(opened)), opened.value_lengths().to_numpy())
        best = _Best(len(query_ids), k)
        for who, inside in _by_leaf(owner, opened.flatten().to_numpy(), leaf):
            if len(inside) > k + 1:
                inside = inside[_first_of_equals(vectors[inside], ids[inside], k + 1)]
            rough = asked[who] @ vectors[inside].T
            rough[query_ids[who][:, None] == ids[inside][None, :]] = -np.inf
            best.add(who, inside, rough, further[inside])
        q, r = best.left()
        score = np.empty(len(q))
        for at in range(0, len(q), BLOCK_ROWS):
            part = slice(at, at + BLOCK_ROWS)
            score[part] = (asked[q[part]] * vectors[r[part]]).sum(axis=1)
        # A query id with several vectors asks with each; an id found by several vectors counts with the best.
        query, row = query_ids[q], ids[r]
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        firsts = np.sort(np.unique(np.stack([query, row]), axis=1, return_index=True)[1]) if len(query) else np.empty(0, np.int64)
        query, row, score = query[firsts], row[firsts], score[firsts]
        keep = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (query, row, score)], ["query_id", "vec_id", "score"])


def _score_blocks(k: int):
    """Scores of blocks sorted by key, rows before queries. A block's rows are held, its queries pass by."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Block | None = None
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "block", "asks")]
            cuts = np.flatnonzero(np.any([np.diff(key) != 0 for key in keys], axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(batch)]):
                if start == end:
                    continue
                key = (int(keys[0][start]), int(keys[1][start]))
                if held is None or held.key != key:
                    held = _Block(key)
                part = batch.slice(start, end - start)
                if not keys[2][start]:
                    held.parts.append(part)
                elif (found := held.best(part, k)) is not None:
                    yield found

    return of_batches


def _by_leaf(owner: np.ndarray, wanted: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each leaf the queries that open it and the rows it holds."""
    asks, holds = np.argsort(wanted, kind="stable"), np.argsort(leaf, kind="stable")
    opened, rows = wanted[asks], leaf[holds]
    for one in np.intersect1d(opened, rows):
        who = asks[np.searchsorted(opened, one) : np.searchsorted(opened, one, side="right")]
        yield owner[who], holds[np.searchsorted(rows, one) : np.searchsorted(rows, one, side="right")]


# --- search -------------------------------------------------------------------------------------


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows without repeats, and whether a row is a ``further`` vector of its id. Nothing is shuffled if ids are unique."""
    counts = rows.agg(F.count(F.lit(1)), F.count_distinct("vec_id")).first()
    if counts[0] == counts[1]:
        return rows.withColumn("further", F.lit(False))
    apart = rows.withColumn("_hash", F.xxhash64("vector")).dropDuplicates(["vec_id", "_hash", "vector"])
    apart = stored(apart, "vectors")
    firsts = apart.groupBy("vec_id").agg(F.min(F.struct("_hash", "vector")).alias("_first"))
    keyed = [side.withColumn("_h", F.hash("vec_id")) for side in (apart, firsts)]
    further = F.struct("_hash", "vector") != F.col("_first")
    return stored(keyed[0].join(keyed[1], ["vec_id", "_h"]).select("vec_id", "vector", further.alias("further")), "vectors")


def nearest(
    table: DataFrame,
    query_step: int = 20,
    k: int = 20,
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    leaf_rows: int = LEAF_ROWS,
    share: float = SHARE,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` largest inner products found.

    Queries are the rows whose ``vec_id`` is divisible by ``query_step``, candidates all rows but
    those with the query's id; ties go to the smaller id. Rows without an id, and vectors that are null, zero,
    or hold null or non-finite components, take no part, nor do those that are not as long as
    most vectors are. Repeated rows count once; an id with several vectors counts with the one that scores best, and
    as a query asks with each. Few rows, or none, give as many neighbours as there are. Only ``vec_id`` and ``embedding``
    are read, so other names cannot clash.

    ``share`` is how many rows, as a share of all, the opened leaves hold, rows counted once per tree.
    It trades time for recall: vectors without any structure, as in the test data, need most of it, and
    structured ones far less. ``sample_rows`` bounds what the driver sees.
    """
    spark = table.sparkSession
    rows = table.select("vec_id", F.col("embedding").alias("vector")).filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    rows = _told_apart(rows.filter(F.size("vector") == lengths[0]["n"]))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, longest = rows.agg(F.count(F.lit(1)), F.sqrt(F.max(norm))).first()
    # Few more rows than wanted by their hash, so that tasks do not each offer a whole sample to the driver.
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.2 * sample_rows / total + 100 / total))
    sample = rows.filter(spread).select("vector").orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample_rows).collect()
    forest = fit(np.array([r["vector"] for r in sample], dtype=np.float64), total, longest, trees, leaf_rows)
    shared_forest = spark.sparkContext.broadcast(forest)
    counted = rows.mapInArrow(_count_leaves(shared_forest), "tree int, leaf int, n long")
    held = np.zeros((trees, forest.inner + 1), dtype=np.int64)
    for row in counted.groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        held[row["tree"], row["leaf"]] = row["n"]
    index = spark.sparkContext.broadcast(_Index.of(forest, held, total, share))
    kind = rows.schema["vector"].dataType.simpleString()
    types = ["int", "int", "boolean", "array<int>", "long", "boolean", kind]
    dealt = rows.mapInArrow(_deal(index, query_step), ", ".join(f"{n} {t}" for n, t in zip(DEALT, types, strict=True)))
    blocks = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks")
    scored = blocks.mapInArrow(_score_blocks(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
