"""Prefix trie of conversations: which openings are shared, by how many, and what sharing them saves.

A node is a distinct sequence of first turns. It is known by a digest that is a sum over its turns, each hashed
with its depth, so digests are running sums and a parent's digest is the node's less its own turn. Members are counted per
digest before any shuffle. Sums over subtrees are then taken in node tables: a shard's digests get slots of a
minimal perfect hash, checked against the stored digests, counts are scattered into flat arrays by slot, and each node adds
to its parent's slot, deepest first.

Shards are subtrees. A node with many members would make a large one, so nodes are classed by members (powers of
``WIDE``) and by depth (blocks of ``DEEP``): a shard holds one class below one node, so at most ``WIDE`` nodes of each of
``DEEP`` depths, and its top passes its sums on to its parent in a later class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilltrail.llm.store import discard, stored, stored_at
from tilltrail.operators.ordering import placed

SHARED_GROUP = 100
SHARED_TURNS = 6
WIDE = 256
DEEP = 1024
LANES = 4
STRETCH = 1 << 16
FLUSH_ROWS = 1 << 16
CHUNK_IDS = 4096


# --- conversations --------------------------------------------------------------------------------


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, a hash ``said`` of role and text, and the ``chars`` of the text.

    Texts go no further: what follows moves their hashes. The length of the role keeps role and text apart.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256))
    chars = F.length(text).cast("long")
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), chars.alias("chars")
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with the first turns of their group's first one, as rows and as lengths.

    Conversation ``c`` takes the first ``h`` turns of conversation ``c - c % 100`` and then its own after its first ``h``, where
    ``h = crc32(c) % 6``. Rows: ``conv_id``, ``depth`` (from 1), ``said``, ``chars``. Lengths: ``conv_id``, ``length``.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "said"]
    rows = placed(turns_of(conversations), order, "place", "trie-turns")
    convs = rows.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("own"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS
    convs = convs.withColumns({"taken": taken, "base": F.col("conv_id") - F.col("conv_id") % SHARED_GROUP})

    # At most five turns of one conversation in a hundred.
    opening = rows.filter(F.col("conv_id") % SHARED_GROUP == 0).join(
        convs.select("conv_id", "first"), "conv_id"
    ).withColumn("at", F.col("place") - F.col("first")).filter(F.col("at") < SHARED_TURNS - 1)
    openings = opening.groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("at", "said", "chars"))).alias("opening")
    )
    shared = F.expr("if(opening is null or taken = 0, cast(array() as array<struct<at:bigint,said:binary,chars:bigint>>), slice(opening, 1, cast(taken as int)))")
    convs, _ = stored_at(
        convs.join(openings, "base", "left").select("conv_id", "first", "own", "taken", shared.alias("shared")), "trie-convs"
    )
    before = F.size("shared").cast("long")
    lengths = convs.select("conv_id", (before + F.greatest(F.col("own") - F.col("taken"), F.lit(0))).alias("length"))
    heads = convs.select("conv_id", F.explode("shared").alias("t")).select(
        "conv_id", (F.col("t.at") + 1).alias("depth"), "t.said", "t.chars"
    )
    keyed = [side.withColumn("_h", F.hash("conv_id")) for side in (rows, convs.select("conv_id", "first", "taken", before.alias("before")))]
    at = F.col("place") - F.col("first")
    tails = keyed[0].join(keyed[1], ["conv_id", "_h"]).filter(at >= F.col("taken")).select(
        "conv_id", (F.col("before") + at - F.col("taken") + 1).alias("depth"), "said", "chars"
    )
    return heads.unionByName(tails), lengths


def _digest(lanes: list[Column], depth: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[x.cast("string") for x in lanes])))


def prefixes(rows: DataFrame) -> DataFrame:
    """Each row's ``node`` and ``parent``.

    The four lanes are sums of 32-bit parts of a SHA-256 of depth and turn. They are summed within stretches of 2^16 depths,
    and only conversations longer than that need the sums of earlier stretches.
    """
    hashed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("said")), 256)
    parts = {f"_own{i}": F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("long") for i in range(LANES)}
    split = rows.withColumn("_hash", hashed).withColumns(parts).drop("_hash")
    split = split.withColumn("_stretch", F.floor((F.col("depth") - 1) / STRETCH))
    here = Window.partitionBy("conv_id", "_stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = split.withColumns({f"_sum{i}": F.sum(f"_own{i}").over(here) for i in range(LANES)})
    earlier = Window.partitionBy("conv_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0)
    starts = local.filter(F.col("depth") % STRETCH == 0).select(
        "conv_id", (F.col("_stretch") + 1).alias("_stretch"), *[F.sum(f"_sum{i}").over(earlier).alias(f"_from{i}") for i in range(LANES)]
    )
    whole = local.join(starts, ["conv_id", "_stretch"], "left")
    sums = [F.col(f"_sum{i}") + F.coalesce(F.col(f"_from{i}"), F.lit(0)) for i in range(LANES)]
    above = [s - F.col(f"_own{i}") for i, s in enumerate(sums)]
    return whole.select(
        "conv_id", "depth", "said", "chars",
        _digest(sums, F.col("depth")).alias("node"), _digest(above, F.col("depth") - 1).alias("parent"),
    )


def _root() -> Column:
    return _digest([F.lit(0)] * LANES, F.lit(0))


def node_table(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: members, smallest member, depth, parent, what it saves by itself.

    Equal digests must agree in parent and last turn, by which, from the root on, they are the same sequence.
    """
    differ = (F.min("said") != F.max("said")) | (F.min("parent") != F.max("parent")) | (F.min("depth") != F.max("depth"))
    counted = members.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"),
        F.min("parent").alias("parent"), F.min("chars").alias("chars"), differ.alias("_differ"),
    )
    checked = F.when(F.col("_differ"), F.raise_error(F.lit("two prefixes share a digest"))).otherwise(F.col("node"))
    below = counted.select(checked.alias("node"), "parent", "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    top = root.select(
        _root().alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs",
        F.lit(0).cast("long").alias("saved"),
    )
    return below.unionByName(top)


# --- node tables ----------------------------------------------------------------------------------


class SlotTable:
    """A minimal perfect hash of distinct 16-byte digests, with the digests beside their slots.

    Each level hashes the digests left over into twice as many places; those alone in their place get the next slots
    in the order of places, the others go on. A slot counts only if it holds the digest that was asked for.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = np.empty_like(keys)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, used = np.arange(len(keys)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("digests repeat")
            size = 2 * len(left) + 1
            at = self._place(keys[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            slots = np.cumsum(alone) - 1 + used
            self.levels.append((alone, slots))
            settled = alone[at]
            self.keys[slots[at[settled]]] = keys[left[settled]]
            used += int(alone.sum())
            left = left[~settled]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (keys[:, 0] ^ (keys[:, 1] * np.uint64(2 * level + 0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        return (mixed % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where it is none of the table's."""
        found = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (alone, slots) in enumerate(self.levels):
            at = self._place(keys[left], level, len(alone))
            here = alone[at]
            found[left[here]] = slots[at[here]]
            left = left[~here]
        known = found >= 0
        known[known] = (self.keys[found[known]] == keys[known]).all(axis=1)
        return np.where(known, found, -1)


def _keys(digests: pd.Series) -> np.ndarray:
    """Digests as pairs of 64-bit numbers; a missing one (the root's parent) is all zeros."""
    joined = b"".join(d if d is not None else bytes(16) for d in digests)
    return np.frombuffer(joined, dtype=np.uint64).reshape(-1, 2)


SUMS = ["n_children", "n_leaves", "saved_tokens"]
SHARD_COLUMNS = "node binary, parent binary, top boolean, conv_id long, depth long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def sum_shards(nodes: pd.DataFrame) -> pd.DataFrame:
    """Sums over the subtrees of whole shards. ``in_`` columns hold what later-class children passed on."""
    table = SlotTable(_keys(nodes["node"]))
    slot, parent = table.slots(_keys(nodes["node"])), table.slots(_keys(nodes["parent"]))
    # A parent of another class is another shard's, whether its shard lies in this batch or not.
    parent[nodes["top"].to_numpy()] = -1

    def scattered(name: str) -> np.ndarray:
        flat = np.zeros(len(nodes), dtype=np.int64)
        flat[slot] = nodes[name].to_numpy(dtype=np.int64)
        return flat

    depth, convs = scattered("depth"), scattered("conv_id")
    up = np.full(len(nodes), -1, dtype=np.int64)
    up[slot] = parent
    children, leaves, saved = scattered("in_children"), scattered("in_leaves"), scattered("saved") + scattered("in_saved")
    np.add.at(children, up[up >= 0], 1)
    leaves[children == 0] = 1
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[up[level] >= 0]
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    out = nodes[["node", "parent", "top", "conv_id", "depth", "n_convs"]].copy()
    mine = up[slot]
    out["parent_conv_id"] = pd.array(np.where(mine >= 0, convs[mine], 0), dtype="Int64")
    out.loc[mine < 0, "parent_conv_id"] = pd.NA
    for name, flat in zip(SUMS, (children, leaves, saved)):
        out[name] = flat[slot]
    return out


def _whole_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by shard, cut where a shard ends, with many small shards in one table."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < FLUSH_ROWS:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = rows["anchor"].iloc[-1]
        cut = int((rows["anchor"] == last).to_numpy().argmax())
        if cut:
            yield sum_shards(rows.iloc[:cut].reset_index(drop=True))
        held = [rows.iloc[cut:]]
    if held and sum(map(len, held)):
        yield sum_shards(pd.concat(held, ignore_index=True))


def with_anchors(nodes: DataFrame) -> DataFrame:
    """Add the class (``block``, ``level``) and ``anchor``, the highest ancestor within the class.

    Pointers to parents of the same class are doubled until they span the longest way within a class. A node is pointed at
    only from its own shard, so no pointer is shared by more rows than a shard holds.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    # Bounds beyond a long would be passed by no count.
    level = sum((F.col("n_convs") > WIDE**k).cast("int") for k in range(1, 8) if WIDE**k < 2**63)
    classed = nodes.withColumns({"block": F.floor(F.col("depth") / DEEP), "level": level})
    above = classed.select(F.col("node").alias("parent"), F.col("block").alias("_block"), F.col("level").alias("_level"))
    keyed = [side.withColumn("_h", F.hash("parent")) for side in (classed, above)]
    same = (F.col("block") == F.col("_block")) & (F.col("level") == F.col("_level"))
    linked = keyed[0].join(keyed[1], ["parent", "_h"], "left").select(
        *classed.columns, F.when(same, F.col("parent")).otherwise(F.col("node")).alias("anchor")
    )
    linked, path = stored_at(linked, "trie-anchors")
    for _ in range(math.ceil(math.log2(min(deepest, DEEP) + 1))):
        next_anchor = linked.select(F.col("node").alias("anchor"), F.col("anchor").alias("_next"))
        moved = linked.join(next_anchor, "anchor").select(*classed.columns, F.col("_next").alias("anchor"))
        moved, next_path = stored_at(moved, "trie-anchors")
        discard(nodes.sparkSession, path)
        linked, path = moved, next_path
    return linked


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """Each node with children, leaves and savings of its subtree, class by class, deepest and smallest first."""
    anchored = with_anchors(nodes).withColumn("top", F.col("anchor") == F.col("node"))
    classes = anchored.select("block", "level").distinct().collect() or [(0, 0)]
    done: list[DataFrame] = []
    passed: DataFrame | None = None
    for block, level in sorted(map(tuple, classes), key=lambda c: (-c[0], c[1])):
        here = anchored.filter((F.col("block") == block) & (F.col("level") == level))
        incoming = ["in_children", "in_leaves", "in_saved"]
        if passed is None:
            here = here.withColumns({c: F.lit(0).cast("long") for c in incoming})
        else:
            sums = passed.groupBy(F.col("parent").alias("node")).agg(
                F.count(F.lit(1)).alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved")
            )
            here = here.join(sums, "node", "left").na.fill(0, incoming)
        columns = ["anchor", "node", "parent", "top", "conv_id", "depth", "n_convs", "saved", *incoming]
        shards = here.select(*columns).repartition("anchor").sortWithinPartitions("anchor")
        summed = stored(shards.mapInPandas(_whole_shards, SHARD_COLUMNS), "trie-sums")
        done.append(summed)
        tops = summed.filter("top and parent is not null").select("parent", "n_leaves", "saved_tokens")
        passed = tops if passed is None else passed.unionByName(tops)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    # Inside a shard the parent is known from its slot; the top's parent lies in another class.
    inner = whole.filter("not top")
    tops = whole.filter("top").drop("parent_conv_id").withColumn("_h", F.hash("parent"))
    above = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")).withColumn("_h", F.hash("parent"))
    return inner.unionByName(tops.join(above, ["parent", "_h"], "left").drop("_h"))


# --- conversations that end at a node -------------------------------------------------------------


def ends(members: DataFrame, lengths: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of the ids of the conversations that end there, ascending.

    Ids are sorted by ranges of node and id and joined to chunks, so a node where very many end is sorted by many tasks; its
    one hash, which is sequential by nature, then reads a chunk at a time.
    """
    last = members.join(lengths, "conv_id").filter("depth = length").select("node", "conv_id")
    empty = lengths.filter("length = 0").select(_root().alias("node"), "conv_id")
    pairs = stored(last.unionByName(empty), "trie-ends")
    ranged = pairs.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    chunks = ranged.mapInPandas(_chunks, "node binary, first long, ids string")
    whole = chunks.repartition("node").sortWithinPartitions("node", "first")
    return whole.mapInPandas(_hashes, "node binary, ends_sha256 string")


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), CHUNK_IDS):
            part = batch.iloc[start : start + CHUNK_IDS]
            ids = part["conv_id"].astype(str).groupby(part["node"], sort=False).agg(",".join)
            first = part.groupby("node", sort=False)["conv_id"].min()
            yield pd.DataFrame({"node": ids.index, "first": first.to_numpy(), "ids": ids.to_numpy()})


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    node, state = None, None
    for batch in batches:
        found = []
        for key, ids in zip(batch["node"], batch["ids"]):
            if key != node:
                if state is not None:
                    found.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(found, columns=["node", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])


# --- the trie -------------------------------------------------------------------------------------


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with members, children, leaves and what sharing saves.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``, and ``node``, the prefix's digest in hex.

    Null or missing role or text count as empty, rows without a conversation id belong to none and are left out, turns are
    ordered null first, ties by the SHA-256 of role and text, repeated rows are turns of their own. An empty table has
    no nodes, not even a root. Other columns are not read, so their names cannot clash.
    """
    rows, lengths = rebuilt(conversations)
    lengths = stored(lengths, "trie-lengths")
    members = stored(prefixes(rows), "trie-members")
    nodes = stored(node_table(members, lengths), "trie-nodes")
    summed = subtree_sums(nodes)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    whole = summed.join(ends(members, lengths), "node", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *SUMS,
        F.coalesce(F.col("ends_sha256"), nothing).alias("ends_sha256"), F.lower(F.hex("node")).alias("node"),
    )
