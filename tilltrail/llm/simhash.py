"""SimHash near-duplicates found through deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that, of two fingerprints within the allowed
distance, one segment differs in at most one bit. Each segment is indexed under every variant that
has one bit wiped out, an equality join of the variants finds the candidates, and the full distance
is verified. For 3 bits that takes 2 segments and 64 keys per distinct fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilltrail.llm.components import components
from tilltrail.llm.store import free_name, row_key, stored, without_rows

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCK_BYTES = 1 << 20
RUN_ROWS = 20_000
LINK_BUFFER = 1 << 20


# --- fingerprints -------------------------------------------------------------------------------


def _word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a block at a time; a block ends at white space, so no word is cut."""
    at = 0
    while at < len(text):
        end = at + BLOCK_BYTES
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].lower().split()
        at = end


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set. Sums of 255 fit a byte, which keeps them fast."""
    rows = -(-len(hashes) // 255) * 255
    padded = np.zeros(rows, dtype="<u8")
    padded[: len(hashes)] = hashes
    bits = np.unpackbits(padded.view(np.uint8).reshape(rows, 8), axis=1, bitorder="little")
    return bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: each bit set if over half of the shingles' hashes have it set.

    Shingles count as often as they occur. A text of fewer words is one shingle; null, empty
    and blank texts have the fingerprint zero.
    """
    ones, total, carry, hash_of = np.zeros(64, dtype=np.int64), 0, [], xxhash.xxh64_intdigest
    for block in _word_blocks(text or b""):
        words = carry + block
        n = max(0, len(words) - shingle + 1)
        if n:
            parts = zip(*(words[i : i + n] for i in range(shingle)), strict=True)
            hashes = np.fromiter((hash_of(b" ".join(x), SEED) for x in parts), dtype="<u8", count=n)
            ones += _bit_counts(hashes)
            total += n
        carry = words[n:]
    if not total and carry:
        ones, total = _bit_counts(np.array([hash_of(b" ".join(carry), SEED)], dtype="<u8")), 1
    set_bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``row_key`` and ``fingerprint`` (a long) of every document."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = [fingerprint(x.as_py(), shingle) for x in texts]
            columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), F.col("text"))
    return rows.mapInArrow(of_batches, "doc_id long, row_key long, fingerprint long")


# --- links --------------------------------------------------------------------------------------


def segments_for(max_bits: int) -> int:
    """The fewest segments of which one differs in at most one bit."""
    return max_bits // 2 + 1


def _bounds(segments: int) -> list[tuple[int, int]]:
    cuts = [64 * i // segments for i in range(segments + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def variants(prints: DataFrame, max_bits: int) -> DataFrame:
    """``key`` and ``fingerprint``: one row per segment and wildcard bit.

    The key holds the segment with the bit wiped, and the number of the bit within the
    fingerprint, which tells segments apart. One segment (``max_bits`` of 0 or 1) fills the key by
    itself, so the bit goes into a column of its own.
    """
    wiped = [
        F.struct(
            F.lit(bit).cast("short").alias("bit"),
            F.shiftrightunsigned(F.shiftleft("fingerprint", 64 - high), 64 - high + low)
            .bitwiseAND(F.lit(~(1 << (bit - low)) if bit - low < 63 else (1 << 63) - 1))
            .alias("part"),
        )
        for low, high in _bounds(segments_for(max_bits))
        for bit in range(low, high)
    ]
    return prints.select(F.explode(F.array(*wiped)).alias("key"), "fingerprint").select("key.*", "fingerprint")


class _Forest:
    """Keeps of many links only those that first join two groups, in a bounded buffer."""

    def __init__(self) -> None:
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.rows = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.rows += len(a)
        if self.rows > LINK_BUFFER:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.a, self.b))
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent, kept = list(range(len(nodes))), []
        for i, (x, y) in enumerate(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True)):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[x] = y
                kept.append(i)
        self.a, self.b, self.rows = [a[kept]], [b[kept]], len(kept)
        return self.a[0], self.b[0]


def _verified(x: np.ndarray, bit: np.ndarray, first: np.ndarray, max_bits: int) -> np.ndarray:
    """Close enough, and differing at the wildcard; equal segments are left to their first wildcard."""
    differs = ((x >> bit.astype(np.int64)) & 1) == 1
    return (np.bitwise_count(x.view(np.uint64)) <= max_bits) & (differs | first)


def _link_runs(bit: np.ndarray, part: np.ndarray, prints: np.ndarray, max_bits: int, out: _Forest) -> None:
    """Links inside each run of equal keys, comparing every row with the 1st, 2nd, ... row after it."""
    firsts = np.isin(bit, [low for low, _ in _bounds(segments_for(max_bits))])
    left, lag = np.arange(len(prints)), 1
    while True:
        left = left[left + lag < len(prints)]
        left = left[(part[left] == part[left + lag]) & (bit[left] == bit[left + lag])]
        if not len(left):
            return
        x = prints[left] ^ prints[left + lag]
        near = _verified(x, bit[left], firsts[left], max_bits)
        if near.any():
            out.add(prints[left[near]], prints[left[near] + lag])
        lag += 1


LINKS = "late boolean, bit short, part long, a long, b long"


def _arrow(late: bool, bit: np.ndarray, part: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(a), late)), pa.array(bit, pa.int16()), pa.array(part, pa.int64())]
    columns += [pa.array(a, pa.int64()), pa.array(b, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["late", "bit", "part", "a", "b"])


def _link_sorted(max_bits: int, run_rows: int):
    """Over rows sorted by key: links of the runs, and the rows of runs too long for one task."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        held = [np.empty(0, np.int16), np.empty(0, np.int64), np.empty(0, np.int64)]
        put_off: tuple | None = None
        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if put_off:
                same = (rows[0] == put_off[0]) & (rows[1] == put_off[1])
                yield _arrow(True, rows[0][same], rows[1][same], rows[2][same], rows[2][same])
                rows = [x[~same] for x in rows]
                if not len(rows[0]):
                    held = rows
                    continue
                put_off = None
            bit, part, _ = rows
            ends = np.flatnonzero((bit[1:] != bit[:-1]) | (part[1:] != part[:-1])) + 1
            cut = int(ends[-1]) if len(ends) else 0
            starts = np.concatenate([[0], ends]).astype(np.int64)
            sizes = np.diff(np.concatenate([starts, [len(bit)]]))
            long = np.repeat(sizes > run_rows, sizes)
            if long.any():
                yield _arrow(True, bit[long], part[long], rows[2][long], rows[2][long])
                if long[-1]:
                    put_off = (bit[-1], part[-1])
                    cut = len(bit)
            done = [x[:cut][~long[:cut]] for x in rows]
            _link_runs(*done, max_bits, forest)
            held = [x[cut:] for x in rows]
        _link_runs(*held, max_bits, forest)
        a, b = forest.reduce()
        yield _arrow(False, np.zeros(len(a), np.int16), np.zeros(len(a), np.int64), a, b)

    return of_batches


def _link_block_pair(max_bits: int):
    def of_group(table: pa.Table) -> pa.Table:
        bit, part, prints, block = (table.column(c).to_numpy() for c in ("bit", "part", "fingerprint", "block"))
        forest, blocks = _Forest(), np.unique(block)
        lows = [low for low, _ in _bounds(segments_for(max_bits))]
        left, right = prints[block == blocks[0]], prints[block == blocks[-1]]
        for i, one in enumerate(left):
            others = left[i + 1 :] if len(blocks) == 1 else right
            x = others ^ one
            near = _verified(x, np.full(len(x), bit[0]), np.full(len(x), bit[0] in lows), max_bits)
            if near.any():
                forest.add(np.full(int(near.sum()), one), others[near])
        a, b = forest.reduce()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return of_group


def links(prints: DataFrame, max_bits: int = MAX_BITS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Pairs ``a``, ``b`` that connect whatever distinct fingerprints lie within ``max_bits``.

    Of the links inside one group of equal keys a spanning forest is returned: it has the same
    components as all pairs and is never longer than the group. Groups over ``run_rows`` are cut
    into blocks, and each pair of blocks is a task of its own, so no link is lost and no task grows.
    """
    # Few bytes become 64 times as many rows: spread over all cores first, whatever the bytes ask for.
    tasks = 4 * prints.sparkSession.sparkContext.defaultParallelism
    keyed = variants(prints.select("fingerprint").distinct().repartition(tasks, "fingerprint"), max_bits)
    ordered = keyed.repartition("bit", "part").sortWithinPartitions("bit", "part")
    found = stored(ordered.mapInArrow(_link_sorted(max_bits, run_rows), LINKS), "simhash-links")
    direct, late = found.filter("not late").select("a", "b"), found.filter("late")
    if late.isEmpty():
        return direct
    sizes = late.groupBy("bit", "part").agg(F.ceil(F.count(F.lit(1)) / run_rows).cast("int").alias("blocks"))
    placed = late.select("bit", "part", F.col("a").alias("fingerprint")).join(sizes, ["bit", "part"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = placed.select("*", other).select(
        "bit", "part", "fingerprint", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    blocks = paired.groupBy("bit", "part", "i", "j").applyInArrow(_link_block_pair(max_bits), "a long, b long")
    return direct.unionByName(blocks)


# --- documents ----------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, run_rows: int = RUN_ROWS
) -> DataFrame:
    """``doc_id``, ``row_key``, ``fingerprint``, ``component_id`` and ``kept``, a row per document.

    Fingerprints within ``max_bits`` are linked; ``component_id`` is the smallest doc_id that can be
    reached over links. ``kept`` marks the row with that id, of several such rows the one with
    the least row key. Documents without an id take part and count as having the largest id: a
    component of nothing else has a null id and still keeps one row. Only ``doc_id`` and ``text`` are read, so other
    names cannot clash.
    """
    rows = stored(fingerprints(docs, shingle), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    prints = rows.groupBy("fingerprint").agg(F.min(order).alias("first"))
    roots = components(links(prints, max_bits, run_rows))
    placed = prints.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    firsts = placed.groupBy("root").agg(F.min("first").alias("first"))
    spread = F.hash("root")
    named = placed.drop("first").withColumn("_h", spread).join(firsts.withColumn("_h", spread), ["root", "_h"])
    named = named.select("fingerprint", "first", F.hash("fingerprint").alias("_h"))
    joined = rows.withColumn("_h", F.hash("fingerprint")).join(named, ["fingerprint", "_h"])
    is_first = (F.col("row_key") == F.col("first.row_key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    return joined.select(
        "doc_id", "row_key", "fingerprint", F.col("first.doc_id").alias("component_id"), is_first.alias("kept")
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents, with all their columns, that stand for their components.

    Where the chosen row is repeated (same id and text), one of the repeats stays. Columns of any name come through.
    """
    found = near_duplicates(docs, shingle, max_bits).filter("kept").select("doc_id", "row_key")
    found = stored(found, "simhash-kept")
    key = free_name(docs, "_row_key")
    kept = without_rows(docs, found, "left_semi", key)
    repeated = found.groupBy("doc_id", "row_key").count().filter("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([key, "doc_id"])
    return kept.drop(key)
