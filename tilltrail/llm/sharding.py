"""A uniform shuffle into shards of exact sizes, in DataFrame functions throughout.

How many rows each source part sends to each shard is drawn first: the matrix of a uniformly random
permutation, whose rows and columns have known sums, is multivariate hypergeometric. Each part
permutes its rows and deals them out by its row of the matrix, rows go to their shards, and each
shard permutes what it got.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilltrail.llm.store import stored

SHARDS = 24
PARTS = 256
SLICES = 64
REACH = 12
BLOCK_BITS = 20
LAW = "rows"


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Rows per shard: at most one apart, the first ones larger."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def communication_matrix(parts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows that each part sends to each shard, drawn part by part from what the shards still lack."""
    draw = np.random.default_rng(seed)
    lacking = np.array(sizes, dtype=np.int64)
    matrix = []
    for rows in parts:
        row = _hypergeometric(draw, lacking, rows)
        lacking -= row
        matrix.append(row.tolist())
    return matrix


def _hypergeometric(draw: np.random.Generator, lacking: np.ndarray, rows: int) -> np.ndarray:
    """One multivariate hypergeometric draw, shard by shard: each takes of what is left."""
    out, left, rest = np.zeros_like(lacking), rows, int(lacking.sum())
    for i, size in enumerate(lacking.tolist()):
        out[i] = taken = taken_of(draw, size, rest - size, left)
        left, rest = left - taken, rest - size
    return out


def taken_of(draw: np.random.Generator, good: int, bad: int, rows: int) -> int:
    """How many of ``rows`` taken out of ``good + bad`` are good: one draw by inversion, at any size.

    Probabilities side by side have a simple quotient, so their logarithms are sums outwards from one end and need no
    factorials. Summed are those within ``REACH`` deviations of the mode; all others together are below 10^-30, less than
    a double can add to one. That takes some twenty deviations in memory: 300,000 numbers where 10^12 rows go to 24 shards.
    """
    low, high = max(0, rows - bad), min(good, rows)
    if low == high:
        return low
    whole = good + bad
    mode = (rows + 1) * (good + 1) // (whole + 2)
    deviation = math.sqrt(rows * (good / whole) * (bad / whole) * ((whole - rows) / max(1, whole - 1)))
    reach = math.ceil(REACH * deviation) + 64
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.int64)
    quotients = np.log((good - k) / (k + 1)) + np.log((rows - k) / (bad - rows + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(quotients)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(upto[:-1], draw.random() * upto[-1], side="right"))


def _numbered(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Rows numbered from 0 within ``keys`` in the order of a hash.

    The hash is cut into slices that are numbered by themselves; what precedes a slice comes from
    counts. So a shard of any size is shared by ``SLICES`` tasks.
    """
    cut = rows.withColumn("_slice", F.shiftrightunsigned(order, 64 - SLICES.bit_length() + 1))
    counts = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_slice").orderBy(order)
    numbered = cut.withColumn(name, F.row_number().over(within) - 1)
    joined = numbered.join(starts, [*keys, "_slice"])
    return joined.withColumn(name, F.col(name) + F.col("_base")).drop("_slice", "_base")


def _copies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``_row``, a struct of the columns, and ``_copy``: repeated rows numbered from 0.

    Repeats are counted, which combines before the shuffle, and made anew from the count, so a row that makes up a third of all
    is no hot key. Counts above 2^20 are cut into blocks that are dealt out before they are expanded.
    """
    counted = rows.select(F.struct(*columns).alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    blocks = counted.withColumn("_last", F.shiftright(F.col("_n") - 1, BLOCK_BITS))
    few = blocks.filter("_last = 0").withColumn("_block", F.lit(0).cast("long"))
    many = blocks.filter("_last > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    first = F.shiftleft("_block", BLOCK_BITS)
    last = F.least(first + (1 << BLOCK_BITS), F.col("_n")) - 1
    return few.unionByName(many.repartition("_row", "_block")).select("_row", F.explode(F.sequence(first, last)).alias("_copy"))


def shuffle_into_shards(
    rows: DataFrame, columns: list[str], shards: int = SHARDS, parts: int = PARTS, seed: int = 42
) -> DataFrame:
    """The given columns of all rows with ``shard`` (from 0) and ``slot`` (from 0, without gaps).

    Sizes of shards differ by at most one. A row's source part and the orders of both permutations are
    hashes of the columns and of its number among equal rows, so the result does not depend on how the input is
    split, a lost task repeats what it did, and equal rows lie apart. No rows give no shards. Columns that are not
    given are not read and may have any name; given ones called ``shard`` or ``slot`` are refused.

    The driver holds one count per part and the matrix, ``parts`` times ``shards`` numbers.
    """
    if clash := {c for c in columns if c.lower() in ("shard", "slot")}:
        raise ValueError(f"the result has columns of its own called {sorted(clash)}")
    hashed = _copies(rows, columns).withColumn("_h", F.xxhash64(F.lit(seed), "_row", "_copy")).drop("_copy")
    dealt = stored(hashed.withColumn("_part", F.pmod("_h", F.lit(parts)).cast("int")), "shuffle-rows")
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    present = sorted(counts)
    sizes = shard_sizes(sum(counts.values()), shards)
    matrix = communication_matrix([counts[p] for p in present], sizes, seed)
    ends = {str(p): np.cumsum(row).tolist() for p, row in zip(present, matrix, strict=True)}
    limits = F.from_json(F.lit(json.dumps(ends)), "map<string, array<bigint>>")
    table = rows.sparkSession.range(1).select(F.explode(limits).alias("_part", "_ends"))
    table = table.select(F.col("_part").cast("int").alias("_part"), "_ends")
    first = _numbered(dealt.withColumn("_order", F.xxhash64(F.lit(seed + 1), "_h")), ["_part"], "_order", "_place")
    sent = first.join(F.broadcast(table), "_part")
    shard = F.size(F.filter("_ends", lambda end: end <= F.col("_place"))).alias("shard")
    arrived = sent.select("_row", shard, F.xxhash64(F.lit(seed + 2), "_h", "_place").alias("_order"))
    return _numbered(arrived, ["shard"], "_order", "slot").select("_row.*", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of every document.

    The size is the text's UTF-8 bytes plus 8; null counts as no bytes and as the checksum 0. The
    law is ``rows``: counts of the shards are at most one apart. Under that law a further shard would
    deal everything anew, so ``grown_shard`` is null. Other columns of the documents are not read, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    done = shuffle_into_shards(thin, ["doc_id", "size", "text_crc32"], shards, seed=seed)
    return done.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
