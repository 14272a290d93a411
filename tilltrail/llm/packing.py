"""Variable-capacity best-fit packing of documents into sequences.

Lengths are whole numbers up to the largest permitted sequence, so the packing is planned on their
histogram, which has that many entries however large the corpus is: best fit by falling length,
on all equal bins at once. A document then finds its bin by its rank among those of its length.
Ranks are counted by bucket and added up, so a common length is shared by many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilltrail.llm.store import stored

CAPACITIES = (512, 1024, 2048, 4096)
SEQUENCE_COST = 16
BUCKETS = 256


@dataclass
class _Bins:
    """Equal bins, numbered from ``first``. ``items``: length, rank in the first bin, offset."""

    first: int
    count: int
    used: int
    capacity: int
    items: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, count: int) -> _Bins:
        """Keep the first ``count`` bins and return the others."""
        moved = [(length, rank + count, at) for length, rank, at in self.items]
        rest = _Bins(self.first + count, self.count - count, self.used, self.capacity, moved)
        self.count = count
        return rest


def _opening(length: int, count: int, smaller: np.ndarray, capacities: tuple[int, ...], cost: int) -> int:
    """The bin size that costs least per token it is likely to hold.

    A bin takes as many of the ``count`` equal items as fit. The rest of its room can be filled by what
    is left of shorter items that fit there, shared among as many bins as these items need.
    """
    best = None
    for capacity in capacities:
        if capacity < length:
            continue
        each = min(capacity // length, count)
        bins = -(-count // each)
        room = capacity - each * length
        filler = smaller[min(room, length - 1)] / bins
        price = (capacity + cost) / (each * length + min(room, filler))
        if best is None or price < best[0]:
            best = (price, capacity)
    return best[1]


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: int = SEQUENCE_COST) -> list[_Bins]:
    """Best fit by falling length: an item goes into the fullest bin it fits into, else opens one.

    At the end each bin shrinks to the smallest permitted capacity that holds its contents.
    """
    capacities = tuple(sorted(capacities))
    weights = np.zeros(capacities[-1] + 1)
    for length, count in histogram.items():
        weights[length] = length * count
    smaller = np.cumsum(weights)
    rooms: list[int] = []
    by_room: dict[int, list[_Bins]] = {}
    bins_made = 0

    def keep(bins: _Bins) -> None:
        room = bins.capacity - bins.used
        if room not in by_room:
            insort(rooms, room)
            by_room[room] = []
        by_room[room].append(bins)

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while rank < count:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
                if bins.count > count - rank:
                    keep(bins.split(count - rank))
                bins.items.append((length, rank, bins.used))
                bins.used += length
                rank += bins.count
                keep(bins)
                continue
            capacity = _opening(length, count - rank, smaller, capacities, cost)
            each = min(capacity // length, count - rank)
            number = (count - rank) // each
            items = [(length, rank + i * number, i * length) for i in range(each)]
            keep(_Bins(bins_made, number, each * length, capacity, items))
            bins_made += number
            rank += number * each
    done = [bins for group in by_room.values() for bins in group]
    for bins in done:
        bins.capacity = capacities[bisect_left(capacities, bins.used)]
    return done


@dataclass(frozen=True)
class _Places:
    """The plan as arrays, sorted by length and rank: where a rank's bin, offset and capacity start."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    capacity: np.ndarray

    @staticmethod
    def of(bins: list[_Bins]) -> _Places:
        rows = sorted((n, rank, b.first, at, b.capacity) for b in bins for n, rank, at in b.items)
        columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        return _Places(*columns)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks of a length lie side by side, so the place is the last one that starts at or below."""
        low = np.searchsorted(self.length, length, side="left")
        high = np.searchsorted(self.length, length, side="right")
        while (open_ := high - low > 1).any():
            middle = (low + high) // 2
            below = self.rank[np.minimum(middle, len(self.rank) - 1)] <= rank
            low, high = np.where(open_ & below, middle, low), np.where(open_ & ~below, middle, high)
        return self.bin[low] + rank - self.rank[low], self.offset[low], self.capacity[low]


def token_count():
    """Words of a text and one token that ends the document; null counts as empty."""
    return (F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)) + 1).cast("long")


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """``doc_id``, ``piece``, ``start`` and ``length``: documents cut where they exceed the largest sequence."""
    sized = docs.select("doc_id", token_count().alias("n"))
    last = F.floor((F.col("n") - 1) / largest).cast("int")
    cut = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return cut.select(
        "doc_id", "piece", start.alias("start"), F.least(F.lit(largest), F.col("n") - start).cast("int").alias("length")
    )


def _ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """Each piece with its rank, from 0, among the pieces of its length.

    Pieces are dealt to buckets by a hash of their identity and ranked within bucket and length.
    What precedes a bucket comes from a count per bucket and length.
    """
    order = ["doc_id", "piece"]
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("bucket", "length").orderBy(*order)
    placed = dealt.withColumn("rank", F.row_number().over(within) - 1)
    return placed.join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket")


def pack(
    docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: int = SEQUENCE_COST, buckets: int = BUCKETS
) -> DataFrame:
    """``bin_id``, ``capacity``, ``bin_offset``, ``doc_id``, ``piece``, ``start``, ``length``: one row per piece.

    ``start`` is where a piece begins within its document, ``bin_offset`` where it goes within its
    bin. Every document is packed whole: null and empty texts take the one token that ends them,
    longer ones than the largest capacity are cut. Pieces that agree in id and number (repeated
    rows) are places of their own. No documents give no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, max(capacities)), "packing-pieces")
    # At most as many rows as the largest capacity.
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_Places.of(plan(histogram, capacities, cost)))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_id, offset, capacity = shared.value.find(
                batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy().astype(np.int64)
            )
            found = [pa.array(bin_id, pa.int64()), pa.array(capacity, pa.int32()), pa.array(offset, pa.int32())]
            names = ["doc_id", "piece", "start", "length"]
            columns = [*found, *(batch.column(c) for c in names)]
            yield pa.RecordBatch.from_arrays(columns, ["bin_id", "capacity", "bin_offset", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"bin_id long, capacity int, bin_offset int, doc_id {kind}, piece int, start long, length int"
    return _ranked(rows, buckets).mapInArrow(of_batches, schema)
