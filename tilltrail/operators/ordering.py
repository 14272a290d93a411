"""Positions and running sums in an order over all rows, with no task that sees more than its range.

A window without keys would bring every row to one task, and a window by key would bring a hot key there.
Here rows are cut into ranges of the order, each range works for itself, and what lies before a range is
added afterwards. What is added has one row per range or block, not per group or key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilltrail.session import stored

RANGE_BITS = 33
BLOCK_BITS = 16


def placed(df: DataFrame, order: list[str | Column], name: str = "place", label: str = "placed") -> DataFrame:
    """Add ``name``: each row's position in the order, dense from 0.

    Rows that agree in the whole order are numbered in any order; a running number of the input rows as
    the last sort key lets them be cut apart as well, so repeated rows make no hot range. The ranges are stored, since
    another evaluation may draw their bounds anew. Reading them back, a position is the number of rows in
    earlier ranges plus the place within the own one, which takes no second shuffle.
    """
    arrival, local = "_arrival", "_local"
    numbered = df.withColumn(arrival, F.monotonically_increasing_id())
    ranges = numbered.repartitionByRange(*order, arrival).sortWithinPartitions(*order, arrival)
    ranges, _ = stored(ranges.drop(arrival).withColumn(local, F.monotonically_increasing_id()), label)
    which = F.shiftright(F.col(local), RANGE_BITS)
    sizes = ranges.groupBy(which.alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    starts = _before(sizes, ["_range"], {"_start": "_rows"}).select("_range", "_start")
    within = F.col(local).bitwiseAND((1 << RANGE_BITS) - 1)
    # One row per range: as few as the shuffle has partitions.
    joined = ranges.withColumn("_range", which).join(F.broadcast(starts), "_range")
    return joined.withColumn(name, F.col("_start") + within).drop("_range", "_start", local)


def running(df: DataFrame, place: str, sums: dict[str, str]) -> DataFrame:
    """Add running sums over all rows in the order of a dense position, each up to and with its row.

    ``sums`` names the new column and the one to add up. Blocks of 2^16 positions are all equally large; the
    sums before a block come from block totals, added up in two steps so that no window there is longer either.
    """
    block = "_block"
    blocked = df.withColumn(block, F.shiftright(F.col(place), BLOCK_BITS))
    totals = blocked.groupBy(block).agg(*[F.sum(c).alias(f"_all_{new}") for new, c in sums.items()])
    high = totals.withColumn("_high", F.shiftright(F.col(block), BLOCK_BITS))
    tops = high.groupBy("_high").agg(*[F.sum(f"_all_{new}").alias(f"_top_{new}") for new in sums])
    tops = _before(tops, ["_high"], {f"_base_{new}": f"_top_{new}" for new in sums})
    low = _before(high, [block], {f"_part_{new}": f"_all_{new}" for new in sums}, within="_high")
    starts = low.join(tops, "_high").select(
        block, *[(F.col(f"_part_{new}") + F.col(f"_base_{new}")).alias(f"_start_{new}") for new in sums]
    )
    here = Window.partitionBy(block).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({new: F.sum(c).over(here) for new, c in sums.items()})
    added = {new: F.col(f"_start_{new}") + F.col(new) for new in sums}
    return local.join(starts, block).withColumns(added).drop(block, *[f"_start_{new}" for new in sums])


def _before(df: DataFrame, order: list[str], sums: dict[str, str], within: str | None = None) -> DataFrame:
    """Sums over the rows before each one, 0 at the first."""
    window = Window.partitionBy(within) if within else Window.partitionBy()
    earlier = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({new: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for new, c in sums.items()})
