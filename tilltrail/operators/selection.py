"""Exact medians of any number of values, by selection instead of sorting.

A median taken by sorting a group brings the group to one task. Here values are cut into four digits of 16 bits. Rows
are counted by their first digit, which combines before the shuffle, and the digit that holds the middle is known from the
counts; the next pass counts the next digit of the rows that share it. Four scans give the value, ties and all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT_BITS = 16
DIGITS = 64 // DIGIT_BITS
SIGN = -(1 << 63)


def _digit(at: int) -> Column:
    """The digit, from the first one, of a long whose sign bit is turned over, so that digits sort as values do."""
    return F.shiftrightunsigned(F.col("_bits"), 64 - DIGIT_BITS * (at + 1)).bitwiseAND((1 << DIGIT_BITS) - 1)


def middle_sums(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by``, ``n`` and ``twice_median`` of each group's values: the sum of the two middle ones, which is exact.

    ``value`` is a long below 2^61 in size; rows without one take no part, and groups without any have no row. ``by`` names a few
    fixed groups, not a key that grows with the data: two rows of each are broadcast. ``rows`` is scanned five times.
    """
    valued = rows.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("long").bitwiseXOR(F.lit(SIGN)).alias("_bits"))
    ranks = F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))
    targets = (
        valued.groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(by, "n", F.posexplode(ranks).alias("_which", "_rank"))
        .withColumn("_prefix", F.lit(0).cast("long"))
    )
    for at in range(DIGITS):
        # What is above the digit; a shift by 64 bits would be none at all.
        above = F.shiftrightunsigned(F.col("_bits"), 64 - DIGIT_BITS * at) if at else F.lit(0).cast("long")
        found = valued.withColumn("_prefix", above).join(F.broadcast(targets), [by, "_prefix"])
        counts = found.groupBy(by, "n", "_which", "_rank", "_prefix", _digit(at).alias("_digit")).agg(F.count(F.lit(1)).alias("_rows"))
        upto = Window.partitionBy(by, "_which").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        through = counts.withColumn("_upto", F.sum("_rows").over(upto))
        holds = (F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_rows") <= F.col("_rank"))
        targets = through.filter(holds).select(
            by,
            "n",
            "_which",
            (F.col("_rank") - F.col("_upto") + F.col("_rows")).alias("_rank"),
            F.shiftleft("_prefix", DIGIT_BITS).bitwiseOR(F.col("_digit")).alias("_prefix"),
        )
    middle = F.col("_prefix").bitwiseXOR(F.lit(SIGN))
    return targets.groupBy(by).agg(F.max("n").alias("n"), F.sum(middle).alias("twice_median"))
