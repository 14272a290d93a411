"""Keys that hold a large share of some weight, found with counters of fixed number and then counted exactly.

Grouping by a key with very many values shuffles each of them to learn that nearly all are small. Here every row
adds to one counter in each of a few tables, chosen by hashes of its key. The tables have the same size whatever the data, and tasks'
tables are added up. A key cannot weigh more than any of its counters, so keys with a small counter are out, and the few
left over are counted exactly in a second scan. No key above the threshold is lost; none below it is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = 1 << 14
TABLES = 3


def heavy_keys(
    rows: DataFrame, key: str, weight: Column, measures: list[Column], percent: str, counters: int = COUNTERS
) -> DataFrame:
    """Keys whose weight is at least ``percent`` of all rows' weight: the key, ``weight`` and ``measures`` over its rows.

    ``percent`` is a number as text, so that it is exact. Negative weights lower a key's own weight and the total, but no
    counter. Rows without a key count in the total and form no key. Without rows, or if the total is not positive, there are none.
    """
    weighed = rows.withColumn("_weight", F.coalesce(weight, F.lit(0)))
    total = weighed.agg(F.sum("_weight").alias("t"))
    keyed = weighed.filter(F.col(key).isNotNull())
    slots = [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(counters)).cast("int") for i in range(TABLES)]
    added = keyed.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("table"), s.alias("slot")) for i, s in enumerate(slots)])).alias("c"),
        F.greatest("_weight", F.lit(0)).alias("_weight"),
    )
    limit = total.select((F.col("t") * F.lit(percent).cast("decimal(10,6)")).alias("t")).scalar()
    large = added.groupBy("c.table", "c.slot").agg(F.sum("_weight").alias("w")).filter((F.col("w") * 100 >= limit) & (limit > 0))
    kept = keyed
    for i, slot in enumerate(slots):
        # At most as many rows as a table has counters.
        table = large.filter(F.col("table") == i).select(F.col("slot").alias("_slot"))
        kept = kept.withColumn("_at", slot).join(F.broadcast(table), F.col("_at") == F.col("_slot"), "left_semi").drop("_at")
    counted = kept.groupBy(key).agg(F.sum("_weight").alias("weight"), *measures)
    return counted.filter(F.col("weight") * 100 >= limit)
