"""Distinct users, products and categories of any period: exact from the facts, or estimated from stored sketches.

An exact distinct count cannot be put together from those of its parts, so every period asked for would scan the facts again.
A sketch (HyperLogLog) per hour and user type can: sketches of a period are merged, and an estimate is read off. Exact counts stay
the default everywhere; estimates are asked for by handing sketches over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.plans.strategy import CLOCK, with_user_type

COUNTED = {"user_id": "unique_registered_users", "product_id": "product_diversity", "category_id": "category_diversity"}
LG_BUCKETS = 12


def standard_error(lg_buckets: int = LG_BUCKETS) -> float:
    """Relative standard error of an estimate from merged sketches of 2^n buckets."""
    return 1.04 / 2 ** (lg_buckets / 2)


def hour_of_clock() -> Column:
    """The full hour of the normalized clock."""
    return F.timestamp_add("HOUR", F.hour(CLOCK), F.col(CLOCK).cast("date").cast("timestamp_ntz"))


def month_and_type() -> list[Column]:
    """Month and user type as a number and a flag: half as wide as year, month and name, and distinct rows carry them."""
    month = F.year(CLOCK) * 12 + F.month(CLOCK) - 1
    return [month.alias("_month"), (F.col("user_type") == S.REGISTERED).alias("_registered")]


def with_month_and_type(counts: DataFrame) -> DataFrame:
    """Counts by ``month_and_type`` with ``year``, ``month`` and ``user_type`` in its place."""
    parts = {"year": "cast(_month div 12 as int)", "month": "_month % 12 + 1"}
    user_type = F.when(F.col("_registered"), S.REGISTERED).otherwise(S.ANONYMOUS).alias("user_type")
    kept = [c for c in counts.columns if c not in ("_month", "_registered")]
    return counts.select(*[F.expr(e).alias(name) for name, e in parts.items()], user_type, *kept)


def hour_sketches(facts: DataFrame, lg_buckets: int = LG_BUCKETS) -> DataFrame:
    """One sketch per counted column for each hour and user type; missing values are not counted.

    A sketch takes at most 2^n bytes, however many rows it stands for, and rows are added to it before any shuffle.
    """
    # Sketches take numbers and texts, ids are wide decimals: their hashes are counted.
    hashes = {c: F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in COUNTED}
    sketches = [F.hll_sketch_agg(h, F.lit(lg_buckets)).alias(f"{c}_sketch") for c, h in hashes.items()]
    return with_user_type(facts).groupBy(hour_of_clock().alias(CLOCK), "user_type").agg(*sketches)


def merged_sketches(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """Sketches of coarser groups: of a month, of all user types, of appended batches."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(f"{c}_sketch").alias(f"{c}_sketch") for c in COUNTED])


def estimates(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """Estimated distinct counts per group of hours."""
    merged = merged_sketches(sketches, *by)
    kept = [c for c in merged.columns if not c.endswith("_sketch")]
    return merged.select(*kept, *[F.hll_sketch_estimate(f"{c}_sketch").alias(name) for c, name in COUNTED.items()])


def exact(facts: DataFrame, *by: str | Column) -> DataFrame:
    """The same counts, exact, by a scan of the facts.

    All ids go through one column, so a distinct row holds one id and not a place for each of them. Missing ids
    are one row of their group, which keeps groups without any id.
    """
    ids = {f"_{c}": i for i, c in enumerate(COUNTED)}
    rows = with_user_type(facts).select(*by, *[F.col(c).alias(f"_{c}") for c in COUNTED])
    groups = rows.columns[: len(by)]
    single = rows.unpivot(groups, list(ids), "_column", "_id")
    number = reduce(lambda other, c: F.when(F.col("_column") == c, F.lit(ids[c])).otherwise(other), list(ids)[1:], F.lit(0))
    seen = single.select(*groups, number.cast("byte").alias("_which"), "_id").distinct()
    counts = [F.count(F.when(F.col("_which") == i, F.col("_id"))).alias(n) for i, n in enumerate(COUNTED.values())]
    return seen.groupBy(*groups).agg(*counts)


def checked_estimates(facts: DataFrame, sketches: DataFrame, *by: Column, errors: float = 4.0) -> DataFrame:
    """Exact counts, and whether each estimate lies within so many standard errors (or one, for small counts)."""
    names = list(COUNTED.values())
    keys = [c for c in estimates(sketches, *by).columns if c not in names]
    near = estimates(sketches, *by).withColumnsRenamed({n: f"_{n}" for n in names})
    allowed = errors * standard_error()
    within = [
        (F.abs(F.col(f"_{n}") - F.col(n)) <= F.greatest(F.lit(1), allowed * F.col(n))).alias(f"{n}_within") for n in names
    ]
    return exact(facts, *by).join(near, keys).select(*keys, *names, *within)
