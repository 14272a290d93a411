"""Volume, revenue and priced rows per group, their totals, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.functions import ratios as R


MEASURES = ("vol", "rev", "priced")


def prefixed(*prefixes: str) -> tuple[str, ...]:
    return tuple(f"{prefix}{name}" for prefix in prefixes for name in MEASURES)


def revenue_sum() -> Column:
    """Exact sum of prices.

    Whole units and what remains of each price are added apart, as longs. One sum of
    decimal(8,2) ends at 10^16, which 10^12 rows pass at a mean of ten thousand; a wider decimal
    holds them but leaves the fast hash map and takes about twice the time. Units last to 9 * 10^18.
    """
    units = "cast(price as bigint)"
    rest = f"cast(price - cast({units} as decimal(8,2)) as decimal(8,2))"
    return F.expr(f"cast(cast(sum({units}) as decimal(20,0)) + sum({rest}) as {R.MONEY})")


def row_measures() -> list[Column]:
    """Aggregates of fact rows: ``vol``, ``rev`` and ``priced`` (rows that carry a price)."""
    return [F.count(F.lit(1)).alias("vol"), revenue_sum().alias("rev"), F.count("price").alias("priced")]


def merged_measures(user_type: str | None = None, prefix: str = "") -> list[Column]:
    """The same measures of groups that are already aggregated, optionally of one user type.

    Groups of another type count as zero revenue but add nothing to the priced rows.
    """
    merged = []
    for name in MEASURES:
        part = name if user_type is None else f"if(user_type = '{user_type}', {name}, 0)"
        kind = R.MONEY if name == "rev" else "bigint"
        merged.append(F.expr(f"cast(sum({part}) as {kind})").alias(f"{prefix}{name}"))
    return merged


def measures_of(df: DataFrame) -> list[Column]:
    """Measures of fact rows, or of a summary that already carries them."""
    return merged_measures() if set(MEASURES) <= set(df.columns) else row_measures()


TOTAL = "_total"


def with_total(df: DataFrame, groups: DataFrame, names: tuple[str, ...] = MEASURES) -> DataFrame:
    """Add the sums of ``names`` over all groups to every row, as the struct ``_total``.

    The sums are a scalar subquery: a window without keys would bring every group to one task.
    They are added up in parts, from the very exchange that the report itself reads.
    """
    sums = groups.agg(*[F.sum(name).alias(name) for name in names])
    return df.withColumn(TOTAL, sums.select(F.struct(*names)).scalar())


def total(name: str) -> Column:
    return F.col(TOTAL)[name]


def volume_share(prefix: str = "") -> Column:
    return R.percent_of(f"{prefix}vol", f"{TOTAL}.{prefix}vol")


def revenue_share(prefix: str = "") -> Column:
    """Share of the revenue; there is none where the total has no priced row."""
    share = R.money_percent_of(f"{prefix}rev", f"{TOTAL}.{prefix}rev")
    return F.when(total(f"{prefix}priced") > 0, share)


def revenue(name: str = "rev") -> Column:
    return F.col(name).cast(S.REVENUE_TYPE)


def order_value(prefix: str = "") -> Column:
    return R.order_value(f"{prefix}rev", f"{prefix}priced")
