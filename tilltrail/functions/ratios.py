"""Exact two-decimal ratios.

Spark's decimal division rounds once to the scale of its result type and a following
``round`` rounds again, so a value just below a tie can end above it. Here the quotient is
taken in whole hundredths with ``div``, which rounds once, half away from zero, at any size.

Arguments are column names or SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,2)"
COUNT = "decimal(20,0)"
RATIO = "decimal(18,2)"


def exact_ratio(numerator: str, denominator: str, times: int = 1) -> Column:
    """``round(times * numerator / denominator, 2)``; NULL for a zero denominator.

    Ties go away from zero, so signs are set aside first: refunds may make sums negative.
    """
    size = f"abs({denominator})"
    hundredths = f"(abs({numerator}) * {200 * times} + {size}) div nullif({size} * 2, 0)"
    sign = f"if((({numerator}) < 0) = (({denominator}) < 0), 1, -1)"
    return F.expr(f"cast(cast({hundredths} as {COUNT}) * 0.01 * {sign} as {RATIO})")


def _as(kind: str, expression: str) -> str:
    return f"cast({expression} as {kind})"


def percent_of(part: str, whole: str) -> Column:
    """Share of a count in percent."""
    return exact_ratio(_as(COUNT, part), _as(COUNT, whole), times=100)


def money_percent_of(part: str, whole: str) -> Column:
    """Share of a revenue in percent."""
    return exact_ratio(_as(MONEY, part), _as(MONEY, whole), times=100)


def order_value(revenue: str, priced_rows: str) -> Column:
    """Average order value: revenue over the rows that carry a price."""
    return exact_ratio(_as(MONEY, revenue), _as(COUNT, priced_rows))


def efficiency_index(revenue: str, total_revenue: str, volume: str, total_volume: str) -> Column:
    """Revenue share over volume share, as one fraction so that it is rounded once."""
    return exact_ratio(
        f"{_as(MONEY, revenue)} * {_as(COUNT, total_volume)}",
        f"{_as(MONEY, total_revenue)} * {_as(COUNT, volume)}",
    )
