"""Derived columns: user type, calendar, gap labels, time windows, strategic roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilltrail import schema as S

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def user_type(user_id: str = "user_id") -> Column:
    return F.when(F.col(user_id).isNull(), S.ANONYMOUS).otherwise(S.REGISTERED)


def wall_clock(instant: str, offset_hours: int) -> Column:
    """A zone-less clock reading of an instant, whatever the session zone is."""
    reading = F.timestamp_add("MICROSECOND", F.unix_micros(F.col(instant)), F.expr(EPOCH))
    return F.timestamp_add("HOUR", F.lit(offset_hours), reading)


def hours_before(clock: str, hours: int) -> Column:
    return F.timestamp_add("HOUR", F.lit(-hours), F.col(clock))


def weekday_name(number: Column, padded: bool = False) -> Column:
    """Name of a weekday counted from Monday = 0, blank-padded on request."""
    names = [name.ljust(S.WEEKDAY_WIDTH) if padded else name for name in S.WEEKDAYS]
    return F.element_at(F.array(*[F.lit(name) for name in names]), number + 1)


def calendar(clock: str, padded: bool = False) -> dict[str, Column]:
    at = F.col(clock)
    return {
        "year": F.year(at),
        "month": F.month(at),
        "day": F.dayofmonth(at),
        "weekday": weekday_name(F.weekday(at), padded),
        "hour": F.hour(at),
    }


def within_year(clock: str, year: int) -> Column:
    """A range on the stored clock, which reaches the Parquet scan; ``year(...) = n`` would not."""
    start, end = (F.expr(f"timestamp_ntz'{y:04d}-01-01 00:00:00'") for y in (year, year + 1))
    return (F.col(clock) >= start) & (F.col(clock) < end)


def time_window(hour: Column) -> Column:
    label = F.lit(S.NIGHT_WINDOW)
    for first, last, name in S.TIME_WINDOWS:
        label = F.when(hour.between(first, last), name).otherwise(label)
    return label


def strategic_role(more_revenue: Column, less_revenue: Column, higher: Column, lower: Column) -> Column:
    """Role from two comparisons: revenue share with volume share, order value with overall."""
    return (
        F.when(more_revenue & higher, S.ROLE_STAR)
        .when(less_revenue & lower, S.ROLE_COW)
        .when(more_revenue & lower, S.ROLE_PLAY)
        .otherwise(S.ROLE_TAIL)
    )
