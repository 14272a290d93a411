"""From raw purchase records to a clean table: ids, clock, user type, calendar, dropped rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilltrail import schema as S
from tilltrail.functions import columns as C
from tilltrail.operators.ordering import placed

# The stored table is cut by year and month of the normalized clock, under names of their own.
CLEAN_CLOCK = "normalized_event_time"
CLEAN_YEAR, CLEAN_MONTH = "clean_year", "clean_month"


def drop_serial(df: DataFrame) -> DataFrame:
    return df.drop("serial_number")


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Baseline cleaning: rows without a category or a brand go."""
    return df.dropna(how="any", subset=["category_code", "brand"])


def normalize_event_time(
    df: DataFrame, hours: int = S.CLOCK_OFFSET_HOURS, display_hours: int = S.CLOCK_OFFSET_HOURS
) -> DataFrame:
    """Add ``normalized_event_time``: the clock reading, ``hours`` earlier.

    Raw records hold instants. They are first read on the clock of the place that recorded them,
    ``display_hours`` ahead of UTC. Frames that already carry a zone-less clock keep it.
    """
    if isinstance(df.schema["event_time"].dataType, T.TimestampType):
        df = df.withColumn("event_time", C.wall_clock("event_time", display_hours))
    return df.withColumn("normalized_event_time", C.hours_before("event_time", hours))


def add_arrival_id(df: DataFrame, after: int = 0) -> DataFrame:
    """Unique ids above ``after`` in order of arrival, without a shuffle.

    They depend on how the input is split into tasks, so they belong where a table is written:
    once stored they stay. Do not put two branches of one query on top of them.
    """
    return df.withColumn("id", F.monotonically_increasing_id() + 1 + after)


def add_surrogate_id(
    df: DataFrame, order_by: str = "serial_number", spread_by: list[str] | None = None
) -> DataFrame:
    """Dense ids 1..n in the order of a number; rows without it come last.

    Rows are numbered in ranges of (number, hash of ``spread_by`` or of all columns), so neither a number that
    very many rows repeat nor the rows without one are one task's work. Ids are the same in every run, except among rows
    that agree in number and hash. The numbered rows are stored once in the shared folder (see ``ordering.placed``).
    """
    spread = F.xxhash64(*(spread_by or df.columns))
    numbered = placed(
        df.drop("id").withColumn("_spread", spread), [F.col(order_by).asc_nulls_last(), "_spread"], "_place", "numbered"
    )
    return numbered.withColumn("id", F.col("_place") + 1).drop("_place", "_spread")


def add_user_type(df: DataFrame) -> DataFrame:
    return df.withColumn("user_type", C.user_type())


def add_calendar(df: DataFrame, clock: str, padded: bool = False) -> DataFrame:
    """Year, month, day, weekday and hour of the given clock."""
    return df.withColumns(C.calendar(clock, padded))


def clean_purchases(raw: DataFrame, hours: int = S.CLOCK_OFFSET_HOURS, with_id: bool = False) -> DataFrame:
    """The clean table: clock fixed, the export's row number gone, an id if asked for.

    Columns that the raw frame lacks are left out.
    """
    # The keys of a purchased item spread rows without a number; more columns would have to be read.
    keys = [c for c in ("order_id", "product_id") if c in raw.columns]
    df = add_surrogate_id(raw, spread_by=keys) if with_id else raw
    if "event_time" in df.columns:
        df = normalize_event_time(df, hours)
    return df.select(*[c for c in S.CLEAN_COLUMNS if c in df.columns])


def in_year(df: DataFrame, year: int, clock: str) -> DataFrame:
    """Rows of one year, by a range on the clock and, where the table is cut by that clock, by folder."""
    kept = df.filter(C.within_year(clock, year))
    return kept.filter(F.col(CLEAN_YEAR) == year) if clock == CLEAN_CLOCK and CLEAN_YEAR in df.columns else kept
