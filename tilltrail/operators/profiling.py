"""Counts that say what is missing or contradictory in the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.operators import cleaning
from tilltrail.operators import measures as M
from tilltrail.operators.imputation import BRAND, CATEGORY, Dimension, impute_groups


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values per column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns or df.columns])


def null_profile_of_view(clean: DataFrame) -> DataFrame:
    """Missing values per column of the filled view, counted on the clean rows in one scan.

    Filling leaves a gap only where the text and the key it is looked up or named by are both missing.
    """
    dated = cleaning.add_calendar(cleaning.add_user_type(clean), cleaning.CLEAN_CLOCK)
    missing = {c: F.col(c).isNull() for c in S.VIEW_COLUMNS}
    for dim in (CATEGORY, BRAND):
        missing[dim.value] = F.col(dim.value).isNull() & F.col(dim.key).isNull()
    return dated.agg(*[F.count_if(gap).alias(c) for c, gap in missing.items()])


def serial_uniqueness(raw: DataFrame) -> DataFrame:
    """Distinct row numbers beside all rows; equal if the number is unique."""
    return raw.agg(
        F.count_distinct("serial_number").alias("distinct_serials"),
        F.count(F.lit(1)).alias("row_count"),
    )


def user_frequency(df: DataFrame) -> DataFrame:
    """Rows per user; guests are one group, which collapses before the shuffle."""
    counted = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_per_userid"))
    return counted.orderBy(F.desc("total_per_userid"), "user_id")


def is_incomplete() -> Column:
    return F.col("category_code").isNull() | F.col("brand").isNull()


def incomplete_row_count(df: DataFrame) -> DataFrame:
    return df.filter(is_incomplete()).agg(F.count(F.lit(1)).alias("incomplete_rows"))


def incomplete_rows(df: DataFrame) -> DataFrame:
    return df.filter(is_incomplete())


def mapping_conflicts(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Keys that occur with more than one text."""
    return df.groupBy(key).agg(F.count_distinct(value).alias(name)).filter(F.col(name) > 1)


def gap_row_count(df: DataFrame, dim: Dimension, name: str) -> DataFrame:
    """Rows whose text is still a gap label after filling, from totals by key and text."""
    groups = df.groupBy(dim.key, dim.value).agg(F.count(F.lit(1)).alias("vol"))
    gaps = impute_groups(groups, dim).filter(dim.is_gap())
    return gaps.agg(F.coalesce(F.sum("vol"), F.lit(0)).alias(name))


def time_range(df: DataFrame, clock: str) -> DataFrame:
    return df.agg(F.min(clock).alias("first_time"), F.max(clock).alias("last_time"))


def distinct_times_per_year(df: DataFrame, clock: str) -> DataFrame:
    """Distinct clock readings per year: a collapsed clock shows as a single one."""
    times = df.select(F.year(clock).alias("year"), F.col(clock).alias("at"))
    return times.groupBy("year").agg(F.count_distinct("at").alias("distinct_times"))


def rows_by_weekday(df: DataFrame) -> DataFrame:
    """Rows and revenue per weekday of a frame that is already limited to a period."""
    return (
        df.groupBy(F.col("weekday").alias("weekday_of_sales"))
        .agg(F.count(F.lit(1)).alias("transaction_count"), M.revenue_sum().alias("total_revenue"))
        .orderBy("weekday_of_sales")
    )


def preview(df: DataFrame, keys: list[str], n: int, offset: int = 0) -> DataFrame:
    """The first n rows after an offset, in the order of the keys."""
    return df.orderBy(*keys).limit(offset + n).offset(offset)
