"""The six generic rankings that the descriptive reports are instances of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.functions import ratios as R
from tilltrail.operators import measures as M


def _ranked(groups: DataFrame, measure: str, dim: str, order: str | None, k: int | None) -> DataFrame:
    """Sort by the measure or the group, ties by group, and keep the first k if asked."""
    if order is None:
        return groups
    by = {
        "dim": [F.col(dim)],
        "desc": [F.desc_nulls_first(measure), F.col(dim)],
        "asc": [F.asc_nulls_last(measure), F.col(dim)],
    }[order]
    ranked = groups.orderBy(*by)
    return ranked if k is None else ranked.limit(k)


def _aggregate(
    df: DataFrame, dim: str, measure: Column, name: str, order: str | None, k: int | None
) -> DataFrame:
    return _ranked(df.groupBy(dim).agg(measure.alias(name)), name, dim, order, k)


def volume_by(df: DataFrame, dim: str, name: str, order: str | None = None, k: int | None = None) -> DataFrame:
    return _aggregate(df, dim, F.count(F.lit(1)), name, order, k)


def revenue_by(df: DataFrame, dim: str, name: str, order: str | None = None, k: int | None = None) -> DataFrame:
    return _aggregate(df, dim, M.revenue_sum(), name, order, k)


def max_price_by(df: DataFrame, dim: str, name: str, order: str | None = None, k: int | None = None) -> DataFrame:
    return _aggregate(df, dim, F.max("price"), name, order, k)


def min_price_by(df: DataFrame, dim: str, name: str, order: str | None = None, k: int | None = None) -> DataFrame:
    return _aggregate(df, dim, F.min("price"), name, order, k)


def avg_price_by(df: DataFrame, dim: str, name: str, order: str | None = None, k: int | None = None) -> DataFrame:
    groups = df.groupBy(dim).agg(M.revenue_sum().alias("_rev"), F.count("price").alias("_priced"))
    return _ranked(groups.select(dim, R.order_value("_rev", "_priced").alias(name)), name, dim, order, k)


def distinct_by(
    df: DataFrame, dim: str, column: str, name: str, order: str | None = None, k: int | None = None
) -> DataFrame:
    return _aggregate(df, dim, F.count_distinct(column), name, order, k)


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias(name))


def row_total(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def top_brands_avg_price(df: DataFrame, k: int) -> DataFrame:
    """Average price of the k brands with most rows.

    Rank and average come from one aggregate, so the facts are read once and not joined back.
    The ranking window sees only the k rows that the limit left.
    """
    top = df.groupBy("brand").agg(*M.row_measures()).orderBy(F.desc("vol"), "brand").limit(k)
    place = Window.orderBy(F.desc("vol"), "brand")
    return top.select(
        F.row_number().over(place).alias("rank"), "brand", M.order_value().alias("avg_price")
    ).orderBy("rank")
