"""Descriptive reports on the baseline view, as a table of instances of generic rankings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.operators import measures as M
from tilltrail.operators import rollups
from tilltrail.plans.views import baseline_of_year


@dataclass(frozen=True)
class Report:
    """What to measure, per which column, under which name, over which rows, and how ranked.

    ``order`` is ``dim``, ``desc``, ``asc`` or None; ``k`` keeps the first k.
    """

    kind: str
    dim: str | None
    name: str
    year: int | None = S.REPORT_YEAR
    order: str | None = None
    k: int | None = None
    category: str | None = None
    guests_only: bool = False
    brand: str | None = None


def _period_reports() -> dict[str, Report]:
    """Volume (and for the report year revenue) per calendar unit."""
    reports = {}
    for unit, adverb in (("month", "monthly"), ("day", "daily"), ("weekday", "weekday"), ("hour", "hourly")):
        order = "week" if unit == "weekday" else "dim"
        reports[f"epoch_{adverb}_volume"] = Report("volume", unit, f"{adverb}_sales", S.EPOCH_YEAR, "dim")
        reports[f"{adverb}_volume"] = Report("volume", unit, f"{adverb}_sales", order=order)
        reports[f"{adverb}_revenue"] = Report("revenue", unit, f"{adverb}_sales_revenue", order=order)
    return reports


def _category_reports(prefix: str, category: str, highest: str) -> dict[str, Report]:
    """Brands of one category: volume, revenue and price range."""
    return {
        f"{prefix}_brands_volume": Report("volume", "brand", "total_sales", order="desc", category=category),
        f"{prefix}_brands_revenue": Report("revenue", "brand", "total_revenue", order="desc", category=category),
        f"{prefix}_max_price": Report("max_price", "brand", highest, order="desc", category=category),
        f"{prefix}_min_price": Report("min_price", "brand", "lowest_price", order="asc", category=category),
        f"{prefix}_avg_price": Report("avg_price", "brand", "average_price", order="desc", category=category),
    }


def brand_count_of(brand: str, category: str = S.SMARTPHONES) -> Report:
    """Rows of one brand in one category, over all years."""
    return Report("rows", None, "units", year=None, category=category, brand=brand)


EPOCH = S.EPOCH_YEAR

REPORTS: dict[str, Report] = {
    "yearly_sales": Report("volume", "year", "yearly_sales", year=None),
    **_period_reports(),
    # Rows whose clock collapsed to the epoch.
    "epoch_null_user_count": Report("rows", None, "null_users", EPOCH, guests_only=True),
    "epoch_distinct_categories": Report("distinct", "category_code", "categories", EPOCH),
    "epoch_distinct_brands": Report("distinct", "brand", "brands", EPOCH),
    "epoch_brand_diversity": Report("brands", "category_code", "brand_count", EPOCH, "desc"),
    "epoch_top_categories_volume": Report("volume", "category_code", "sales_by_category", EPOCH, "desc", 10),
    "epoch_top_brands_volume": Report("volume", "brand", "sales_by_brand", EPOCH, "desc", 10),
    "epoch_top_categories_revenue": Report("revenue", "category_code", "top_earning_category", EPOCH, "desc", 10),
    "epoch_top_brands_revenue": Report("revenue", "brand", "top_earning_brand", EPOCH, "desc", 20),
    "epoch_top_brands_avg_price": Report("top_avg", "brand", "avg_price", EPOCH, k=10),
    "epoch_worst_categories_volume": Report("volume", "category_code", "worst_sales_by_category", EPOCH, "asc", 15),
    "epoch_worst_categories_revenue": Report("revenue", "category_code", "worst_revenue_by_category", EPOCH, "asc", 15),
    "epoch_worst_brands_volume": Report("volume", "brand", "worst_sales_by_brand", EPOCH, "asc", 15),
    "epoch_worst_brands_revenue": Report("revenue", "brand", "worst_revenue_by_brand", EPOCH, "asc", 15),
    "epoch_smartphone_brands_volume": Report(
        "volume", "brand", "total_sales_by_volume", EPOCH, "desc", category=S.SMARTPHONES
    ),
    "epoch_smartphone_brands_revenue": Report(
        "revenue", "brand", "total_sales_by_revenue", EPOCH, "desc", category=S.SMARTPHONES
    ),
    # The report year.
    "null_user_count": Report("rows", None, "null_users", guests_only=True),
    "distinct_categories": Report("distinct", "category_code", "categories"),
    "distinct_brands": Report("distinct", "brand", "brands"),
    "brand_diversity": Report("brands", "category_code", "brand_count", order="desc"),
    "top_categories_volume": Report("volume", "category_code", "sales_by_category", order="desc", k=10),
    "top_categories_revenue": Report("revenue", "category_code", "revenue_by_category", order="desc", k=10),
    "top_brands_volume": Report("volume", "brand", "brand_sales_by_volume", order="desc", k=10),
    "top_brands_revenue": Report("revenue", "brand", "brand_sales_by_revenue", order="desc", k=10),
    "top_brands_avg_price": Report("top_avg", "brand", "avg_price", k=10),
    "worst_categories_volume": Report("volume", "category_code", "sales_by_category", order="asc", k=10),
    "worst_brands_volume": Report("volume", "brand", "brand_sales_by_volume", order="asc"),
    **_category_reports("smartphone", S.SMARTPHONES, "maximum_price"),
    **_category_reports("fridge", S.FRIDGES, "highest_price"),
    "smartphone_brand_count": brand_count_of("lg"),
}

_RANKINGS = {
    "volume": rollups.volume_by,
    "revenue": rollups.revenue_by,
    "max_price": rollups.max_price_by,
    "min_price": rollups.min_price_by,
    "avg_price": rollups.avg_price_by,
}


def columns_read(report: Report) -> list[str]:
    """Raw columns a report needs, for sources that look columns up."""
    need = {"category_code", "brand", "price"}
    if report.year is not None or report.dim in ("year", "month", "day", "weekday", "hour"):
        need.add("event_time")
    if report.guests_only:
        need.add("user_id")
    return sorted(need)


def run(view: DataFrame, report: Report) -> DataFrame:
    equal_to = {"category_code": report.category, "brand": report.brand}
    equal_to = {c: v for c, v in equal_to.items() if v is not None}
    if report.year is None:
        rows = view
        for name, value in equal_to.items():
            rows = rows.filter(F.col(name) == value)
    else:
        rows = baseline_of_year(view, report.year, **equal_to)
    if report.guests_only:
        rows = rows.filter(F.col("user_id").isNull())
    if report.kind == "rows":
        return rollups.row_total(rows, report.name)
    if report.kind == "distinct":
        return rollups.distinct_count(rows, report.dim, report.name)
    if report.kind == "brands":
        return rollups.distinct_by(rows, report.dim, "brand", report.name, report.order, report.k)
    if report.kind == "top_avg":
        return rollups.top_brands_avg_price(rows, report.k)
    if report.order == "week":
        return _by_weekday(rows, report)
    return _RANKINGS[report.kind](rows, report.dim, report.name, report.order, report.k)


def _by_weekday(rows: DataFrame, report: Report) -> DataFrame:
    """Weekdays in calendar order, Sunday first."""
    measure = F.count(F.lit(1)) if report.kind == "volume" else M.revenue_sum()
    days = rows.groupBy("weekday", F.dayofweek("event_time").alias("_day")).agg(measure.alias(report.name))
    return days.orderBy("_day").drop("_day")
