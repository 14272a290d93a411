"""Strategy reports on the clean table.

Every report takes rows as the clean table holds them, gaps included; the filled view works as
well, and so do the summaries of ``plans.summaries``, which carry measures instead of prices.
Reports over categories and brands aggregate by raw key and text first and fill the gaps in the
totals (see ``imputation.impute_groups``), so fact rows are read once, combined before the one
shuffle, and never joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.functions import columns as C
from tilltrail.functions import ratios as R
from tilltrail.operators import cleaning
from tilltrail.operators import measures as M
from tilltrail.operators.imputation import BRAND, CATEGORY, Dimension, impute, impute_groups, value_map

CLOCK = "normalized_event_time"
TIME_WINDOW = "Time Window"


# --- groups -------------------------------------------------------------------------------------


def with_user_type(df: DataFrame) -> DataFrame:
    return df if "user_type" in df.columns else cleaning.add_user_type(df)


def filled_groups(facts: DataFrame, dim: Dimension, *by: str) -> DataFrame:
    """Measures per key, text and ``by``, with the text filled."""
    groups = facts.groupBy(dim.key, dim.value, *by).agg(*M.measures_of(facts))
    return impute_groups(groups, dim)


def by_text_and_user(facts: DataFrame, dim: Dimension) -> DataFrame:
    groups = filled_groups(with_user_type(facts), dim, "user_type")
    return groups.groupBy(dim.value, "user_type").agg(*M.merged_measures())


def _of(kind: str) -> Column:
    return F.col("user_type") == kind


def split_by_user(groups: DataFrame, *by: str | Column) -> DataFrame:
    """Measures side by side: ``anon_``, ``reg_`` and ``total_``."""
    return groups.groupBy(*by).agg(
        *[c for kind, side in USERS.items() for c in M.merged_measures(kind, side)],
        *M.merged_measures(prefix="total_"),
    )


USERS = {S.ANONYMOUS: "anon_", S.REGISTERED: "reg_"}
SIDES = (*USERS.values(), "total_")


# --- user types ---------------------------------------------------------------------------------


def user_segmentation(facts: DataFrame, buyers: DataFrame | None = None) -> DataFrame:
    """Guests and members compared: volume, revenue, order value, diversity, unlabelled revenue.

    ``buyers`` are the rows to count users and products in, if ``facts`` is a summary without them.

    Totals come from category groups. Users and products are counted apart, so the wide distinct
    columns do not multiply the rows that carry the measures. The broadcast side has two rows, one
    per user type.
    """
    typed = with_user_type(facts)
    groups = filled_groups(typed, CATEGORY, "user_type")
    totals = groups.groupBy("user_type").agg(
        *M.merged_measures(),
        F.sum(F.when(CATEGORY.is_gap(), F.col("rev")).otherwise(0)).cast(S.REVENUE_TYPE).alias("gap_rev"),
        F.count_distinct("category_id").alias("category_diversity"),
    )
    people = with_user_type(facts if buyers is None else buyers).groupBy("user_type").agg(
        F.count_distinct("user_id").alias("unique_registered_users"),
        F.count_distinct("product_id").alias("product_diversity"),
    )
    both = totals.join(F.broadcast(people), "user_type")
    return M.with_total(both, groups).select(
        "user_type",
        F.col("vol").alias("transaction_volume"),
        M.volume_share().alias("volume_percentage"),
        "unique_registered_users",
        M.revenue().alias("total_revenue"),
        M.revenue_share().alias("revenue_percentage"),
        M.order_value().alias("aov"),
        "category_diversity",
        "product_diversity",
        R.money_percent_of("gap_rev", "rev").alias("percent_unlabelled_revenue"),
    ).orderBy(F.desc_nulls_first("total_revenue"))


# --- time ---------------------------------------------------------------------------------------


def _of_year(facts: DataFrame, year: int) -> DataFrame:
    return cleaning.in_year(with_user_type(facts), year, CLOCK)


def _with_shares(groups: DataFrame, within: str, names: dict[str, str]) -> DataFrame:
    """Add shares of the whole and of the groups that agree in ``within``."""
    part = Window.partitionBy(within)
    summed = M.with_total(groups, groups).withColumns(
        {"_part_vol": F.sum("vol").over(part), "_part_rev": F.sum("rev").over(part)}
    )
    return summed.withColumns(
        {
            names["vol_total"]: M.volume_share(),
            names["vol_within"]: R.percent_of("vol", "_part_vol"),
            names["rev_total"]: M.revenue_share(),
            names["rev_within"]: R.money_percent_of("rev", "_part_rev"),
        }
    )


def monthly_seasonality(facts: DataFrame, year: int = S.REPORT_YEAR) -> DataFrame:
    groups = (
        _of_year(facts, year).groupBy(F.month(CLOCK).alias("month"), "user_type").agg(*M.measures_of(facts))
    )
    names = {
        "vol_total": "monthly_volume_pct",
        "vol_within": "volume_within_month_pct",
        "rev_total": "monthly_revenue_pct",
        "rev_within": "revenue_within_month_pct",
    }
    return (
        _with_shares(groups, "month", names)
        .select(
            "month",
            "user_type",
            F.col("vol").alias("monthly_volume"),
            "monthly_volume_pct",
            "volume_within_month_pct",
            M.revenue().alias("monthly_revenue"),
            "monthly_revenue_pct",
            "revenue_within_month_pct",
            M.order_value().alias("aov"),
        )
        .orderBy("month", "user_type")
    )


def payday_analysis(facts: DataFrame, year: int = S.REPORT_YEAR) -> DataFrame:
    groups = cleaning.in_year(facts, year, CLOCK).groupBy(F.dayofmonth(CLOCK).alias("day")).agg(*M.measures_of(facts))
    return M.with_total(groups, groups).select(
        "day",
        F.col("vol").alias("day_volume"),
        M.volume_share().alias("volume_pct"),
        M.revenue().alias("day_revenue"),
        M.revenue_share().alias("revenue_pct"),
        M.order_value().alias("aov"),
    ).orderBy("day")


def weekday_rhythm(facts: DataFrame, year: int = S.REPORT_YEAR) -> DataFrame:
    """Weekdays from Monday on; they are grouped by number and named afterwards."""
    groups = (
        _of_year(facts, year).groupBy(F.weekday(CLOCK).alias("_day"), "user_type").agg(*M.measures_of(facts))
    )
    names = {
        "vol_total": "volume_total_pct",
        "vol_within": "volume_share_within_day_pct",
        "rev_total": "revenue_total_pct",
        "rev_within": "revenue_share_within_day_pct",
    }
    return (
        _with_shares(groups, "_day", names)
        .orderBy("_day", "user_type")
        .select(
            C.weekday_name(F.col("_day")).alias("weekday"),
            "user_type",
            F.col("vol").alias("transaction_volume"),
            "volume_total_pct",
            "volume_share_within_day_pct",
            M.revenue().alias("total_revenue"),
            "revenue_total_pct",
            "revenue_share_within_day_pct",
            M.order_value().alias("aov"),
        )
    )


def hourly_analysis(facts: DataFrame, year: int = S.REPORT_YEAR) -> DataFrame:
    """Share and order value per hour, rated against the plain mean of the hourly order values.

    The mean is of hours, not of rows. It is compared as ``value * hours > sum of values`` on
    order values of twelve decimals, so no further rounding enters.
    """
    groups = (
        _of_year(facts, year).groupBy(F.hour(CLOCK).alias("hour"), "user_type").agg(*M.measures_of(facts))
    )
    same_type = Window.partitionBy("user_type")
    value = (F.col("rev") / F.nullif(F.col("priced"), F.lit(0)).cast("decimal(20,0)")).cast("decimal(28,12)")
    rated = groups.withColumn("_value", value).withColumns(
        {
            "_hours": F.count("_value").over(same_type).cast("decimal(2,0)"),
            "_values": F.sum("_value").over(same_type),
            "_all": F.sum("vol").over(same_type),
        }
    )
    above = F.col("_value") * F.col("_hours") > F.col("_values")
    return rated.select(
        "hour",
        "user_type",
        F.col("vol").alias("transaction_volume"),
        R.percent_of("vol", "_all").alias("hourly_volume_share"),
        M.order_value().alias("hourly_aov"),
        F.when(above, S.PREMIUM_HOUR).otherwise(S.STANDARD_HOUR).alias("efficiency_rating"),
    ).orderBy("hour", "user_type")


# --- categories and brands ----------------------------------------------------------------------


def dimension_by_user_type(facts: DataFrame, dim: Dimension) -> DataFrame:
    """Each text per user type with its share in that user type."""
    groups = by_text_and_user(facts, dim)
    sums = groups.agg(*[c for kind, side in USERS.items() for c in M.merged_measures(kind, side)])
    totalled = M.with_total(groups, sums, M.prefixed(*USERS.values()))
    own = {
        name: F.when(_of(S.ANONYMOUS), M.total(f"anon_{name}")).otherwise(M.total(f"reg_{name}"))
        for name in M.MEASURES
    }
    return totalled.withColumn(M.TOTAL, F.struct(*[c.alias(name) for name, c in own.items()])).select(
        dim.value,
        "user_type",
        dim.status().alias(dim.status_column),
        F.col("vol").alias("transaction_volume"),
        M.volume_share().alias("vol_share_pct"),
        M.revenue().alias("total_revenue"),
        M.revenue_share().alias("rev_share_pct"),
        M.order_value().alias("aov"),
    ).orderBy(F.desc_nulls_first("total_revenue"), dim.value, "user_type")


def dimension_side_by_side(facts: DataFrame, dim: Dimension) -> DataFrame:
    """Guests and members next to each other; brands also carry the total volume."""
    groups = filled_groups(with_user_type(facts), dim, "user_type")
    volumes = ["anon_vol", "reg_vol"] + (["total_vol"] if dim is BRAND else [])
    return (
        split_by_user(groups, dim.value)
        .select(
            dim.value,
            dim.status().alias(dim.status_column),
            *volumes,
            "anon_rev",
            "reg_rev",
            "total_rev",
            M.order_value("anon_").alias("anon_aov"),
            M.order_value("reg_").alias("reg_aov"),
        )
        .orderBy(F.desc_nulls_first("total_rev"), dim.value)
    )


def share_of_wallet(facts: DataFrame, dim: Dimension, known_status: str, status_column: str) -> DataFrame:
    """What part of guests' and of members' purchases has no category or brand."""
    groups = filled_groups(with_user_type(facts), dim, "user_type")
    sides = split_by_user(groups, dim.status(known_status).alias(status_column))
    return M.with_total(sides, sides, M.prefixed(*USERS.values())).select(
        status_column,
        *[M.volume_share(side).alias(f"{side}vol_share_pct") for side in USERS.values()],
        *[M.revenue_share(side).alias(f"{side}rev_share_pct") for side in USERS.values()],
    )


def dimension_master(facts: DataFrame, dim: Dimension) -> DataFrame:
    """Side by side, with the market share of each text in every column."""
    groups = filled_groups(with_user_type(facts), dim, "user_type")
    sides = split_by_user(groups, dim.value)
    return M.with_total(sides, sides, M.prefixed(*SIDES)).select(
        dim.value,
        dim.status().alias(dim.status_column),
        *[f"{side}vol" for side in SIDES],
        *[M.volume_share(side).alias(f"{side}vol_share_pct") for side in SIDES],
        *[f"{side}rev" for side in SIDES],
        *[M.revenue_share(side).alias(f"{side}rev_share_pct") for side in SIDES],
        M.order_value("anon_").alias("anon_aov"),
        M.order_value("reg_").alias("reg_aov"),
    ).orderBy(F.desc_nulls_first("total_rev"), dim.value)


def category_by_user_type(facts: DataFrame) -> DataFrame:
    return dimension_by_user_type(facts, CATEGORY)


def category_side_by_side(facts: DataFrame) -> DataFrame:
    return dimension_side_by_side(facts, CATEGORY)


def unlabelled_share_of_wallet(facts: DataFrame) -> DataFrame:
    """The known status is in lower case in this report only."""
    return share_of_wallet(facts, CATEGORY, "labelled", "category_status")


def category_master(facts: DataFrame) -> DataFrame:
    return dimension_master(facts, CATEGORY)


def brand_by_user_type(facts: DataFrame) -> DataFrame:
    return dimension_by_user_type(facts, BRAND)


def brand_side_by_side(facts: DataFrame) -> DataFrame:
    return dimension_side_by_side(facts, BRAND)


def unknown_share_of_wallet(facts: DataFrame) -> DataFrame:
    return share_of_wallet(facts, BRAND, "Known", "brand_status")


def brand_master(facts: DataFrame) -> DataFrame:
    return dimension_master(facts, BRAND)


# --- gaps in depth ------------------------------------------------------------------------------


def most_frequent(value: str, count: str) -> Column:
    """The value with the highest count, the lowest value on ties. Combines before the shuffle."""
    return F.min_by(value, F.struct(-F.col(count), F.col(value)))


def sold_groups(facts: DataFrame) -> DataFrame:
    """Measures per product and category as recorded, with the brand filled per product."""
    sold = facts.groupBy("product_id", "brand", "category_id", "category_code").agg(*M.measures_of(facts))
    return impute_groups(sold, BRAND)


def with_category(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """Fill the category of groups that are finer than categories, by the map of all rows.

    One category may span most products, so this joins instead of collecting a category's groups.
    """
    return impute(groups, CATEGORY, value_map(facts, CATEGORY))


def unlabelled_deep_dive(facts: DataFrame, k: int = 15) -> DataFrame:
    """The unlabelled categories with most revenue and the brand that dominates each."""
    open_ = sold_groups(facts).filter(F.col(CATEGORY.value).isNull() | CATEGORY.is_gap())
    gaps = with_category(open_, facts).filter(CATEGORY.is_gap())
    per_brand = gaps.groupBy("category_code", "brand").agg(*M.merged_measures())
    labels = per_brand.groupBy("category_code").agg(
        most_frequent("brand", "vol").alias("anchor_brand"), *M.merged_measures()
    )
    return (
        M.with_total(labels, per_brand)
        .select(
            "category_code",
            F.col("vol").alias("transaction_volume"),
            M.revenue().alias("total_revenue"),
            M.order_value().alias("category_aov"),
            "anchor_brand",
            M.revenue_share().alias("share_of_hidden_revenue"),
        )
        .orderBy(F.desc_nulls_first("total_revenue"), "category_code")
        .limit(k)
    )


def unknown_brand_deep_dive(facts: DataFrame, k: int = 20) -> DataFrame:
    """The products without a brand that earn most, with a category to recognise them by."""
    gaps = with_category(sold_groups(facts).filter(BRAND.is_gap()), facts)
    per_category = gaps.groupBy("brand", "category_code").agg(*M.merged_measures())
    labels = per_category.groupBy("brand").agg(
        F.max("category_code").alias("category_hint"), *M.merged_measures()
    )
    return (
        M.with_total(labels, per_category)
        .select(
            "brand",
            F.col("vol").alias("transaction_volume"),
            M.revenue().alias("total_revenue"),
            M.order_value().alias("product_aov"),
            "category_hint",
            M.revenue_share().alias("share_of_unknown_revenue"),
        )
        .orderBy(F.desc_nulls_first("total_revenue"), "brand")
        .limit(k)
    )


# --- portfolio ----------------------------------------------------------------------------------


def grand_totals(facts: DataFrame) -> DataFrame:
    return facts.agg(*M.measures_of(facts)).select(
        F.col("vol").alias("total_vol"), M.revenue().alias("total_rev"), M.order_value().alias("global_aov")
    )


def _segments(groups: DataFrame, dimension: str, name: str) -> DataFrame:
    merged = groups.groupBy(name).agg(*M.merged_measures())
    return merged.select(F.lit(dimension).alias("dimension"), F.col(name).alias("segment_name"), *M.MEASURES)


def _as_report(segments: DataFrame) -> DataFrame:
    return segments.select("dimension", "segment_name", "vol", M.revenue().alias("rev"), M.order_value().alias("aov"))


def _category_segments(facts: DataFrame) -> DataFrame:
    return _segments(filled_groups(facts, CATEGORY), CATEGORY.name, CATEGORY.value)


def _brand_segments(facts: DataFrame) -> DataFrame:
    return _segments(filled_groups(facts, BRAND), BRAND.name, BRAND.value)


def _time_segments(facts: DataFrame, year: int) -> DataFrame:
    dated = cleaning.in_year(facts, year, CLOCK)
    hours = dated.groupBy(F.hour(CLOCK).alias("_hour")).agg(*M.measures_of(facts))
    return _segments(hours.withColumn("_window", C.time_window(F.col("_hour"))), TIME_WINDOW, "_window")


def category_segments(facts: DataFrame) -> DataFrame:
    return _as_report(_category_segments(facts))


def brand_segments(facts: DataFrame) -> DataFrame:
    return _as_report(_brand_segments(facts))


def time_window_segments(facts: DataFrame, year: int = S.REPORT_YEAR) -> DataFrame:
    """Four parts of the day. Hours are added up first, the labels are put on 24 rows."""
    return _as_report(_time_segments(facts, year))


def all_segments(facts: DataFrame, year: int = S.REPORT_YEAR) -> DataFrame:
    """Categories, brands and time windows with volume, revenue and order value."""
    segments = _category_segments(facts).unionByName(_brand_segments(facts)).unionByName(_time_segments(facts, year))
    return _as_report(segments)


def scored_segments(facts: DataFrame, year: int = S.REPORT_YEAR, hours: DataFrame | None = None) -> DataFrame:
    """Every segment with shares of the grand totals, efficiency index and role.

    ``hours`` are the rows to take the time windows from, if ``facts`` is a summary without a clock.

    Windows hold the report year only, categories and brands every row. Grand totals are those of
    all categories, as these hold every row, for time windows too. The three readings differ in
    columns, so each scans its own few. Comparisons are cross-multiplied, so ties are exact.
    """
    categories = _category_segments(facts)
    segments = categories.unionByName(_brand_segments(facts)).unionByName(
        _time_segments(facts if hours is None else hours, year)
    )
    rev, vol, priced = F.col("rev"), F.col("vol"), F.col("priced")
    all_rev = M.total("rev").cast(S.REVENUE_TYPE)

    def wide(c: Column) -> Column:
        return c.cast("decimal(20,0)")

    by_share = rev * wide(M.total("vol")), all_rev * wide(vol)
    by_value = rev * wide(M.total("priced")), all_rev * wide(priced)
    return M.with_total(segments, categories).select(
        "dimension",
        "segment_name",
        vol.alias("transaction_count"),
        M.revenue().alias("total_revenue"),
        M.order_value().alias("segment_aov"),
        M.volume_share().alias("vol_share_pct"),
        M.revenue_share().alias("rev_share_pct"),
        R.efficiency_index("rev", f"{M.TOTAL}.rev", "vol", f"{M.TOTAL}.vol").alias("efficiency_index"),
        C.strategic_role(
            by_share[0] > by_share[1], by_share[0] < by_share[1], by_value[0] > by_value[1], by_value[0] < by_value[1]
        ).alias("strategic_role"),
        (rev > all_rev * F.lit(S.PORTFOLIO_THRESHOLD).cast("decimal(4,3)")).alias("is_large"),
    )


def strategy_portfolio(facts: DataFrame, year: int = S.REPORT_YEAR, hours: DataFrame | None = None) -> DataFrame:
    """Segments that earn more than the threshold share of all revenue."""
    return (
        scored_segments(facts, year, hours)
        .filter("is_large")
        .drop("is_large")
        .orderBy("dimension", F.desc_nulls_first("total_revenue"), "segment_name")
    )


# Names of the exported reports.
EXPORTS = {
    "01_user_segmentation_summary": user_segmentation,
    "02_monthly_seasonality_check": monthly_seasonality,
    "03_payday_analysis": payday_analysis,
    "04_weekday_sales_rythm": weekday_rhythm,
    "05_hourly_analysis": hourly_analysis,
    "06_category_master": category_master,
    "07_unlabelled_categories": unlabelled_deep_dive,
    "08_brand_master": brand_master,
    "09_unknown_brands": unknown_brand_deep_dive,
    "10_unified_strategy_portfolio": strategy_portfolio,
}
