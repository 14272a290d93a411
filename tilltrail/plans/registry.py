"""Every query by name: which records it reads and what it runs on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.functions import columns as C
from tilltrail.operators import cleaning, profiling
from tilltrail.operators import imputation as I
from tilltrail.plans import (
    baseline,
    concentration,
    distincts,
    enrichment,
    gapruns,
    growth,
    integrity,
    outliers,
    strategy,
    summaries,
    views,
)
from tilltrail.plans.incremental import SummaryStore
from tilltrail.session import fresh_folder, stored
from tilltrail.sources import tables
from tilltrail.sources.samples import ALL, sample_purchases

Query = Callable[[SparkSession, str], DataFrame]

STORED = [c for c in ALL if c != "serial_number"]
CATEGORY_COLUMNS = ["category_id", "category_code"]
BRAND_COLUMNS = ["product_id", "brand"]
ROW_ORDER = ["order_id", "product_id", "price", "event_time", "user_id", "category_id", "category_code", "brand"]
CLOCK = strategy.CLOCK


def raw(columns: list[str], run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: run(sample_purchases(spark, folder, columns))


def clean(columns: list[str], run: Callable[[DataFrame], DataFrame], with_id: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        records = sample_purchases(spark, folder, columns)
        return run(cleaning.clean_purchases(records, with_id=with_id))

    return query


def maps_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Both maps from frames of two columns, which look up neither orders nor more than they need."""
    columns = {I.CATEGORY: CATEGORY_COLUMNS, I.BRAND: BRAND_COLUMNS}
    return {dim.name: I.value_map(sample_purchases(spark, folder, c), dim) for dim, c in columns.items()}


def view(columns: list[str], run: Callable[[DataFrame], DataFrame], with_id: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        records = sample_purchases(spark, folder, columns)
        rows = cleaning.clean_purchases(records, with_id=with_id)
        return run(views.purchases_view(rows, maps=maps_of(spark, folder)))

    return query


def complete(columns: list[str], run: Callable[[DataFrame], DataFrame]) -> Query:
    return raw(columns, lambda df: run(views.baseline_view(df)))


def _id_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("id").alias("distinct_ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


def _quality() -> dict[str, Query]:
    return {
        "row_count": raw(["price"], profiling.row_count),
        "row_count_after_drop": complete(["category_code", "brand"], profiling.row_count),
        "null_profile_raw": raw(ALL, profiling.null_profile),
        "null_profile_after_drop": raw(STORED, lambda df: profiling.null_profile(cleaning.drop_incomplete(df))),
        "null_profile_view": clean(
            STORED, lambda df: profiling.null_profile_of_view(cleaning.add_arrival_id(df))
        ),
        "serial_uniqueness": raw(["serial_number"], profiling.serial_uniqueness),
        "user_frequency": raw(["user_id"], profiling.user_frequency),
        "incomplete_row_count": raw(["category_code", "brand"], profiling.incomplete_row_count),
        "incomplete_row_count_after_drop": complete(["category_code", "brand"], profiling.incomplete_row_count),
        "incomplete_rows": raw(
            STORED, lambda df: profiling.preview(profiling.incomplete_rows(df), ROW_ORDER, 20)
        ),
        "incomplete_rows_after_drop": complete(STORED, profiling.incomplete_rows),
        "category_id_conflicts": clean(
            CATEGORY_COLUMNS, lambda df: profiling.mapping_conflicts(df, "category_id", "category_code", "max_names")
        ),
        "product_brand_conflicts": raw(
            BRAND_COLUMNS, lambda df: profiling.mapping_conflicts(df, "product_id", "brand", "brand_count")
        ),
        "category_brand_conflicts": raw(
            ["category_id", "brand"],
            lambda df: profiling.mapping_conflicts(df, "category_id", "brand", "brand_count"),
        ),
        "unlabelled_row_count": clean(
            CATEGORY_COLUMNS, lambda df: profiling.gap_row_count(df, I.CATEGORY, "unlabelled_rows")
        ),
        "unknown_brand_row_count": clean(
            BRAND_COLUMNS, lambda df: profiling.gap_row_count(df, I.BRAND, "unknown_rows")
        ),
        "time_range": clean(["event_time"], lambda df: profiling.time_range(df, CLOCK)),
        "baseline_time_range": complete(
            ["event_time", "category_code", "brand"], lambda df: profiling.time_range(df, "event_time")
        ),
        "distinct_times_per_year": clean(["event_time"], lambda df: profiling.distinct_times_per_year(df, CLOCK)),
        "epoch_rows_by_weekday": clean(
            ["event_time", "price"],
            lambda df: profiling.rows_by_weekday(
                cleaning.add_calendar(cleaning.in_year(df, S.EPOCH_YEAR, CLOCK), CLOCK)
            ),
        ),
        "clean_yearly_sales": clean(
            ["event_time"],
            lambda df: df.groupBy(F.year(CLOCK).alias("year")).agg(F.count(F.lit(1)).alias("yearly_sales")),
        ),
        "preview_raw": raw(STORED, lambda df: profiling.preview(df, ROW_ORDER, 5)),
        "preview_clean": clean(STORED, lambda df: profiling.preview(df, ROW_ORDER, 5)),
        "preview_view": view(
            STORED,
            lambda df: profiling.preview(df, [CLOCK if c == "event_time" else c for c in ROW_ORDER], 10),
        ),
        "preview_baseline": complete(STORED, lambda df: profiling.preview(df, ROW_ORDER, 10)),
        "preview_baseline_page": complete(STORED, lambda df: profiling.preview(df, ROW_ORDER, 10, offset=100)),
    }


def _cleaning() -> dict[str, Query]:
    return {
        "drop_serial": raw(ALL, cleaning.drop_serial),
        "drop_incomplete": raw(STORED, cleaning.drop_incomplete),
        "add_surrogate_id": raw(["serial_number"], lambda df: _id_summary(cleaning.add_surrogate_id(df))),
        "add_arrival_id": raw(
            ["price"],
            lambda df: cleaning.add_arrival_id(df).agg(
                F.count(F.lit(1)).alias("row_count"), F.count_distinct("id").alias("distinct_ids")
            ),
        ),
        "normalize_event_time": raw(
            ["order_id", "product_id", "event_time"], lambda df: cleaning.normalize_event_time(df)
        ),
        "add_user_type": raw(["order_id", "product_id", "user_id"], cleaning.add_user_type),
        "add_calendar": clean(["order_id", "product_id", "event_time"], lambda df: cleaning.add_calendar(df, CLOCK)),
        "add_calendar_padded": raw(
            ["order_id", "product_id", "event_time"],
            lambda df: cleaning.add_calendar(df, "event_time", padded=True),
        ),
        "category_map": raw(CATEGORY_COLUMNS, lambda df: I.value_map(df, I.CATEGORY)),
        "brand_map": raw(BRAND_COLUMNS, lambda df: I.value_map(df, I.BRAND)),
        "category_map_by_mode": raw(CATEGORY_COLUMNS, lambda df: I.value_map(df, I.CATEGORY, "mode")),
        "impute_category": raw(["order_id", *CATEGORY_COLUMNS], I.impute_category),
        "impute_brand": raw(["order_id", *BRAND_COLUMNS], I.impute_brand),
        "purchases_view": view(STORED, lambda df: df),
        "purchases_view_ids": view(ALL, _id_summary, with_id=True),
        "baseline_view": complete(STORED, lambda df: df),
    }


def _baseline() -> dict[str, Query]:
    def one(report: baseline.Report) -> Query:
        return complete(baseline.columns_read(report), lambda df: baseline.run(df, report))

    # The test records have no brand "lg"; the count is taken for one they have.
    reports = dict(baseline.REPORTS)
    reports["smartphone_brand_count"] = baseline.brand_count_of("brand1")
    return {name: one(report) for name, report in reports.items()}


def _strategy() -> dict[str, Query]:
    timed = ["user_id", "event_time", "price"]
    by_category = ["user_id", *CATEGORY_COLUMNS, "price"]
    by_brand = ["user_id", *BRAND_COLUMNS, "price"]
    both = [*CATEGORY_COLUMNS, *BRAND_COLUMNS, "price"]
    return {
        "user_segmentation": clean(["user_id", "product_id", *CATEGORY_COLUMNS, "price"], strategy.user_segmentation),
        "monthly_seasonality": clean(timed, strategy.monthly_seasonality),
        "payday_analysis": clean(timed, strategy.payday_analysis),
        "weekday_rhythm": clean(timed, strategy.weekday_rhythm),
        "hourly_analysis": clean(timed, strategy.hourly_analysis),
        "category_by_user_type": clean(by_category, strategy.category_by_user_type),
        "category_side_by_side": clean(by_category, strategy.category_side_by_side),
        "unlabelled_share_of_wallet": clean(by_category, strategy.unlabelled_share_of_wallet),
        "category_master": clean(by_category, strategy.category_master),
        "unlabelled_deep_dive": clean(both, strategy.unlabelled_deep_dive),
        "brand_by_user_type": clean(by_brand, strategy.brand_by_user_type),
        "brand_side_by_side": clean(by_brand, strategy.brand_side_by_side),
        "unknown_share_of_wallet": clean(by_brand, strategy.unknown_share_of_wallet),
        "brand_master": clean(by_brand, strategy.brand_master),
        "unknown_brand_deep_dive": clean(both, strategy.unknown_brand_deep_dive),
        "grand_totals": clean(["price"], strategy.grand_totals),
        "category_segments": clean([*CATEGORY_COLUMNS, "price"], strategy.category_segments),
        "brand_segments": clean([*BRAND_COLUMNS, "price"], strategy.brand_segments),
        "time_window_segments": clean(["event_time", "price"], strategy.time_window_segments),
        "efficiency_index": clean(["event_time", *both], lambda df: strategy.scored_segments(df).drop("is_large")),
        "strategy_portfolio": clean(["event_time", *both], strategy.strategy_portfolio),
    }


def csv_round_trip(records: DataFrame) -> DataFrame:
    """Records written as purchase CSVs and loaded again with the declared types.

    The files hold instants; the sample's clock is ahead of them by the usual offset.
    """
    spark = records.sparkSession
    folder = fresh_folder(spark, "csv-round-trip")
    instant = F.date_format(C.hours_before("event_time", S.CLOCK_OFFSET_HOURS), "yyyy-MM-dd HH:mm:ss")
    files = records.withColumn("event_time", F.concat(instant, F.lit(" UTC")))
    files.write.mode("overwrite").option("header", True).csv(folder)
    return cleaning.clean_purchases(tables.read_purchases(spark, folder))


def stored_table(df: DataFrame) -> DataFrame:
    """The clean table written by month and scanned again."""
    spark = df.sparkSession
    folder = fresh_folder(spark, "stored-table")
    tables.write_clean(df, folder)
    return tables.read_clean(spark, folder)


def stored_baseline(df: DataFrame) -> DataFrame:
    """Monthly volume and revenue of the baseline, taken from the stored clean table."""
    view = views.baseline_view(stored_table(df))
    volume, revenue = (baseline.run(view, baseline.REPORTS[name]) for name in ("monthly_volume", "monthly_revenue"))
    return volume.join(revenue, "month")


def appended_ids(df: DataFrame) -> DataFrame:
    """The records stored in two writes, the second one appended: their ids must differ."""
    spark = df.sparkSession
    folder = fresh_folder(spark, "appended-table")
    odd = F.col("order_id") % 2 == 1
    tables.write_clean(df.filter(~odd), folder)
    tables.write_clean(df.filter(odd), folder, mode="append")
    whole = tables.read_clean(spark, folder)
    return whole.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("id").alias("distinct_ids"))


def exported_report(report: DataFrame) -> DataFrame:
    """A report exported as CSV and read back."""
    spark = report.sparkSession
    folder = fresh_folder(spark, "exported-report")
    tables.export_reports({"report": report}, folder)
    return spark.read.schema(report.schema).csv(f"{folder}/report", header=True, mode="FAILFAST")


def _folders() -> list[Column]:
    """The folder columns of the stored table under the names of the calendar."""
    return [F.col(cleaning.CLEAN_YEAR).alias("year"), F.col(cleaning.CLEAN_MONTH).alias("month")]


def _sources() -> dict[str, Query]:
    return {
        "read_purchases": raw(ALL, csv_round_trip),
        "write_clean": clean(STORED, lambda df: stored_table(df).select(*S.CLEAN_COLUMNS[1:], *_folders())),
        "baseline_from_stored": clean(STORED, stored_baseline),
        "append_ids": clean(STORED, appended_ids),
        "export_reports": clean(
            ["user_id", *BRAND_COLUMNS, "price"], lambda df: exported_report(strategy.brand_master(df))
        ),
        "portfolio_from_summaries": clean(
            STORED,
            lambda df: summaries.all_reports(df.sparkSession, df)["10_unified_strategy_portfolio"],
        ),
    }


def monthly_distincts(df: DataFrame) -> DataFrame:
    return distincts.with_month_and_type(distincts.exact(df, *distincts.month_and_type()))


def distinct_estimates(df: DataFrame) -> DataFrame:
    """Monthly estimates merged from stored sketches by hour, held against exact counts."""
    sketches, _ = stored(distincts.hour_sketches(df), "hour-sketches")
    return distincts.with_month_and_type(distincts.checked_estimates(df, sketches, *distincts.month_and_type()))


BATCHES = ("first", "second", "third")


def appended_store(df: DataFrame) -> SummaryStore:
    """A store of summaries to which the records were appended in three batches: two small ones, then the rest."""
    spark = df.sparkSession
    store = SummaryStore(spark, fresh_folder(spark, "summary-store"))
    part = F.least((F.col("order_id") % 40).cast("int"), F.lit(2))
    for i, name in enumerate(BATCHES):
        store.append(df.filter(part == i), name)
    return store


def _questions() -> dict[str, Query]:
    counted = ["user_id", "event_time", "product_id", "category_id"]
    money = [*CATEGORY_COLUMNS, "price"], [*BRAND_COLUMNS, "price"]
    (category, brand), both = money, (I.CATEGORY, I.BRAND)
    every = ["user_id", "event_time", *CATEGORY_COLUMNS, *BRAND_COLUMNS, "price"]
    return {
        "distinct_by_month": clean(counted, monthly_distincts),
        "distinct_estimates_by_month": clean(counted, distinct_estimates),
        "portfolio_after_appends": clean(
            STORED, lambda df: appended_store(df).reports()["10_unified_strategy_portfolio"]
        ),
        "segmentation_after_appends": clean(
            STORED, lambda df: appended_store(df).reports()["01_user_segmentation_summary"]
        ),
        "category_totals_after_appends": clean(STORED, lambda df: appended_store(df).label_totals(I.CATEGORY)),
        "brand_totals_after_appends": clean(STORED, lambda df: appended_store(df).label_totals(I.BRAND)),
        "moved_brand_totals": clean(STORED, lambda df: appended_store(df).moves(I.BRAND)),
        "category_concentration": clean(category, lambda df: concentration.concentration(df, both[0])),
        "brand_concentration": clean(brand, lambda df: concentration.concentration(df, both[1])),
        "category_concentration_summary": clean(category, lambda df: concentration.concentration_summary(df, both[0])),
        "brand_concentration_summary": clean(brand, lambda df: concentration.concentration_summary(df, both[1])),
        "category_growth": clean(["event_time", *category], lambda df: growth.monthly_growth(df, both[0])),
        "gap_runs": clean(every, lambda df: gapruns.gap_runs(df, *both)),
        "gap_dispersion": clean(every, lambda df: gapruns.gap_dispersion(df, *both)),
        "outlying_segments": clean(every, outliers.outlying_segments),
        "integrity_score": clean(every, lambda df: integrity.integrity_score(integrity.status_cells(df))),
        "status_associations": clean(every, lambda df: integrity.status_associations(integrity.status_cells(df))),
        "heavy_gap_categories": clean(category, lambda df: enrichment.heavy_gaps(df, both[0], "0.5")),
        "heavy_gap_products": clean(brand, lambda df: enrichment.heavy_gaps(df, both[1], "0.5")),
    }


def all_queries() -> dict[str, Query]:
    return {**_quality(), **_cleaning(), **_baseline(), **_strategy(), **_sources(), **_questions()}
