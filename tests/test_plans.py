"""Physical plans: what must not appear in them at scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tilltrail.operators.imputation import CATEGORY, impute_category
from tilltrail.plans import baseline, strategy
from tilltrail.plans.registry import all_queries

QUERIES = all_queries()
# Windows over few rows by construction: a limit of k, one row per shuffle partition, one per 2^32 positions.
BOUNDED_WINDOWS = {
    "category_concentration",
    "brand_concentration",
    "category_concentration_summary",
    "brand_concentration_summary",
    "top_brands_avg_price",
    "epoch_top_brands_avg_price",
    "gap_runs",
    "gap_dispersion",
    "add_surrogate_id",
    "purchases_view_ids",
}
EXPORTED = {report.__name__ for report in strategy.EXPORTS.values()}
REPORTS = [name for name in strategy.__dict__ if name in QUERIES]
FILLED = {"purchases_view", "purchases_view_ids", "preview_view", "impute_category", "impute_brand"}
TEMPORAL = ["monthly_seasonality", "payday_analysis", "weekday_rhythm", "hourly_analysis", "time_window_segments"]


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df) -> str:
    df.collect()
    text = planned(df)
    return text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join_no_global_window(spark, small, name):
    text = planned(QUERIES[name](spark, small))
    assert not re.search(r"EvalPython|InPandas|InArrow|BatchEvalPython", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in BOUNDED_WINDOWS:
        assert not re.search(r"Window \[.*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", text)


@pytest.mark.parametrize("name", TEMPORAL)
def test_time_reports_do_not_touch_categories_or_brands(spark, small, name):
    text = planned(QUERIES[name](spark, small))
    assert "p_size" not in text and "category_code" not in text


@pytest.mark.parametrize("name", ["category_master", "brand_master", "category_by_user_type", "brand_by_user_type", "payday_analysis"])
def test_totals_reuse_the_exchange_of_the_report(spark, small, name):
    df = QUERIES[name](spark, small)
    df.collect()
    text = planned(df)
    assert "ReusedExchange" in text
    # Only executed scans have a ColumnarToRow above them.
    assert len(re.findall(r"ColumnarToRow *\n[^\n]*FileScan parquet \[l_", text)) == 1


@pytest.mark.parametrize("name", sorted(set(EXPORTED) - {"user_segmentation"}))
def test_fact_rows_are_combined_before_any_fact_shuffle(spark, small, name):
    """Below every exchange of non-lookup rows sits a partial aggregate."""
    text = planned(QUERIES[name](spark, small))
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\((category|product|brand|user_type|month|day|hour|_)", line.strip(" +-:*()0123456789")):
            assert "FileScan" not in lines[i + 1]


def test_year_filter_reaches_the_scan(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2020-05-05 05:05:05' as normalized_event_time, cast(1 as decimal(8,2)) as price, cast(null as decimal(20,0)) as user_id")
    df.write.parquet(str(tmp_path / "t"))
    text = planned(strategy.hourly_analysis(spark.read.parquet(str(tmp_path / "t"))))
    pushed = re.search(r"PushedFilters: \[[^\]]*\]", text).group()
    assert "GreaterThanOrEqual(normalized_event_time" in pushed and "LessThan(normalized_event_time" in pushed


def test_top_k_does_not_sort_everything(spark, small):
    for name in ("top_brands_volume", "preview_baseline_page", "unknown_brand_deep_dive"):
        assert "TakeOrderedAndProject" in planned(QUERIES[name](spark, small))


def test_only_needed_columns_are_read(spark, small):
    text = planned(QUERIES["grand_totals"](spark, small))
    assert "ReadSchema: struct<l_extendedprice:double>" in text


def test_hot_category_without_a_map_is_split(spark, tmp_path):
    """A third of all rows in one unmapped category: its shuffle partition is cut, the result whole."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 120_000, 1, 6).select(
            F.col("id").alias("order_id"),
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97 + 1).cast("decimal(23,0)").alias("category_id"),
            F.when(F.col("id") % 3 == 1, F.lit("known")).alias("category_code"),
        )
        filled = impute_category(rows)
        counts = {r.category_code: r["count"] for r in filled.groupBy("category_code").count().collect()}
        full = filled.select("order_id", "category_code")
        full.write.format("noop").mode("overwrite").save()
        text = executed(full)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert sum(counts.values()) == 120_000
    assert counts["unlabelled (ID: 0)"] == 40_000
    assert "skew=true" in text


def test_null_profile_of_the_view_is_one_scan_without_a_sort(spark, small):
    text = planned(QUERIES["null_profile_view"](spark, small))
    assert len(re.findall(r"FileScan parquet \[l_", text)) == 1
    assert "Window" not in text


def test_maps_of_the_view_look_up_no_orders(spark, small):
    text = planned(QUERIES["purchases_view"](spark, small))
    assert len(re.findall(r"FileScan parquet \[o_", text)) == 2
    assert len(re.findall(r"FileScan parquet \[l_", text)) == 4


def test_labelled_groups_do_not_meet_the_map(spark, small):
    """The filter on gaps sits below the join with the map."""
    plan = QUERIES["unlabelled_deep_dive"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("mapped_category_code")
    assert "StartsWith(category_code" in plan[join:]


def test_reports_are_named():
    assert set(REPORTS) >= set(EXPORTED)
    assert len(baseline.REPORTS) == 50


def test_maps_reduce_rows_by_hash_before_sorting_for_the_largest_text(spark, small):
    for name in ("category_map", "brand_map", "purchases_view"):
        lines = planned(QUERIES[name](spark, small)).splitlines()
        for i, line in enumerate(lines):
            if "Aggregate" in line and "partial_max" in line:
                assert any("HashAggregate" in below for below in lines[i + 1 : i + 4])
