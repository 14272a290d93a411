"""Rules that decide whether results match, each on a few rows made for it."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from tilltrail import schema as S
from tilltrail.functions import columns as C
from tilltrail.operators import cleaning, profiling, rollups
from tilltrail.operators.imputation import BRAND, CATEGORY, impute_both, impute_brand, impute_category, value_map
from tilltrail.operators.measures import revenue_sum
from tilltrail.plans import baseline, strategy, views

D = Decimal


# --- users --------------------------------------------------------------------------------------


def test_guests_are_kept_and_count_no_users(sales):
    report = rows_of(strategy.user_segmentation(sales({"user": None}, {"user": None}, {"user": 7})), "user_type")
    assert report["anonymous"]["transaction_volume"] == 2
    assert report["anonymous"]["unique_registered_users"] == 0
    assert report["registered"]["unique_registered_users"] == 1


def test_unlabelled_revenue_share(sales):
    rows = sales({"code": None, "category_id": 5, "price": "25.00"}, {"code": "a.b", "category_id": 6, "price": "75.00"})
    assert strategy.user_segmentation(rows).first().percent_unlabelled_revenue == D("25.00")


# --- clock --------------------------------------------------------------------------------------


def test_eight_hours_over_midnight_leave_the_year(spark):
    raw = spark.sql("select timestamp_ntz'2020-01-01 03:00:00' as event_time, 1 as x")
    moved = cleaning.normalize_event_time(raw)
    assert moved.first().normalized_event_time == dt.datetime(2019, 12, 31, 19)
    assert cleaning.in_year(moved, 2020, "normalized_event_time").count() == 0
    assert cleaning.in_year(moved, 2019, "normalized_event_time").count() == 1


@pytest.mark.parametrize("zone", ["UTC", "Asia/Singapore", "America/New_York"])
def test_instants_read_alike_in_every_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        raw = spark.sql("select timestamp'2020-04-24 11:50:39 UTC' as event_time")
        row = cleaning.add_calendar(cleaning.normalize_event_time(raw), "normalized_event_time").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row.event_time == dt.datetime(2020, 4, 24, 19, 50, 39)
    assert row.normalized_event_time == dt.datetime(2020, 4, 24, 11, 50, 39)
    assert (row.year, row.month, row.day, row.weekday, row.hour) == (2020, 4, 24, "Friday", 11)


def test_weekdays_are_trimmed_or_padded(spark):
    days = spark.sql("select timestamp_ntz'2020-06-01 00:00:00' + make_dt_interval(id) as at from range(7)")
    plain = [r.weekday for r in cleaning.add_calendar(days, "at").orderBy("at").collect()]
    padded = [r.weekday for r in cleaning.add_calendar(days, "at", padded=True).orderBy("at").collect()]
    assert plain == S.WEEKDAYS
    assert padded == [name.ljust(9) for name in S.WEEKDAYS]


def test_time_windows_at_their_edges(spark):
    hours = spark.range(24).select(F.col("id").cast("int").alias("h"))
    label = {r.h: r.w[:2] for r in hours.select("h", C.time_window(F.col("h")).alias("w")).collect()}
    edges = {0: "04", 4: "04", 5: "01", 10: "01", 11: "02", 16: "02", 17: "03", 22: "03", 23: "04"}
    assert {h: label[h] for h in edges} == edges


def test_epoch_rows_count_outside_time_reports_only(sales):
    rows = sales({"at": dt.datetime(1970, 1, 1), "price": "3.00"}, {"price": "1.00"})
    assert strategy.category_master(rows).first().total_vol == 2
    assert [r.monthly_volume for r in strategy.monthly_seasonality(rows).collect()] == [1]
    scored = rows_of(strategy.scored_segments(rows), "dimension")
    # The window holds one of two rows and is set against both.
    assert scored["Time Window"]["vol_share_pct"] == D("50.00")
    assert scored["Time Window"]["rev_share_pct"] == D("25.00")


# --- gaps ---------------------------------------------------------------------------------------


GAPS = (
    {"code": None, "category_id": 1},
    {"code": "a.low", "category_id": 1},
    {"code": "z.high", "category_id": 1},
    {"code": "m.mid", "category_id": 1},
    {"code": None, "category_id": 2268105388421284352},
    {"brand": None, "product": 8},
    {"brand": "acme", "product": 8},
    {"brand": None, "product": 9},
)


def test_largest_text_fills_and_the_rest_is_labelled(sales):
    filled = impute_both(sales(*GAPS))
    assert {r.category_code for r in filled.collect()} >= {"z.high", "unlabelled (ID: 2268105388421284352)"}
    assert {r.brand for r in filled.collect()} == {"acme", "unknown (Prod: 9)"}
    assert filled.count() == len(GAPS)


def test_most_frequent_text_is_an_option(sales):
    rows = sales({"code": "b"}, {"code": "b"}, {"code": "z"}, {"code": "y", "category_id": 2}, {"code": "x", "category_id": 2})
    by_mode = rows_of(value_map(rows, CATEGORY, "mode"), "category_id")
    assert by_mode[D(1)]["mapped_category_code"] == "b"
    assert by_mode[D(2)]["mapped_category_code"] == "y"
    with pytest.raises(ValueError):
        value_map(rows, CATEGORY, "first")


def test_maps_may_come_from_other_rows(sales):
    rows, raw = sales({"code": None}), sales({"code": "from.raw"})
    assert impute_category(rows, raw).first().category_code == "from.raw"
    assert impute_brand(sales({"brand": None}), sales({"brand": "x"})).first().brand == "x"


def test_no_known_text_at_all(sales):
    rows = sales({"code": None, "brand": None}, {"code": None, "brand": None, "category_id": 4})
    filled = impute_both(rows)
    assert filled.filter(CATEGORY.is_gap() & BRAND.is_gap()).count() == 2
    assert profiling.gap_row_count(rows, CATEGORY, "n").first().n == 2
    assert profiling.gap_row_count(sales({}), CATEGORY, "n").first().n == 0


def test_reports_fill_like_the_view(sales):
    rows = sales(*GAPS)
    filled = views.purchases_view(rows)
    for report in (strategy.category_master, strategy.brand_master, strategy.strategy_portfolio):
        assert sorted(map(str, report(rows).collect())) == sorted(map(str, report(filled).collect()))


def test_a_brand_called_unknown_counts_as_unknown_and_case_matters(sales):
    rows = sales({"brand": "unknown pleasures", "product": 1}, {"brand": "Unknown", "product": 2})
    status = {k: r["brand_status"] for k, r in rows_of(strategy.brand_master(rows), "brand").items()}
    assert status == {"unknown pleasures": "Unknown", "Unknown": "Known"}


def test_status_texts(sales):
    rows = sales({"code": None, "category_id": 3}, {})
    assert {r.category_status for r in strategy.unlabelled_share_of_wallet(rows).collect()} == {"Unlabelled", "labelled"}
    assert {r.label_status for r in strategy.category_master(rows).collect()} == {"Unlabelled", "Labelled"}


def test_anchor_brand_is_the_most_frequent_lowest_on_ties(sales):
    hidden = {"code": None, "category_id": 3}
    rows = sales(
        {**hidden, "brand": "b", "product": 1},
        {**hidden, "brand": "a", "product": 2},
        {**hidden, "brand": None, "product": 2},
        {**hidden, "brand": "c", "product": 3},
        {**hidden, "brand": "b", "product": 1},
        {"code": "x.y", "category_id": 4, "brand": "c", "product": 3},
        {"code": "x.y", "category_id": 4, "brand": "c", "product": 3},
    )
    row = strategy.unlabelled_deep_dive(rows).first()
    assert (row.category_code, row.transaction_volume, row.anchor_brand) == ("unlabelled (ID: 3)", 5, "a")


def test_a_literal_label_joins_the_group_it_names(sales):
    rows = sales(
        {"code": None, "category_id": 3, "brand": "a", "product": 1},
        {"code": "unlabelled (ID: 3)", "category_id": 4, "brand": "b", "product": 2},
        {"code": "unlabelled (ID: 3)", "category_id": 4, "brand": "b", "product": 2},
    )
    [row] = strategy.unlabelled_deep_dive(rows).collect()
    assert (row.transaction_volume, row.anchor_brand, row.share_of_hidden_revenue) == (3, "b", D("100.00"))


def test_deep_dives_share_before_the_limit(sales):
    rows = sales(*[{"brand": None, "product": n, "price": f"{n}.00"} for n in range(1, 5)])
    top = strategy.unknown_brand_deep_dive(rows, k=2).collect()
    assert [r.brand for r in top] == ["unknown (Prod: 4)", "unknown (Prod: 3)"]
    assert [r.share_of_unknown_revenue for r in top] == [D("40.00"), D("30.00")]


# --- money --------------------------------------------------------------------------------------


def test_missing_price_counts_as_volume_but_not_in_the_average(sales):
    row = strategy.category_master(sales({"user": 1, "price": None}, {"user": 1, "price": "4.00"})).first()
    assert (row.total_vol, row.total_rev, row.reg_aov) == (2, D("4.00"), D("4.00"))


def test_empty_segment_gives_null_and_does_not_raise(sales):
    row = strategy.category_master(sales({"user": None})).first()
    assert (row.reg_vol, row.reg_rev, row.reg_aov, row.reg_vol_share_pct, row.reg_rev_share_pct) == (0, D(0), None, None, None)


def test_only_missing_and_only_zero_prices(sales):
    nothing = strategy.user_segmentation(sales({"price": None})).first()
    assert (nothing.total_revenue, nothing.aov, nothing.revenue_percentage) == (None, None, None)
    free = strategy.user_segmentation(sales({"price": "0.00"})).first()
    assert (free.total_revenue, free.aov, free.revenue_percentage) == (D("0.00"), D("0.00"), None)


def test_revenue_sum_keeps_cents_and_signs(spark):
    prices = ["0.01", "-0.01", "999999.99", "-999999.99", "0.99", "-3.50", None, "0.10"]
    df = spark.createDataFrame([(None if p is None else D(p),) for p in prices], "price decimal(8,2)")
    assert df.agg(revenue_sum().alias("r")).first().r == D("-2.41")
    assert df.filter("price is null").agg(revenue_sum().alias("r")).first().r is None


def test_hourly_rating_uses_the_mean_of_hours(sales):
    at = lambda hour: dt.datetime(2020, 6, 1, hour)
    # Hours average 10 and 40: mean of hours 25. Rows average 16, so 20 would pass that one.
    rows = sales(*[{"at": at(1), "price": "10.00"}] * 4, {"at": at(2), "price": "40.00"}, {"at": at(3), "price": "20.00"})
    rating = {r.hour: r.efficiency_rating for r in strategy.hourly_analysis(rows).collect()}
    assert rating == {1: "Standard", 2: "⭐ Premium Window", 3: "Standard"}
    # All alike: none is above.
    same = strategy.hourly_analysis(sales({"at": at(1), "price": "1.01"}, {"at": at(2), "price": "1.01"}))
    assert {r.efficiency_rating for r in same.collect()} == {"Standard"}


def test_all_four_roles(sales):
    rows = sales(
        {"code": "star", "category_id": 1, "price": "90.00"},
        *[{"code": "cow", "category_id": 2, "price": "10.00"}] * 4,
        *[{"code": "tie", "category_id": 3, "price": "26.00"}] * 5,
    )
    roles = {k: r["strategic_role"] for k, r in rows_of(strategy.scored_segments(rows), "segment_name").items()}
    assert roles["star"] == "STAR (High Value & Efficient)"
    assert roles["cow"] == "CASH COW (High Volume Traffic)"
    assert roles["tie"] == "LONG TAIL / OPPORTUNITY"


def test_missing_prices_make_the_play_reachable(sales):
    # Overall value is 100 / 2 = 50 and 100 / 10 rows = 10 per row. "play" has 3 priced rows of 3.
    rows = sales(
        *[{"code": "play", "category_id": 1, "price": "20.00"}] * 3,
        *[{"code": "rest", "category_id": 2, "price": None}] * 6,
        {"code": "rest", "category_id": 2, "price": "40.00"},
    )
    roles = {k: r["strategic_role"] for k, r in rows_of(strategy.scored_segments(rows), "segment_name").items()}
    assert roles["play"] == "EFFICIENCY PLAY (Low AOV/High Share)"


def test_threshold_is_strict(sales):
    rows = sales(
        {"code": "half", "category_id": 1, "price": "1.00"},
        {"code": "more", "category_id": 2, "price": "1.01"},
        {"code": "big", "category_id": 3, "price": "197.99"},
    )
    names = {r.segment_name for r in strategy.strategy_portfolio(rows).filter("dimension = 'Category'").collect()}
    assert names == {"more", "big"}


def test_rows_without_category_id_stay_in_the_totals(spark, sales):
    rows = sales({"code": None, "price": "10.00"}, {"code": "a", "price": "30.00", "category_id": 2})
    rows = rows.withColumn("category_id", F.when(F.col("category_code").isNotNull(), F.col("category_id")))
    scored = rows_of(strategy.scored_segments(rows).filter("dimension = 'Category'"), "segment_name")
    assert scored["a"]["rev_share_pct"] == D("75.00")
    assert scored[None]["rev_share_pct"] == D("25.00")


# --- rankings -----------------------------------------------------------------------------------


def test_ties_at_the_limit_go_to_the_lowest_name(sales):
    rows = sales(*[{"brand": b} for b in ("d", "b", "c", "a", "d")])
    top = rollups.volume_by(rows, "brand", "n", "desc", 3).collect()
    assert [r.brand for r in top] == ["d", "a", "b"]
    assert [(r["rank"], r.brand) for r in rollups.top_brands_avg_price(rows, 2).collect()] == [(1, "d"), (2, "a")]


def test_missing_keys_rank_first_in_descending_order(sales):
    rows = sales({"brand": "a", "price": "2.00"}, {"brand": "b", "price": None})
    assert [r.brand for r in rollups.revenue_by(rows, "brand", "rev", "desc").collect()] == ["b", "a"]


def test_baseline_drops_incomplete_rows_and_pads(spark):
    raw = spark.sql(
        "select 1L as serial_number, cast(null as decimal(20,0)) as user_id, timestamp_ntz'2020-06-01 08:00:00' as event_time, "
        "cast(1 as decimal(20,0)) as order_id, cast(1 as decimal(20,0)) as product_id, cast(1 as decimal(23,0)) as category_id, "
        "code as category_code, name as brand, cast(1 as decimal(8,2)) as price "
        "from values ('a', 'b'), (null, 'b'), ('a', null), (null, null) as t(code, name)"
    )
    view = views.baseline_view(raw)
    assert view.columns == S.BASELINE_COLUMNS
    [row] = view.collect()
    assert (row.weekday, row.hour) == ("Monday   ", 8)
    assert baseline.run(view, baseline.REPORTS["null_user_count"]).first().null_users == 1


def test_conflicts(sales):
    rows = sales({"code": "a"}, {"code": "b"}, {"code": None}, {"code": "a", "category_id": 2})
    found = profiling.mapping_conflicts(rows, "category_id", "category_code", "n").collect()
    assert [(r.category_id, r.n) for r in found] == [(D(1), 2)]


# --- ids ----------------------------------------------------------------------------------------


def test_surrogate_ids_are_dense_over_gaps_and_ranges(spark):
    numbers = [-(10**13), -7, 5, 999, 2**21, 2**21 + 1, 2**42, 2**42 + 2**21, 10**18]
    df = spark.createDataFrame([(n,) for n in numbers], "serial_number long").repartition(3)
    ids = {r.serial_number: r.id for r in cleaning.add_surrogate_id(df).collect()}
    assert ids == {n: i for i, n in enumerate(numbers, 1)}


def test_surrogate_ids_of_missing_sparse_and_repeated_numbers(spark):
    sparse = [i * 10**9 for i in range(300)]
    rows = [(n, i) for i, n in enumerate([*sparse, *[None] * 200, *[5 * 10**9] * 20])]
    df = spark.createDataFrame(rows, "serial_number long, n int").repartition(4)
    found = cleaning.add_surrogate_id(df).collect()
    assert sorted(r.id for r in found) == list(range(1, len(rows) + 1))
    assert min(r.id for r in found if r.serial_number is None) == 321
    ordered = [r.serial_number for r in sorted(found, key=lambda r: r.id) if r.serial_number is not None]
    assert ordered == sorted(ordered)


def test_rows_without_a_key_take_no_text_from_each_other(spark, sales):
    """Reports by groups and the row view agree where NULL keys have a text and where they have none."""
    rows = sales(
        {"code": "a.b", "brand": "x", "price": "10.00"},
        {"code": None, "brand": None, "price": "90.00"},
        {"code": "a.c", "brand": "y", "price": "1.00", "category_id": 2},
        {"code": None, "brand": None, "price": "2.00", "category_id": 2},
    )
    first = F.col("category_id") == 1
    rows = rows.withColumns(
        {c: F.when(~first, F.col(c)).cast(rows.schema[c].dataType) for c in ("category_id", "product_id")}
    )
    for dim, segments in ((CATEGORY, strategy.category_segments), (BRAND, strategy.brand_segments)):
        view = views.purchases_view(rows).groupBy(dim.value).agg(F.sum("price").alias("revenue")).collect()
        expected = {r[dim.value]: r.revenue for r in view}
        assert expected[None] == 90
        assert {r.segment_name: r.rev for r in segments(rows).collect()} == expected
    assert profiling.null_profile_of_view(
        cleaning.add_arrival_id(rows).withColumns({"order_id": F.lit(1), "event_time": F.col("normalized_event_time")})
    ).select("category_code", "brand").first() == (1, 1)


def test_repeated_serials_and_two_brands_of_a_product_are_found(spark, sales):
    serials = spark.createDataFrame([(1,), (2,), (2,)], "serial_number long")
    assert profiling.serial_uniqueness(serials).first() == (2, 3)
    rows = sales({"brand": "a"}, {"brand": "b"}, {"brand": "b", "product": 2}, {"brand": None, "product": 2})
    found = profiling.mapping_conflicts(rows, "product_id", "brand", "n").collect()
    assert [(r.product_id, r.n) for r in found] == [(D(1), 2)]


def test_arrival_ids_are_unique(spark):
    df = cleaning.add_arrival_id(spark.range(1000).repartition(7))
    assert df.select("id").distinct().count() == 1000
