"""Distinct counts from sketches, summaries over appends, concentration, heavy gaps: on made rows, against plain Python."""

from __future__ import annotations

import datetime as dt
import random
import shutil
from collections import defaultdict
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.operators import heavy, ordering
from tilltrail.operators import measures as M
from tilltrail.operators.cleaning import clean_purchases
from tilltrail.operators.imputation import BRAND, CATEGORY
from tilltrail.plans import concentration, distincts, enrichment, growth, strategy
from tilltrail.plans.incremental import SummaryStore
from tilltrail.plans.registry import STORED
from tilltrail.sources.samples import sample_purchases


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- distinct counts ----------------------------------------------------------------------------


def buyers(spark, n):
    """n rows over 40 days: members 1.. and guests, 5,000 products, 5 categories."""
    return spark.range(n).selectExpr(
        "timestamp_ntz'2020-01-01 00:30:00' + make_dt_interval(0, cast(id % 960 as int)) as normalized_event_time",
        "cast(if(id % 3 = 0, null, id % 70001) as decimal(20,0)) as user_id",
        "cast(id % 5003 as decimal(20,0)) as product_id",
        "cast(if(id % 7 = 0, null, id % 5) as decimal(23,0)) as category_id",
    )


def test_estimates_of_any_period_come_from_stored_hours(spark, tmp_path):
    facts = buyers(spark, 200_000)
    distincts.hour_sketches(facts).write.parquet(str(tmp_path / "sketches"))
    sketches = spark.read.parquet(str(tmp_path / "sketches"))
    for by in ([], [F.col("user_type")], [F.month(strategy.CLOCK).alias("month"), F.col("user_type")]):
        found = distincts.checked_estimates(facts, sketches, *by) if by else None
        if by:
            rows = found.collect()
            assert rows and all(r[f"{name}_within"] for r in rows for name in distincts.COUNTED.values())
    week = sketches.filter("normalized_event_time < timestamp_ntz'2020-01-08 00:00:00'")
    estimated = distincts.estimates(week, "user_type")
    assert "sketches" in planned(estimated) and "Range" not in planned(estimated)
    exact = facts.filter("normalized_event_time < timestamp_ntz'2020-01-08 00:00:00' and user_id is not null")
    members = [r for r in estimated.collect() if r.user_type == S.REGISTERED][0].unique_registered_users
    assert abs(members - exact.select("user_id").distinct().count()) < 5 * distincts.standard_error() * members


def test_guests_are_no_users_and_merged_parts_are_as_near(spark):
    facts = buyers(spark, 20_000)
    sketches = distincts.hour_sketches(facts)
    [guests] = distincts.estimates(sketches, "user_type").filter(f"user_type = '{S.ANONYMOUS}'").collect()
    assert guests.unique_registered_users == 0 and guests.category_diversity == 5
    halves = distincts.hour_sketches(facts.filter("product_id < 2000")).unionByName(
        distincts.hour_sketches(facts.filter("product_id >= 2000"))
    )
    # An estimate depends on how its sketches came together, but is as near either way.
    for parts in (sketches, halves):
        for row in distincts.estimates(parts, "user_type").collect():
            assert abs(row.product_diversity - 5003) <= 4 * distincts.standard_error() * 5003
            assert row.category_diversity == 5


# --- summaries over appends -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    """The sample's clean rows as four stored batches; the first holds gaps, for which later ones bring texts."""
    folder = tmp_path_factory.mktemp("batches")
    clean = clean_purchases(sample_purchases(spark, "/root/testdata/sf0.001", STORED)).drop("id")
    gap = (F.col("brand").isNull() | F.col("category_code").isNull()) & (F.col("order_id") % 2 == 0)
    part = F.when(gap, 0).otherwise(1 + F.least((F.col("order_id") % 4).cast("int"), F.lit(2)))
    for i in range(4):
        clean.filter(part == i).write.parquet(str(folder / str(i)))
    return folder


def equal_reports(store, clean):
    for name, report in store.reports().items():
        assert report.collect() == strategy.EXPORTS[name](clean).collect(), name
    for dim in (CATEGORY, BRAND):
        totals = strategy.by_text_and_user(clean, dim).collect()
        assert sorted(map(str, store.label_totals(dim).collect())) == sorted(map(str, totals))


def test_reports_after_each_append_equal_a_full_run_and_read_no_earlier_facts(spark, batches, tmp_path):
    mine = tmp_path / "facts"
    shutil.copytree(batches, mine)
    store = SummaryStore(spark, str(tmp_path / "store"))
    for i in range(4):
        assert store.append(spark.read.parquet(str(mine / str(i))), f"b{i}")
        # Nothing that follows can read this batch's facts again.
        shutil.rmtree(mine / str(i))
        so_far = spark.read.parquet(*[str(batches / str(j)) for j in range(i + 1)])
        if i in (1, 3):
            equal_reports(store, so_far)
    for report in store.reports().values():
        assert str(mine) not in planned(report) and str(batches) not in planned(report)
    assert store.moves(CATEGORY).count() > 0
    store.compact("all")
    assert store.batches() == ["all"]
    store.remove_replaced()
    equal_reports(store, so_far)
    assert not store.append(so_far, "b0"), "a batch that was compacted is not appended again"


def test_a_batch_counts_only_when_committed_and_only_once(spark, sales, tmp_path):
    store = SummaryStore(spark, str(tmp_path / "store"))
    rows = sales({"price": "10.00"}, {"price": "5.00", "user": 3})
    with pytest.raises(ValueError, match="no batch"):
        store.products()
    assert store.append(rows, "one") and not store.append(rows, "one")
    # A batch that failed before its commit: its tables are there but not read.
    store._write("products", "two", store.products())
    assert store.products().agg(F.sum("vol")).first()[0] == 2
    assert store.append(rows, "two")
    assert store.products().agg(F.sum("vol")).first()[0] == 4


def test_a_larger_text_moves_only_the_rows_it_fills(spark, sales, tmp_path):
    store = SummaryStore(spark, str(tmp_path / "store"))
    first = sales(
        {"product": 1, "brand": None, "price": "1.00"}, {"product": 1, "brand": "b", "price": "2.00"}, {"product": 2, "brand": None, "price": "4.00"}
    )
    store.append(first, "one")
    assert store.moves(BRAND).count() == 0
    store.append(sales({"product": 1, "brand": "c", "price": "8.00"}, {"product": 1, "brand": None, "price": "16.00"}), "two")
    [move] = store.moves(BRAND).collect()
    assert (move.batch, move.product_id, move.from_label, move.to_label, move.vol, move.rev) == ("two", 1, "b", "c", 1, D("1.00"))
    totals = {r.brand: (r.vol, r.rev) for r in store.label_totals(BRAND).collect()}
    assert totals == {"b": (1, D("2.00")), "c": (3, D("25.00")), "unknown (Prod: 2)": (1, D("4.00"))}
    store.append(sales({"product": 2, "brand": "a", "price": "0.00"}), "three")
    store.append(sales({"product": 1, "brand": "a", "price": None}), "four")
    totals = {r.brand: (r.vol, r.rev, r.priced) for r in store.label_totals(BRAND).collect()}
    assert totals == {"b": (1, D("2.00"), 1), "c": (3, D("25.00"), 3), "a": (3, D("4.00"), 2)}


# --- concentration --------------------------------------------------------------------------------


def brute_concentration(revenue, percent=80):
    ranked = sorted(revenue.items(), key=lambda kv: (-kv[1], kv[0]))
    total, run, core = sum(revenue.values()), D(0), 0
    rows = []
    for i, (label, rev) in enumerate(ranked, 1):
        is_core = run * 100 < total * percent
        run, core = run + rev, core + is_core
        rows.append((i, label, rev, run, is_core))
    ascending = [rev for _, rev in reversed(ranked)]
    n = len(ascending)
    gini = (2 * sum(i * x for i, x in enumerate(ascending, 1)) / (n * total) - D(n + 1) / n) * 100 if total else None
    return rows, core, gini


@pytest.mark.parametrize("seed", [1, 2])
def test_running_shares_and_gini_of_random_brands(spark, sales, monkeypatch, seed):
    monkeypatch.setattr(ordering, "BLOCK_BITS", 2)
    rng = random.Random(seed)
    rows, revenue = [], defaultdict(D)
    for _ in range(300):
        brand, price = f"b{rng.randrange(40):02d}", D(rng.choice([0, 1, 5, 100, 4000]))
        rows.append({"brand": brand, "price": str(price)})
        revenue[brand] += price
    expected, core, gini = brute_concentration(revenue)
    facts = sales(*rows)
    found = concentration.concentration(facts, BRAND).orderBy("revenue_rank").collect()
    assert [(r.revenue_rank, r.brand, r.total_revenue, r.running_revenue, r.is_core) for r in found] == expected
    [summary] = concentration.concentration_summary(facts, BRAND).collect()
    assert (summary.labels, summary.core_labels, summary.tail_labels) == (len(revenue), core, len(revenue) - core)
    assert abs(summary.gini_pct - gini) <= D("0.005001")


def test_concentration_without_revenue_and_without_rows(spark, sales):
    unpriced = sales({"brand": "a", "price": None}, {"brand": "b", "price": "0.00"})
    [summary] = concentration.concentration_summary(unpriced, BRAND).collect()
    assert (summary.labels, summary.total_revenue, summary.core_labels, summary.gini_pct) == (2, 0, 0, None)
    nothing = unpriced.limit(0)
    assert concentration.concentration(nothing, BRAND).collect() == []
    [summary] = concentration.concentration_summary(nothing, BRAND).collect()
    assert (summary.labels, summary.top_share_pct, summary.gini_pct) == (0, None, None)


def test_one_brand_and_equal_brands(spark, sales):
    [one] = concentration.concentration_summary(sales({"brand": "a", "price": "3.00"}), BRAND).collect()
    assert (one.labels, one.core_labels, one.gini_pct, one.top_share_pct) == (1, 1, 0, 100)
    [same] = concentration.concentration_summary(sales(*[{"brand": f"b{i}"} for i in range(10)]), BRAND).collect()
    assert (same.core_labels, same.gini_pct) == (8, 0)


# --- heavy gaps -----------------------------------------------------------------------------------


@pytest.mark.parametrize("counters", [2, 64, 1 << 14])
def test_no_heavy_key_is_lost_and_no_light_one_kept(spark, monkeypatch, counters):
    """Also with so few counters that most keys share one with a heavy key."""
    rng = random.Random(counters)
    rows = [(rng.randrange(2000), D(rng.randrange(10))) for _ in range(4000)] + [(k, D(300)) for k in (5, 5, 77)] + [(9, D(-50)), (9, D(400)), (None, D(500))]
    df = spark.createDataFrame(rows, "k int, w decimal(8,2)")
    sums = defaultdict(D)
    for k, w in rows:
        sums[k] += w
    total = sum(sums.values())
    expected = {k: w for k, w in sums.items() if k is not None and w * 100 >= total * D("1.2")}
    found = heavy.heavy_keys(df, "k", F.col("w"), [F.count(F.lit(1)).alias("n")], "1.2", counters)
    assert {r.k: r.weight for r in found.collect()} == expected and expected


def test_counters_are_of_fixed_number(spark):
    """What tasks hand over before the exact count are counters, not keys."""
    df = spark.range(0, 100_000, 1, 4).select(F.col("id").alias("k"), F.lit(1).cast("decimal(8,2)").alias("w"))
    found = heavy.heavy_keys(df, "k", F.col("w"), [], "0.001")
    assert found.count() == 100_000
    assert heavy.heavy_keys(df, "k", F.col("w"), [], "0.0011", 1 << 14).count() == 0
    text = planned(heavy.heavy_keys(df, "k", F.col("w"), [], "5"))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text


def test_no_rows_or_no_weight_has_no_heavy_keys(spark):
    df = spark.createDataFrame([(1, D(0)), (2, None)], "k int, w decimal(8,2)")
    assert heavy.heavy_keys(df, "k", F.col("w"), [], "1").collect() == []
    assert heavy.heavy_keys(df.limit(0), "k", F.col("w"), [], "1").collect() == []


def test_heavy_gaps_tell_what_the_map_recovers(spark, sales):
    facts = sales(
        {"product": 1, "brand": None, "price": "60.00"},
        {"product": 1, "brand": "a", "price": "1.00"},
        {"product": 2, "brand": None, "price": "39.50"},
        {"product": 3, "brand": None, "price": "0.50"},
        {"product": 4, "brand": "z", "price": "900.00"},
    )
    found = {r.product_id: r for r in enrichment.heavy_gaps(facts, BRAND, "1").collect()}
    assert set(found) == {1, 2}
    assert (found[1].label, found[1].is_recoverable, found[1].share_of_gap_revenue) == ("a", True, D("60.00"))
    assert (found[2].label, found[2].is_recoverable, found[2].total_revenue) == ("unknown (Prod: 2)", False, D("39.50"))


def test_measures_of_a_store_are_exact_for_large_sums(spark, sales, tmp_path):
    rows = sales(*[{"price": "999999.99"}] * 50)
    store = SummaryStore(spark, str(tmp_path / "store"))
    store.append(rows, "a")
    store.append(rows, "b")
    [hour] = store.hours().collect()
    assert (hour.vol, hour.rev, hour.priced) == (100, D("99999999.00"), 100)
    assert set(M.MEASURES) <= set(hour.asDict()) and hour[strategy.CLOCK] == dt.datetime(2020, 6, 1, 12)


def test_months_without_sales_count_as_zero(spark, sales):
    at = lambda month, year=2020: dt.datetime(year, month, 5, 12)
    facts = sales(
        {"at": at(1), "price": "10.00"}, {"at": at(2), "price": "15.00"}, {"at": at(4), "price": "3.00"}, {"at": at(5), "price": None},
        {"at": at(3, 2019), "price": "99.00"}, {"at": at(2), "code": None, "category_id": 2}, {"at": at(7, 2021), "code": "x.late", "category_id": 2},
    )
    found = growth.monthly_growth(facts, CATEGORY)
    rows = {(r.category_code, r.month): (r.monthly_volume, r.monthly_revenue, r.revenue_before, r.growth_pct) for r in found.collect()}
    assert len(rows) == 24 and {code for code, _ in rows} == {"c.one", "x.late"}
    assert rows["c.one", 1] == (1, D("10.00"), None, None)
    assert rows["c.one", 2] == (1, D("15.00"), D("10.00"), D("50.00"))
    assert rows["c.one", 3] == (0, D("0.00"), D("15.00"), D("-100.00"))
    assert rows["c.one", 4] == (1, D("3.00"), D("0.00"), None)
    assert rows["c.one", 5] == (1, D("0.00"), D("3.00"), D("-100.00"))
    assert rows["x.late", 2][:2] == (1, D("1.00"))
    text = planned(found)
    assert "Join" not in text
