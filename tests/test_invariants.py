"""What must hold on any data, checked on the sample records."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.operators import profiling
from tilltrail.operators.cleaning import clean_purchases
from tilltrail.operators.imputation import BRAND, CATEGORY
from tilltrail.plans import strategy, views
from tilltrail.sources.samples import sample_purchases


@pytest.fixture(scope="module")
def clean(spark, small):
    return clean_purchases(sample_purchases(spark, small), with_id=True).cache()


def test_view_keeps_every_row_and_all_revenue(clean):
    view = views.purchases_view(clean)
    assert view.columns == S.VIEW_COLUMNS
    total = [F.count(F.lit(1)), F.sum("price"), F.count_distinct("id")]
    assert view.agg(*total).first() == clean.agg(*total).first()


def test_view_has_gaps_in_users_only(clean):
    profile = profiling.null_profile(views.purchases_view(clean), S.VIEW_COLUMNS).first().asDict()
    assert {name for name, missing in profile.items() if missing} == {"user_id"}


@pytest.mark.parametrize(
    "report, within, shares",
    [
        (strategy.monthly_seasonality, None, ["monthly_volume_pct", "monthly_revenue_pct"]),
        (strategy.monthly_seasonality, "month", ["volume_within_month_pct", "revenue_within_month_pct"]),
        (strategy.weekday_rhythm, "weekday", ["volume_share_within_day_pct", "revenue_share_within_day_pct"]),
        (strategy.payday_analysis, None, ["volume_pct", "revenue_pct"]),
        (strategy.hourly_analysis, "user_type", ["hourly_volume_share"]),
        (strategy.category_by_user_type, "user_type", ["vol_share_pct", "rev_share_pct"]),
        (strategy.brand_by_user_type, "user_type", ["vol_share_pct", "rev_share_pct"]),
        (strategy.brand_master, None, ["anon_vol_share_pct", "reg_rev_share_pct", "total_rev_share_pct"]),
        (strategy.category_master, None, ["anon_rev_share_pct", "reg_vol_share_pct", "total_vol_share_pct"]),
        (strategy.unknown_share_of_wallet, None, ["anon_vol_share_pct", "reg_rev_share_pct"]),
    ],
)
def test_shares_add_up(clean, report, within, shares):
    keys = [within] if within else []
    sums = report(clean).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in shares])
    for row in sums.collect():
        for share in shares:
            assert abs(row[share] - 100) <= Decimal("0.01") * row.n


def test_categories_and_brands_hold_the_same_totals(clean):
    totals = strategy.grand_totals(clean).first()
    for report in (strategy.category_segments, strategy.brand_segments):
        assert report(clean).agg(F.sum("vol"), F.sum("rev")).first()[:] == (totals.total_vol, totals.total_rev)


def test_roles_follow_the_index(clean):
    for row in strategy.scored_segments(clean).collect():
        if row.strategic_role.startswith("STAR"):
            assert row.efficiency_index >= 1
        if row.strategic_role.startswith("CASH COW"):
            assert row.efficiency_index <= 1


def test_side_by_side_agrees_with_by_user_type(clean):
    for dim, sides, split in (
        (CATEGORY, strategy.category_side_by_side, strategy.category_by_user_type),
        (BRAND, strategy.brand_side_by_side, strategy.brand_by_user_type),
    ):
        guests = {r[dim.value]: r for r in split(clean).filter("user_type = 'anonymous'").collect()}
        for row in sides(clean).collect():
            guest = guests.get(row[dim.value])
            assert row.anon_vol == (guest.transaction_volume if guest else 0)
            assert row.anon_aov == (guest.aov if guest else None)
