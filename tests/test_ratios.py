"""Ratios are exact: compared with fractions, on random and on chosen values."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal, localcontext
from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tilltrail.functions import ratios as R


def expected(numerator: Decimal, denominator: Decimal, times: int = 1) -> Decimal | None:
    if denominator == 0:
        return None
    hundredths = Fraction(numerator) * times * 100 / Fraction(denominator)
    size = (abs(hundredths) * 2 + 1) // 2
    return Decimal(int(size if hundredths >= 0 else -size)).scaleb(-2)


amounts = st.integers(-(10**15), 10**15).map(lambda n: Decimal(n).scaleb(-2))
wholes = st.integers(1, 10**14).map(lambda n: Decimal(n).scaleb(-2))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(amounts, wholes), min_size=200, max_size=200))
def test_money_ratio(spark, pairs):
    df = spark.createDataFrame(pairs, "a decimal(28,2), b decimal(28,2)")
    for row in df.select("a", "b", R.exact_ratio("a", "b").alias("r")).collect():
        assert row.r == expected(row.a, row.b)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 10**12), st.integers(1, 10**12)), min_size=200, max_size=200))
def test_percent_of_counts(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    for row in df.select("a", "b", R.percent_of("a", "b").alias("r")).collect():
        assert row.r == expected(Decimal(row.a), Decimal(row.b), 100)


def test_ties_go_away_from_zero(spark):
    df = spark.createDataFrame([(Decimal("0.01"), 2), (Decimal("-0.01"), 2), (Decimal("0.05"), 10)], "a decimal(28,2), n long")
    assert [r[0] for r in df.select(R.order_value("a", "n")).collect()] == [
        Decimal("0.01"),
        Decimal("-0.01"),
        Decimal("0.01"),
    ]


def test_just_below_a_tie_is_not_rounded_twice(spark):
    # 0.00499999999999... : six digits first would give 0.005 and then 0.01.
    df = spark.createDataFrame([(Decimal("4999999.99"), Decimal("1000000000.00"))], "a decimal(28,2), b decimal(28,2)")
    assert df.select(R.exact_ratio("a", "b")).first()[0] == Decimal("0.00")
    with localcontext() as context:
        context.rounding = ROUND_HALF_UP
        twice = round(round(Decimal("4999999.99") / Decimal("1000000000.00"), 6), 2)
    assert twice == Decimal("0.01")


def test_zero_and_missing_denominators_give_null(spark):
    df = spark.createDataFrame([(Decimal(1), Decimal(0)), (Decimal(1), None), (None, Decimal(1))], "a decimal(28,2), b decimal(28,2)")
    assert [r[0] for r in df.select(R.exact_ratio("a", "b")).collect()] == [None, None, None]


def test_totals_of_100_terabytes_fit(spark):
    df = spark.createDataFrame(
        [(Decimal("30000000000000000.00"), Decimal("90000000000000000.00"), 3 * 10**11, 10**12)],
        "r decimal(28,2), tr decimal(28,2), v long, tv long",
    )
    row = df.select(R.money_percent_of("r", "tr"), R.efficiency_index("r", "tr", "v", "tv"), R.order_value("r", "v")).first()
    assert list(row) == [Decimal("33.33"), Decimal("1.11"), Decimal("100000.00")]
