"""Growth from month to month, where a month without sales counts as zero and not as absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.functions import columns as C
from tilltrail.functions import ratios as R
from tilltrail.operators import measures as M
from tilltrail.operators.imputation import Dimension, impute_groups
from tilltrail.plans.strategy import CLOCK

MONTHS = range(1, 13)


def monthly_growth(facts: DataFrame, dim: Dimension, year: int = S.REPORT_YEAR) -> DataFrame:
    """Twelve rows per label sold in the year: volume, revenue, revenue of the month before and growth in percent.

    January has no month before; growth is NULL where that earned nothing. All rows take part in filling labels, whatever
    their year, so one scan is grouped by key, text and month (0 for other years). The twelve months of a label
    are columns until the end, so the month before is beside each without a join or a window.
    """
    month = F.when(C.within_year(CLOCK, year), F.month(CLOCK)).otherwise(0)
    groups = facts.groupBy(dim.key, dim.value, month.alias("_month")).agg(*M.row_measures())
    filled = impute_groups(groups, dim).filter("_month > 0")

    def of_month(number: int, name: str, kind: str):
        return F.expr(f"cast(coalesce(sum(if(_month = {number}, {name}, 0)), 0) as {kind})").alias(f"{name}_{number}")

    labels = filled.groupBy(dim.value).agg(*[of_month(m, n, k) for m in MONTHS for n, k in (("vol", "bigint"), ("rev", R.MONEY))])
    calendar = F.array(*[F.struct(F.col(f"vol_{m}").alias("vol"), F.col(f"rev_{m}").alias("rev")) for m in MONTHS])
    months = labels.select(dim.value, calendar.alias("_year")).select(dim.value, "_year", F.posexplode("_year").alias("_at", "_now"))
    before = F.when(F.col("_at") > 0, F.get("_year", F.col("_at") - 1)["rev"])
    return months.select(dim.value, (F.col("_at") + 1).alias("month"), "_now.vol", "_now.rev", before.alias("before")).select(
        dim.value,
        "month",
        F.col("vol").alias("monthly_volume"),
        M.revenue().alias("monthly_revenue"),
        M.revenue("before").alias("revenue_before"),
        R.exact_ratio("(rev - before)", "before", 100).alias("growth_pct"),
    )
