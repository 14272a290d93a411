"""How revenue is spread over categories or brands: running shares, the few that earn most of it, the Gini coefficient.

Labels number as many as products where products lack a brand, so no window sees them all: they are ranked in ranges and added
up in blocks (see ``ordering``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilltrail.functions import ratios as R
from tilltrail.operators import measures as M
from tilltrail.operators.imputation import Dimension
from tilltrail.operators.ordering import placed, running
from tilltrail.plans.strategy import filled_groups
from tilltrail.session import stored

CORE_PERCENT = 80
WIDE = "decimal(38,2)"


def ranked_revenue(facts: DataFrame, dim: Dimension) -> DataFrame:
    """Each label with its place by falling revenue (ties by label) and the revenue up to and with it.

    A label without a priced row earns nothing. Stored, since all that follows reads it more than once.
    """
    labels = filled_groups(facts, dim).groupBy(dim.value).agg(*M.merged_measures())
    earned = labels.select(dim.value, "vol", F.coalesce("rev", F.lit(0)).cast(R.MONEY).alias("rev"))
    ranked = placed(earned, [F.desc("rev"), F.col(dim.value).asc_nulls_last()], "place", "ranked-revenue")
    return stored(running(ranked, "place", {"running_rev": "rev"}), "running-revenue")[0]


def _with_total(ranked: DataFrame) -> DataFrame:
    total = ranked.agg(F.sum("rev").cast(WIDE).alias("rev"), F.count(F.lit(1)).alias("labels"))
    return ranked.withColumn(M.TOTAL, total.select(F.struct("rev", "labels")).scalar())


def _is_core(percent: int) -> str:
    """Part of the fewest labels, taken by falling revenue, that reach the percentage."""
    return f"(running_rev - rev) * 100 < {M.TOTAL}.rev * {percent}"


def concentration(facts: DataFrame, dim: Dimension, percent: int = CORE_PERCENT) -> DataFrame:
    """Every label with rank, revenue, running revenue and share, and whether it is one of the few that make ``percent``."""
    return _with_total(ranked_revenue(facts, dim)).select(
        (F.col("place") + 1).alias("revenue_rank"),
        dim.value,
        dim.status().alias(dim.status_column),
        F.col("vol").alias("transaction_volume"),
        M.revenue().alias("total_revenue"),
        F.col("running_rev").cast("decimal(28,2)").alias("running_revenue"),
        R.money_percent_of("running_rev", f"{M.TOTAL}.rev").alias("running_share_pct"),
        F.expr(_is_core(percent)).alias("is_core"),
    )


def concentration_summary(facts: DataFrame, dim: Dimension, percent: int = CORE_PERCENT) -> DataFrame:
    """One row: labels, revenue, how many labels make ``percent``, what the largest and the remaining ones earn, Gini in percent.

    With revenue x at places 0.. of n labels by falling revenue, Gini is ``((n-1) sum(x) - 2 sum(place x)) / (n sum(x))``, taken as
    one fraction. It is NULL without revenue. No labels give a row of zeros and NULL shares.
    """
    ranked = _with_total(ranked_revenue(facts, dim))
    core = F.expr(_is_core(percent))
    sums = ranked.agg(
        F.count(F.lit(1)).alias("labels"),
        F.coalesce(F.sum("rev"), F.lit(0)).cast(WIDE).alias("rev"),
        F.count_if(core).alias("core_labels"),
        F.coalesce(F.sum(F.when(~core, F.col("rev"))), F.lit(0)).cast(WIDE).alias("tail_rev"),
        F.coalesce(F.max("rev"), F.lit(0)).cast(WIDE).alias("top_rev"),
        F.coalesce(F.sum(F.col("place").cast("decimal(20,0)") * F.col("rev")), F.lit(0)).cast(WIDE).alias("weighted"),
    )
    cents = "cast({} * 100 as decimal(36,0))"
    gini = R.exact_ratio(cents.format("((labels - 1) * rev - 2 * weighted)"), cents.format("labels * rev"), 100)
    return sums.select(
        "labels",
        M.revenue().alias("total_revenue"),
        "core_labels",
        (F.col("labels") - F.col("core_labels")).alias("tail_labels"),
        R.money_percent_of("top_rev", "rev").alias("top_share_pct"),
        R.money_percent_of("tail_rev", "rev").alias("tail_share_pct"),
        gini.alias("gini_pct"),
    )
