"""Where missing labels weigh most, so that enrichment can begin there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilltrail.functions import ratios as R
from tilltrail.operators import measures as M
from tilltrail.operators.heavy import heavy_keys
from tilltrail.operators.imputation import Dimension


def heavy_gaps(facts: DataFrame, dim: Dimension, percent: str) -> DataFrame:
    """Keys that hold at least ``percent`` of the revenue recorded without a text, and whether the map recovers them.

    Columns: the key, ``label`` (the text that fills it, else its gap label), ``is_recoverable``, volume, revenue and share of
    all such revenue. Texts are looked up for these few keys only.
    """
    gaps = facts.filter(F.col(dim.value).isNull())
    price = F.col("price").cast(R.MONEY)
    found = heavy_keys(gaps, dim.key, price, M.row_measures(), percent)
    # Each key has at least that percentage, so they are few: 100 / percent at most.
    known = facts.filter(F.col(dim.value).isNotNull()).join(F.broadcast(found.select(dim.key)), dim.key, "left_semi")
    texts = known.groupBy(dim.key, dim.value).agg(F.count(F.lit(1)).alias("_n")).groupBy(dim.key).agg(F.max(dim.value).alias("_text"))
    whole = gaps.agg(M.revenue_sum().alias("rev"))
    shared = found.join(texts, dim.key, "left").withColumn(M.TOTAL, whole.select(F.struct("rev")).scalar())
    return shared.select(
        dim.key,
        F.coalesce("_text", dim.gap_label()).alias("label"),
        F.col("_text").isNotNull().alias("is_recoverable"),
        F.col("vol").alias("transaction_volume"),
        M.revenue().alias("total_revenue"),
        R.money_percent_of("rev", f"{M.TOTAL}.rev").alias("share_of_gap_revenue"),
    )
