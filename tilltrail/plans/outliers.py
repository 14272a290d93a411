"""Segments whose order value lies far from that of their like, by scores that outliers themselves do not move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.functions import ratios as R
from tilltrail.operators.selection import middle_sums
from tilltrail.plans import strategy
from tilltrail.session import stored

DIMENSION = "dimension"


def outlying_segments(facts: DataFrame, year: int = S.REPORT_YEAR) -> DataFrame:
    """Every category, brand and time window with the median order value of its dimension, the median deviation and a score.

    The score is 0.6745 times the distance from the median over the median deviation; beyond 3.5 either way a segment is an outlier.
    Where the median deviation is zero the score is NULL, and what differs from the median is an outlier. A segment without a
    priced row has no order value, no score and is none.

    Twice the median and four times the deviation are whole hundredths, so nothing is rounded before the score. Segments are
    stored, since each selection scans them five times; facts are not read again.
    """
    value = (F.col("aov") * 100).cast("long").alias("_value")
    segments = strategy.all_segments(facts, year).select(DIMENSION, "segment_name", "vol", "rev", "aov", value)
    segments, _ = stored(segments, "valued-segments")
    # One row per dimension.
    medians = middle_sums(segments, DIMENSION, "_value").select(DIMENSION, F.col("twice_median").alias("_m2"))
    apart = segments.join(F.broadcast(medians), DIMENSION, "left").withColumn("_apart", F.expr("2 * _value - _m2"))
    apart, _ = stored(apart.withColumn("_away", F.abs("_apart")), "segment-deviations")
    deviations = middle_sums(apart, DIMENSION, "_away").select(DIMENSION, F.col("twice_median").alias("_d4"))
    wide = "cast({} as decimal(28,0))"
    return apart.join(F.broadcast(deviations), DIMENSION, "left").select(
        DIMENSION,
        "segment_name",
        F.col("vol").alias("transaction_count"),
        F.col("rev").alias("total_revenue"),
        F.col("aov").alias("segment_aov"),
        F.expr("cast(cast(_m2 as decimal(20,0)) * 0.005 as decimal(18,3))").alias("median_aov"),
        F.expr("cast(cast(_d4 as decimal(20,0)) * 0.0025 as decimal(18,4))").alias("median_deviation"),
        R.exact_ratio(wide.format("1349 * _apart"), wide.format("1000 * _d4")).alias("robust_score"),
        F.expr("coalesce(1349 * _away > 3500 * _d4, false)").alias("is_outlier"),
    )
