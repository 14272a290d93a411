"""Two summaries of the clean table that all exported reports can be computed from.

One report reads the facts itself. All ten together would read them more than ten times; from the
summaries they read them three times: once per summary and once to count distinct users. Both are
stored in the shared folder, so reports do not depend on executors that computed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilltrail.operators import measures as M
from tilltrail.plans import strategy
from tilltrail.plans.strategy import CLOCK, with_user_type
from tilltrail.session import fresh_folder, remove_folder, scratch_folder


def product_summary(facts: DataFrame) -> DataFrame:
    """Measures per product, brand and category as recorded, and user type."""
    keys = ["product_id", "brand", "category_id", "category_code", "user_type"]
    return with_user_type(facts).groupBy(*keys).agg(*M.row_measures())


def hour_summary(facts: DataFrame) -> DataFrame:
    """Measures per hour of the normalized clock and user type."""
    midnight = F.col(CLOCK).cast("date").cast("timestamp_ntz")
    hour = F.timestamp_add("HOUR", F.hour(CLOCK), midnight)
    return with_user_type(facts).groupBy(hour.alias(CLOCK), "user_type").agg(*M.row_measures())


def reports_from(products: DataFrame, hours: DataFrame, buyers: DataFrame) -> dict[str, DataFrame]:
    """The ten exported reports by file name; ``buyers`` are rows to count users and products in."""
    timed = {strategy.monthly_seasonality, strategy.payday_analysis, strategy.weekday_rhythm, strategy.hourly_analysis}
    reports = {}
    for name, report in strategy.EXPORTS.items():
        if report is strategy.user_segmentation:
            reports[name] = report(products, buyers=buyers)
        elif report is strategy.strategy_portfolio:
            reports[name] = report(products, hours=hours)
        else:
            reports[name] = report(hours if report in timed else products)
    return reports


def all_reports(spark: SparkSession, clean: DataFrame) -> dict[str, DataFrame]:
    """The ten reports of a clean table. They read the stored summaries, which each call stores anew, until these are removed."""
    folder = fresh_folder(spark, "summaries/run")
    stored = []
    for name, summary in (("products", product_summary(clean)), ("hours", hour_summary(clean))):
        summary.write.parquet(f"{folder}/{name}")
        stored.append(spark.read.schema(summary.schema).parquet(f"{folder}/{name}"))
    return reports_from(*stored, buyers=clean)


def remove(spark: SparkSession) -> None:
    """Delete all summaries that this application stored, once their reports are exported."""
    remove_folder(spark, scratch_folder(spark, "summaries"))
