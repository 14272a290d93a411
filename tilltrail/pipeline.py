"""From CSV files to the stored clean table, its quality report and the exported reports."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tilltrail.operators import profiling
from tilltrail.operators.cleaning import clean_purchases
from tilltrail.operators.imputation import BRAND, CATEGORY
from tilltrail.plans import baseline, summaries
from tilltrail.plans.views import baseline_view
from tilltrail.session import build_session
from tilltrail.sources.tables import export_reports, read_clean, read_purchases, write_clean


def quality_reports(raw: DataFrame, clean: DataFrame) -> dict[str, DataFrame]:
    """What is missing, repeated or contradictory in the records, and what stays unlabelled."""
    return {
        "null_profile_raw": profiling.null_profile(raw),
        "serial_uniqueness": profiling.serial_uniqueness(raw),
        "incomplete_row_count": profiling.incomplete_row_count(raw),
        "category_id_conflicts": profiling.mapping_conflicts(raw, "category_id", "category_code", "max_names"),
        "product_brand_conflicts": profiling.mapping_conflicts(raw, "product_id", "brand", "brand_count"),
        "null_profile_view": profiling.null_profile_of_view(clean),
        "unlabelled_row_count": profiling.gap_row_count(clean, CATEGORY, "unlabelled_rows"),
        "unknown_brand_row_count": profiling.gap_row_count(clean, BRAND, "unknown_rows"),
    }


def baseline_reports(clean: DataFrame) -> dict[str, DataFrame]:
    """All descriptive reports on the stored table."""
    view = baseline_view(clean)
    return {name: baseline.run(view, report) for name, report in baseline.REPORTS.items()}


def load(spark: SparkSession, csv_paths: list[str], clean_path: str) -> DataFrame:
    """Read, clean and store the records; further steps read the stored table."""
    write_clean(clean_purchases(read_purchases(spark, csv_paths)), clean_path)
    return read_clean(spark, clean_path)


def run(
    spark: SparkSession, csv_paths: list[str], clean_path: str, reports_path: str, with_baseline: bool = False
) -> None:
    """Load, then export the quality report, the ten reports and, if asked for, the descriptive ones."""
    reports_path = reports_path.rstrip("/")
    clean = load(spark, csv_paths, clean_path)
    export_reports(quality_reports(read_purchases(spark, csv_paths), clean), f"{reports_path}/quality")
    export_reports(summaries.all_reports(spark, clean), reports_path)
    summaries.remove(spark)
    if with_baseline:
        export_reports(baseline_reports(clean), f"{reports_path}/baseline")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", nargs="+", required=True, help="CSV files or folders of purchase records")
    parser.add_argument("--clean", required=True, help="where the clean table goes")
    parser.add_argument("--reports", required=True, help="where the report CSVs go")
    parser.add_argument("--baseline", action="store_true", help="export the descriptive reports as well")
    parser.add_argument("--shuffle-partitions", type=int, help="partitions that shuffles start from")
    options = parser.parse_args()
    spark = build_session(shuffle_partitions=options.shuffle_partitions)
    run(spark, options.input, options.clean, options.reports, options.baseline)


if __name__ == "__main__":
    main()
