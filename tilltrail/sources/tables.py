"""Reading purchase records, storing the clean table, exporting reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.operators import cleaning
from tilltrail.operators.imputation import BRAND, CATEGORY, value_map
from tilltrail.session import folder_exists


def read_purchases(spark: SparkSession, paths: str | list[str], check_lengths: bool = True) -> DataFrame:
    """All CSV files as one frame with the declared types; a record that does not fit fails.

    Text longer than the declared length fails too, on the executors while they read.
    """
    df = spark.read.schema(S.RAW_SCHEMA).csv(paths, header=True, mode="FAILFAST", enforceSchema=False)
    if not check_lengths:
        return df
    return df.withColumns({c: _within_length(c, n) for c, n in S.MAX_LENGTHS.items()})


def _within_length(name: str, length: int) -> Column:
    message = F.concat(F.lit(f"{name} is longer than {length}: "), F.col(name))
    return F.when(F.length(name) > length, F.raise_error(message)).otherwise(F.col(name))


def write_clean(clean: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the clean table by year and month of the normalized clock.

    The rebalance hint sends rows of one month together and splits large months, so files come
    out evenly sized whatever month most rows fall into. Rows without an id get one first, above
    all ids that are stored already if they are appended; one writer appends at a time.
    """
    if "id" not in clean.columns:
        stored = _highest_id(clean.sparkSession, path) if mode == "append" else 0
        clean = cleaning.add_arrival_id(clean, after=stored)
    at = F.col(cleaning.CLEAN_CLOCK)
    folders = {cleaning.CLEAN_YEAR: F.year(at), cleaning.CLEAN_MONTH: F.month(at)}
    parts = clean.select(*S.CLEAN_COLUMNS).withColumns(folders)
    parts.hint("rebalance", *folders).write.mode(mode).partitionBy(*folders).parquet(path)


def _highest_id(spark: SparkSession, path: str) -> int:
    """The highest stored id, 0 where nothing is stored."""
    if not folder_exists(spark, path):
        return 0
    return read_clean(spark, path).agg(F.max("id")).first()[0] or 0


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with its ``clean_year`` and ``clean_month``; filters on those skip whole folders."""
    return spark.read.parquet(path)


def write_maps(raw: DataFrame, category_path: str, brand_path: str) -> None:
    """Store both maps. Read back, their file sizes tell the planner whether to broadcast them."""
    value_map(raw, CATEGORY).write.mode("overwrite").parquet(category_path)
    value_map(raw, BRAND).write.mode("overwrite").parquet(brand_path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder with a header per report."""
    for name, report in reports.items():
        report.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")
