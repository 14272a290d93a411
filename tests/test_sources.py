"""CSV in, clean table and reports out."""

from __future__ import annotations

import csv
import datetime as dt
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tilltrail import pipeline
from tilltrail import schema as S
from tilltrail.operators.cleaning import clean_purchases, in_year
from tilltrail.operators.imputation import BRAND, CATEGORY, impute, value_map
from tilltrail.plans import baseline, strategy, summaries, views
from tilltrail.plans.registry import STORED, all_queries
from tilltrail.session import scratch_folder
from tilltrail.sources import tables
from tilltrail.sources.samples import sample_purchases

HEADER = ",".join(field.name for field in S.RAW_SCHEMA)
FIRST = "0,1515915625441993984,2020-04-24 11:50:39 UTC,2294359932054536986,1515966223509089906,2268105426648170900,electronics.tablet,samsung,162.01"
SECOND = "1,,1970-01-01 00:33:40 UTC,2294444024058086220,2273948319057183658,2268105430162997728,,,77.52"


def _file(folder, name: str, *lines: str) -> str:
    path = folder / name
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_two_files_are_read_with_declared_types(spark, tmp_path):
    paths = [_file(tmp_path, "1.csv", FIRST), _file(tmp_path, "2.csv", SECOND)]
    df = tables.read_purchases(spark, paths)
    assert df.schema.simpleString() == S.RAW_SCHEMA.simpleString()
    first, second = df.orderBy("serial_number").collect()
    assert first.user_id == Decimal("1515915625441993984")
    assert first.category_id == Decimal("2268105426648170900")
    assert first.price == Decimal("162.01")
    assert (second.user_id, second.category_code, second.brand) == (None, None, None)
    clean = clean_purchases(df).orderBy("price").collect()
    assert clean[1].event_time == dt.datetime(2020, 4, 24, 19, 50, 39)
    assert clean[1].normalized_event_time == dt.datetime(2020, 4, 24, 11, 50, 39)


@pytest.mark.parametrize(
    "line",
    [
        FIRST.replace("162.01", "cheap"),
        FIRST.replace("2020-04-24", "yesterday"),
        FIRST.replace("samsung", "s" * 21),
        FIRST.replace("electronics.tablet", "e" * 51),
    ],
)
def test_records_that_do_not_fit_fail(spark, tmp_path, line):
    df = tables.read_purchases(spark, [_file(tmp_path, "bad.csv", line)])
    with pytest.raises(Exception, match="(?i)malformed|longer than"):
        df.collect()


def test_wrong_header_fails(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text(HEADER.replace("brand", "maker") + "\n" + FIRST + "\n")
    with pytest.raises(Exception):
        tables.read_purchases(spark, [str(path)]).collect()


def test_clean_table_is_stored_by_month_and_pruned(spark, small, tmp_path):
    path = str(tmp_path / "clean")
    clean = clean_purchases(sample_purchases(spark, small, STORED))
    tables.write_clean(clean, path)
    stored = tables.read_clean(spark, path)
    assert stored.count() == clean.count()
    assert stored.select("id").distinct().count() == stored.count()
    assert (tmp_path / "clean" / "clean_year=1970" / "clean_month=1").is_dir()
    plan = in_year(stored, 2020, "normalized_event_time").select("price")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(clean_year" in plan and "= 2020)" in plan
    assert "GreaterThanOrEqual(normalized_event_time" in plan


def test_stored_rows_give_the_same_reports(spark, small, tmp_path):
    clean = clean_purchases(sample_purchases(spark, small, STORED))
    tables.write_clean(clean, str(tmp_path / "clean"))
    stored = tables.read_clean(spark, str(tmp_path / "clean"))
    reports = summaries.all_reports(spark, stored)
    assert list(reports) == list(strategy.EXPORTS)
    for name, report in reports.items():
        assert report.collect() == strategy.EXPORTS[name](clean).collect(), name


def test_stored_maps_fill_and_are_broadcast_by_their_size(spark, small, tmp_path):
    raw = sample_purchases(spark, small, STORED)
    tables.write_maps(raw, str(tmp_path / "codes"), str(tmp_path / "brands"))
    codes = spark.read.parquet(str(tmp_path / "codes"))
    assert sorted(codes.collect()) == sorted(value_map(raw, CATEGORY).collect())
    assert sorted(spark.read.parquet(str(tmp_path / "brands")).collect()) == sorted(value_map(raw, BRAND).collect())
    filled = impute(raw.filter("category_code is null"), CATEGORY, codes)
    plan = filled._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [category_id" in plan
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        plan = impute(raw.filter("category_code is null"), CATEGORY, codes)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [category_id" in plan


def test_pipeline_from_csv_to_reports(spark, small, tmp_path):
    raw = sample_purchases(spark, small)
    # The sample clock runs eight hours ahead; the files hold instants.
    instants = raw.withColumn(
        "event_time", F.date_format(F.col("event_time") - F.expr("interval 8 hours"), "yyyy-MM-dd HH:mm:ss 'UTC'")
    )
    instants.write.option("header", True).csv(str(tmp_path / "in"))
    pipeline.run(spark, [str(tmp_path / "in")], str(tmp_path / "clean"), str(tmp_path / "out"), True)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted([*strategy.EXPORTS, "baseline", "quality"])
    assert sorted(p.name for p in (tmp_path / "out" / "baseline").iterdir()) == sorted(baseline.REPORTS)
    assert not Path(scratch_folder(spark, "summaries")).exists()

    def exported(name):
        [file] = [p for p in (tmp_path / "out" / name).glob("*.csv") if p.stat().st_size]
        with file.open() as lines:
            return list(csv.DictReader(lines))

    rows, serials = raw.count(), raw.select("serial_number").distinct().count()
    assert exported("quality/serial_uniqueness") == [{"distinct_serials": str(serials), "row_count": str(rows)}]
    assert int(exported("quality/null_profile_raw")[0]["user_id"]) == raw.filter("user_id IS NULL").count()
    expected_months = baseline.run(views.baseline_view(raw), baseline.REPORTS["monthly_volume"]).collect()
    assert exported("baseline/monthly_volume") == [{k: str(v) for k, v in r.asDict().items()} for r in expected_months]
    expected = strategy.user_segmentation(clean_purchases(raw)).collect()
    [file] = [p for p in (tmp_path / "out" / "01_user_segmentation_summary").glob("*.csv") if p.stat().st_size]
    with file.open() as lines:
        found = list(csv.DictReader(lines))
    assert found == [{k: str(v) for k, v in row.asDict().items()} for row in expected]


def test_appended_rows_get_ids_of_their_own(spark, small, tmp_path):
    clean = clean_purchases(sample_purchases(spark, small, STORED)).limit(50)
    path = str(tmp_path / "clean")
    for _ in range(3):
        tables.write_clean(clean, path, mode="append")
    stored = tables.read_clean(spark, path)
    assert stored.count() == stored.select("id").distinct().count() == 150


def test_baseline_on_the_stored_table_keeps_its_own_clock(spark, tmp_path):
    """The first eight hours of a month or year belong to the one before on the normalized clock."""
    at = ["2020-01-01 03:00:00", "2020-01-20 12:00:00", "2020-06-01 05:00:00", "2021-01-01 01:00:00", "1970-01-01 08:00:00"]
    rows = [(i, 1, t, i, 7, 3, S.SMARTPHONES if i % 2 else S.FRIDGES, "lg", 10 + i) for i, t in enumerate(at)]
    names = "serial_number, user_id, event_time, order_id, product_id, category_id, category_code, brand, price"
    df = spark.createDataFrame(rows, names.split(", "))
    raw = df.select(
        "serial_number",
        F.col("user_id").cast(S.ID_TYPE),
        F.col("event_time").cast("timestamp_ntz"),
        *[F.col(c).cast(S.ID_TYPE) for c in ("order_id", "product_id")],
        F.col("category_id").cast(S.CATEGORY_ID_TYPE),
        "category_code",
        "brand",
        F.col("price").cast(S.PRICE_TYPE),
    )
    tables.write_clean(clean_purchases(raw), str(tmp_path / "clean"))
    stored = tables.read_clean(spark, str(tmp_path / "clean"))
    direct = views.baseline_view(raw)
    for name, report in pipeline.baseline_reports(stored).items():
        assert sorted(report.collect()) == sorted(baseline.run(direct, baseline.REPORTS[name]).collect()), name
    monthly = baseline.run(views.baseline_view(stored), baseline.REPORTS["monthly_volume"])
    assert [(r.month, r.monthly_sales) for r in monthly.collect()] == [(1, 2), (6, 1)]


def test_view_takes_stored_maps(spark, small, tmp_path):
    raw = sample_purchases(spark, small, STORED)
    tables.write_clean(clean_purchases(raw), str(tmp_path / "clean"))
    tables.write_maps(raw, str(tmp_path / "codes"), str(tmp_path / "brands"))
    maps = {d.name: tables.read_map(spark, str(tmp_path / p)) for d, p in ((CATEGORY, "codes"), (BRAND, "brands"))}
    clean = tables.read_clean(spark, str(tmp_path / "clean"))
    given = views.purchases_view(clean, maps=maps)
    plan = given._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if "FileScan" in line and "/clean]" in line]) == 2
    assert sorted(given.collect()) == sorted(views.purchases_view(clean).collect())


def test_round_trips_overwrite_what_they_stored(spark, small):
    for _ in range(2):
        all_queries()["write_clean"](spark, small).count()
        all_queries()["read_purchases"](spark, small).count()
    base = Path(scratch_folder(spark, ""))
    assert len([p for p in base.iterdir() if p.name in ("stored-table", "csv-round-trip")]) == 2
    assert len(list((base / "csv-round-trip").glob("_SUCCESS"))) == 1


def test_two_results_of_one_query_are_readable_side_by_side(spark):
    """A lazy result reads what its own call stored, whatever was stored since."""
    queries = all_queries()
    for name in ("write_clean", "read_purchases", "append_ids", "export_reports"):
        one = queries[name](spark, "/root/testdata/sf0.001")
        two = queries[name](spark, "/root/testdata/sf0.01")
        assert 0 < one.count() <= two.count(), name
        assert one.collect(), name


def test_new_rows_show_in_the_view(spark, small, tmp_path):
    clean = clean_purchases(sample_purchases(spark, small, STORED))
    path = str(tmp_path / "clean")
    tables.write_clean(clean.filter("product_id < 100"), path)
    before = views.purchases_view(tables.read_clean(spark, path)).count()
    tables.write_clean(clean.filter("product_id >= 100"), path, mode="append")
    after = views.purchases_view(tables.read_clean(spark, path)).count()
    assert before < after == clean.count()


def test_lookup_keys_of_the_samples_are_unique(spark):
    for sf in ("0.001", "0.01", "0.1"):
        for name, key in (("orders", "o_orderkey"), ("part", "p_partkey")):
            df = spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")
            assert df.count() == df.select(key).distinct().count()


def test_unknown_sample_column(spark, small):
    with pytest.raises(ValueError, match="colour"):
        sample_purchases(spark, small, ["colour"])
