"""When labels are missing: runs of hours with gaps over a dense calendar, and how unevenly gaps fall on the hours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.functions import columns as C
from tilltrail.functions import ratios as R
from tilltrail.operators import measures as M
from tilltrail.operators.imputation import Dimension, impute, value_map
from tilltrail.operators.ordering import running
from tilltrail.plans.strategy import CLOCK
from tilltrail.session import remove_folder, stored

HOUR = "_hour"


def _hour_number() -> Column:
    """Hours since 1970 on the clock's own reading, before it as well."""
    return F.unix_date(F.to_date(CLOCK)).cast("long") * 24 + F.hour(CLOCK)


def _clock(number: str) -> Column:
    return F.timestamp_add("HOUR", F.col(number), F.expr(C.EPOCH))


def _open(dim: Dimension) -> Column:
    return F.col(dim.value).isNull() | dim.is_gap()


def gap_rows(facts: DataFrame, *dims: Dimension, year: int = S.REPORT_YEAR) -> DataFrame:
    """What the gaps of all ``dims`` are read from: keys and texts of rows of any year, the hour of those of the year, open prices.

    Rows of other years have no hour; they take part in the maps. Facts may be joins themselves, so whoever needs more than one
    reading stores these rows.
    """
    hour = F.when(C.within_year(CLOCK, year), _hour_number())
    texts = dict.fromkeys(c for dim in dims for c in (dim.key, dim.value))
    price = F.when(hour.isNotNull() & reduce(Column.__or__, map(_open, dims)), F.col("price"))
    return facts.select(hour.alias(HOUR), *texts, price.alias("price"))


def hourly_gaps(facts: DataFrame, dim: Dimension, year: int = S.REPORT_YEAR) -> DataFrame:
    """A row for every hour from the first to the last sale of the year: ``sold`` rows, and measures of those no text is known for.

    ``facts`` may be ``gap_rows`` already. Rows without a text are counted by key and hour first; the map, made of rows of any year, is
    joined to these counts. Stored, as what follows reads it more than once.
    """
    rows = facts if HOUR in facts.columns else gap_rows(facts, dim, year=year)
    dated = rows.filter(F.col(HOUR).isNotNull())
    sold = dated.groupBy(HOUR).agg(F.count(F.lit(1)).alias("sold"))
    counts = dated.filter(_open(dim)).groupBy(dim.key, dim.value, HOUR).agg(*M.row_measures())
    filled = impute(counts, dim, value_map(rows, dim))
    # A row without a key has no label that names it, and is a gap too.
    gaps = filled.filter(_open(dim)).groupBy(HOUR).agg(*M.merged_measures())
    span = sold.agg(F.min(HOUR).alias("a"), F.max(HOUR).alias("b")).filter("a is not null")
    calendar = span.select(F.explode(F.sequence("a", "b")).alias(HOUR))
    counted = [F.coalesce(name, F.lit(0)).alias(name) for name in ("sold", "vol", "rev")]
    dense = calendar.join(sold, HOUR, "left").join(gaps, HOUR, "left").select(HOUR, *counted)
    return stored(dense, "hourly-gaps")[0]


def _hours_by_dimension(facts: DataFrame, dims: tuple[Dimension, ...], year: int) -> list[tuple[Dimension, DataFrame]]:
    """The hours of every dimension, from one reading of the facts: its rows are stored until all hours are."""
    rows, path = stored(gap_rows(facts, *dims, year=year), "gap-rows")
    hours = [(dim, hourly_gaps(rows, dim)) for dim in dims]
    remove_folder(facts.sparkSession, path)
    return hours


def _islands(hours: DataFrame) -> DataFrame:
    """Runs of side-by-side hours with a gap.

    In a run the hour's number less the count of such hours so far stays the same, and no other run has that difference. Counts run over
    blocks of hours, so a run may cross blocks and partitions.
    """
    counted = running(hours.withColumn("_has", (F.col("vol") > 0).cast("long")), HOUR, {"_so_far": "_has"})
    return counted.filter("_has = 1").groupBy((F.col(HOUR) - F.col("_so_far")).alias("_run")).agg(
        F.min(HOUR).alias("_first"),
        F.max(HOUR).alias("_last"),
        F.count(F.lit(1)).alias("hours"),
        F.sum("vol").alias("vol"),
        F.sum("rev").alias("rev"),
    )


def gap_runs(facts: DataFrame, *dims: Dimension, year: int = S.REPORT_YEAR) -> DataFrame:
    """Runs of hours in each of which a sale lacks its label: first and last hour, how many, gaps and their revenue.

    Hours without any sale end a run. Years without gaps have no runs.
    """
    found = None
    for dim, hours in _hours_by_dimension(facts, dims, year):
        runs = _islands(hours).select(
            F.lit(dim.name).alias("dimension"),
            _clock("_first").alias("run_start"),
            _clock("_last").alias("run_end"),
            "hours",
            F.col("vol").alias("gap_rows"),
            M.revenue().alias("gap_revenue"),
        )
        found = runs if found is None else found.unionByName(runs)
    return found


def _dispersion(name: str) -> Column:
    """Variance over mean of a count by hour, as one fraction: 1 if rows fall at random, more if they cluster."""
    return R.exact_ratio(f"(_hours * _squares_{name} - _sum_{name} * _sum_{name})", f"(_hours * _sum_{name})")


def gap_dispersion(facts: DataFrame, *dims: Dimension, year: int = S.REPORT_YEAR) -> DataFrame:
    """A row per dimension: hours, those with a gap, runs, the longest, and how gaps and all sales are dispersed over the hours.

    Dispersion is the variance over the mean of the counts by hour, empty hours included; NULL without gaps. What clusters as all
    sales do has a like figure in ``sales_dispersion`` at the same volume. A year without sales gives zeros and NULL.
    """
    found = None
    added = "cast(coalesce(sum(cast({} as decimal(17,0)) * {}), 0) as decimal({},0))"
    for dim, hours in _hours_by_dimension(facts, dims, year):
        runs = _islands(hours).agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.max("hours"), F.lit(0)).alias("longest_run"))
        sums = hours.agg(
            F.count(F.lit(1)).alias("hours"),
            F.count_if(F.col("vol") > 0).alias("gap_hours"),
            *[
                F.expr(added.format(name, by, digits)).alias(f"{label}_{name}")
                for name in ("vol", "sold")
                for label, by, digits in (("_sum", "1", 17), ("_squares", name, 24))
            ],
        )
        row = sums.withColumns({"_hours": F.expr("cast(hours as decimal(10,0))"), "_runs": runs.select(F.struct("*")).scalar()}).select(
            F.lit(dim.name).alias("dimension"),
            "hours",
            "gap_hours",
            F.col("_runs.runs").alias("runs"),
            F.col("_runs.longest_run").alias("longest_run"),
            F.col("_sum_vol").cast("long").alias("gap_rows"),
            _dispersion("vol").alias("gap_dispersion"),
            _dispersion("sold").alias("sales_dispersion"),
        )
        found = row if found is None else found.unionByName(row)
    return found
