"""Hidden revenue at every level, and how gaps and guests go together: both from one table of counted statuses."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilltrail import schema as S
from tilltrail.functions import columns as C
from tilltrail.functions import ratios as R
from tilltrail.operators import measures as M
from tilltrail.operators.imputation import BRAND, CATEGORY, impute_both
from tilltrail.plans.strategy import CLOCK, with_user_type
from tilltrail.session import stored

OUTSIDE = "05. Outside the Year"
LEVELS = {
    "user_type": [S.ANONYMOUS, S.REGISTERED],
    "time_window": [*[name for _, _, name in S.TIME_WINDOWS], S.NIGHT_WINDOW, OUTSIDE],
    "category_status": [CATEGORY.known_status, CATEGORY.gap_status],
    "brand_status": [BRAND.known_status, BRAND.gap_status],
}


def status_cells(facts: DataFrame, year: int = S.REPORT_YEAR) -> DataFrame:
    """Measures by user type, time window, category status and brand status: forty rows at most.

    Facts are scanned once and aggregated by both keys and texts; the groups are stored, and the maps that fill gaps come from
    them. Only groups with a gap meet the maps. The window is that of the report year; rows of other years, such as those whose time was
    lost, have one of their own.
    """
    window = F.when(C.within_year(CLOCK, year), C.time_window(F.hour(CLOCK))).otherwise(OUTSIDE)
    by = [CATEGORY.key, CATEGORY.value, BRAND.key, BRAND.value, "user_type"]
    groups = with_user_type(facts).groupBy(*by, window.alias("time_window")).agg(*M.measures_of(facts))
    groups, _ = stored(groups, "status-groups")
    statuses = [CATEGORY.status().alias("category_status"), BRAND.status().alias("brand_status")]
    # A missing key names no gap label: such a row is a gap as well.
    unnamed = {d.value: F.coalesce(F.col(d.value), F.lit(d.gap_prefix)) for d in (CATEGORY, BRAND)}
    filled = impute_both(groups).withColumns(unnamed)
    return filled.groupBy("user_type", "time_window", *statuses).agg(*M.merged_measures())


def integrity_score(cells: DataFrame) -> DataFrame:
    """Revenue, what of it is hidden behind a missing category or brand, and the percentage that is not, for every level.

    ``cells`` are those of ``status_cells``. Levels are all sixteen sets of the four columns; a column that a level does
    not part by is NULL, and ``level`` has its bit set (the first column has the highest). Without rows there are no levels.
    """
    gaps = {"category": F.col("category_status") == CATEGORY.gap_status, "brand": F.col("brand_status") == BRAND.gap_status}
    marked = cells.withColumns({**{f"_{k}": gap for k, gap in gaps.items()}, "_any": gaps["category"] | gaps["brand"]})

    def rev_where(flag: str, name: str):
        return F.expr(f"cast(sum(if({flag}, coalesce(rev, 0), 0)) as {R.MONEY})").alias(name)

    levels = marked.cube(*LEVELS).agg(
        F.grouping_id().cast("int").alias("level"),
        *M.merged_measures(),
        F.expr("sum(if(_any, vol, 0))").alias("hidden_volume"),
        rev_where("_any", "_hidden"),
        rev_where("_category", "_hidden_category"),
        rev_where("_brand", "_hidden_brand"),
    )
    return levels.select(
        "level",
        *LEVELS,
        F.col("vol").alias("transaction_volume"),
        M.revenue().alias("total_revenue"),
        "hidden_volume",
        M.revenue("_hidden").alias("hidden_revenue"),
        M.revenue("_hidden_category").alias("hidden_category_revenue"),
        M.revenue("_hidden_brand").alias("hidden_brand_revenue"),
        R.money_percent_of("_hidden", "rev").alias("hidden_revenue_pct"),
        R.money_percent_of("(rev - _hidden)", "rev").alias("integrity_score"),
    )


def status_associations(cells: DataFrame) -> DataFrame:
    """A contingency table for each pair of the four status columns, with lift per cell and Cramer's V per pair.

    ``cells`` are those of ``status_cells``. Every pair of values has a row, with ``n`` zero where no purchase has both. ``lift`` is the count
    over the one that independence would give, NULL if a value does not occur. ``cramers_v`` goes from 0 to 1 and
    is NULL if either column has less than two values that occur.
    """
    pairs = list(combinations(LEVELS, 2))
    every = [(a, b, x, y) for a, b in pairs for x in LEVELS[a] for y in LEVELS[b]]
    names = ["first_column", "second_column", "first_value", "second_value"]
    dense = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in every]))
    table = cells.sparkSession.range(1).select(dense.alias("c")).select("c.*")
    kinds = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs]
    seen = cells.select("vol", F.explode(F.array(*kinds)).alias("c")).groupBy(
        *[F.col(f"c.{short}").alias(n) for short, n in zip("abxy", names, strict=True)]
    )
    # Both sides have at most as many rows as there are pairs of values.
    counted = table.join(F.broadcast(seen.agg(F.sum("vol").alias("n"))), names, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    pair = names[:2]
    whole = Window.partitionBy(*pair)
    margins = counted.withColumns(
        {
            "first_total": F.sum("n").over(Window.partitionBy(*pair, "first_value")),
            "second_total": F.sum("n").over(Window.partitionBy(*pair, "second_value")),
            "all_total": F.sum("n").over(whole),
        }
    )
    product = "cast(first_total as double) * second_total"
    parts = margins.withColumns(
        {
            "_part": F.expr(f"if(n > 0, cast(n as double) * n / ({product}), 0D)"),
            "_first": F.expr("if(first_total > 0, first_value, null)"),
            "_second": F.expr("if(second_total > 0, second_value, null)"),
        }
    )
    sizes = [F.size(F.collect_set(c).over(whole)) for c in ("_first", "_second")]
    measured = parts.withColumns({"_sum": F.sum("_part").over(whole), "_fewest": F.least(*sizes)})
    strength = "sqrt(greatest(_sum - 1, 0D) / (_fewest - 1))"
    count = "cast({} as decimal(18,0))"
    return measured.select(
        *names,
        "n",
        "first_total",
        "second_total",
        R.exact_ratio(
            f"{count.format('n')} * {count.format('all_total')}", f"{count.format('first_total')} * {count.format('second_total')}"
        ).alias("lift"),
        F.expr(f"cast(if(_fewest > 1, {strength}, null) as decimal(9,4))").alias("cramers_v"),
    )
