"""The same results in SQL for DuckDB, to compare every query against.

DuckDB divides decimals as doubles, so all ratios are taken on whole cents with integer division.
Texts and thresholds are written out here again instead of imported: a wrong constant in the
library must show as a difference.
"""

from __future__ import annotations

RECORDS = """
tx AS (
  SELECT
    l_orderkey * 8 + l_linenumber AS serial_number,
    CASE WHEN l_orderkey % 4 = 0 THEN CAST(o_custkey AS DECIMAL(20,0)) END AS user_id,
    make_timestamp(1000000 * (CASE WHEN l_orderkey % 141 = 0 THEN 28800
      ELSE 1578211200 + (date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 320) * 86400
           + (l_orderkey * 7919) % 86400 END)) AS event_time,
    CAST(l_orderkey AS DECIMAL(20,0)) AS order_id,
    CAST(l_partkey AS DECIMAL(20,0)) AS product_id,
    CAST(2268105388421284352 + p_size AS DECIMAL(23,0)) AS category_id,
    CASE WHEN p_size % 4 = 0 OR l_linenumber = 5 THEN NULL
         WHEN p_size = 7 THEN 'electronics.smartphone'
         WHEN p_size = 13 THEN 'appliances.kitchen.refrigerators'
         WHEN p_size = 21 THEN concat('dept0.cat21', p_partkey % 3)
         ELSE concat('dept', p_size % 7, '.cat', p_size) END AS category_code,
    CASE WHEN p_partkey % 20 = 0 OR (p_partkey % 20 = 1 AND l_linenumber = 6) THEN NULL
         ELSE lower(replace(p_brand, '#', '')) END AS brand,
    CAST(l_extendedprice AS DECIMAL(8,2)) AS price,
    CAST(CAST(l_extendedprice AS DECIMAL(8,2)) * 100 AS BIGINT) AS cents
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
)"""

CLEAN = """
clean AS (
  SELECT *, event_time - INTERVAL 8 HOUR AS normalized_event_time,
         CASE WHEN user_id IS NULL THEN 'anonymous' ELSE 'registered' END AS user_type
  FROM tx
),
dated AS (
  SELECT *, CAST(year(normalized_event_time) AS INT) AS year,
         CAST(month(normalized_event_time) AS INT) AS month,
         CAST(day(normalized_event_time) AS INT) AS day,
         dayname(normalized_event_time) AS weekday,
         CAST(hour(normalized_event_time) AS INT) AS hour
  FROM clean
)"""

MAPS = """
codes AS (SELECT category_id AS cid, max(category_code) AS code FROM tx GROUP BY category_id),
brands AS (SELECT product_id AS pid, max(brand) AS name FROM tx GROUP BY product_id)"""

VIEW = """
vw AS (
  SELECT user_id, user_type, normalized_event_time, year, month, day, weekday, hour, order_id, product_id, category_id,
    COALESCE(category_code, code, 'unlabelled (ID: ' || CAST(category_id AS VARCHAR) || ')') AS category_code,
    COALESCE(brand, name, 'unknown (Prod: ' || CAST(product_id AS VARCHAR) || ')') AS brand,
    price, cents
  FROM dated LEFT JOIN codes ON cid = category_id LEFT JOIN brands ON pid = product_id
)"""

BASE = """
bvw AS (
  SELECT user_id, event_time, CAST(year(event_time) AS INT) AS year, CAST(month(event_time) AS INT) AS month,
    CAST(day(event_time) AS INT) AS day, rpad(dayname(event_time), 9, ' ') AS weekday,
    CAST(hour(event_time) AS INT) AS hour, order_id, product_id, category_id, category_code, brand, price, cents
  FROM tx WHERE category_code IS NOT NULL AND brand IS NOT NULL
)"""

STORED = "user_id, event_time, order_id, product_id, category_id, category_code, brand, price"
ROW_ORDER = "order_id, product_id, price, {clock}, user_id NULLS FIRST, category_id, category_code NULLS FIRST, brand NULLS FIRST"
VIEW_COLUMNS = [
    "user_id",
    "user_type",
    "normalized_event_time",
    "year",
    "month",
    "day",
    "weekday",
    "hour",
    "order_id",
    "product_id",
    "category_id",
    "category_code",
    "brand",
    "price",
]
BASE_COLUMNS = [
    "user_id",
    "event_time",
    "year",
    "month",
    "day",
    "weekday",
    "hour",
    "order_id",
    "product_id",
    "category_id",
    "category_code",
    "brand",
    "price",
]


def on_records(body: str) -> str:
    return f"WITH {RECORDS}\n{body}"


def on_clean(body: str) -> str:
    return f"WITH {RECORDS},{CLEAN}{body if body.startswith(',') else chr(10) + body}"


def on_view(body: str) -> str:
    return f"WITH {RECORDS},{CLEAN},{MAPS},{VIEW}{body if body.startswith(',') else chr(10) + body}"


def on_base(body: str) -> str:
    return f"WITH {RECORDS},{BASE}\n{body}"


def money(cents: str) -> str:
    """Whole cents as an amount."""
    return f"CAST(CAST({cents} AS DECIMAL(24,0)) * 0.01 AS DECIMAL(28,2))"


def ratio(num: str, den: str, times: int = 1) -> str:
    """round(times * num / den, 2), half up, in integers; both sides are whole and not negative."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return f"CAST(CAST(({200 * times} * {n} + {d}) // nullif(2 * {d}, 0) AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2))"


def share(part: str, whole: str) -> str:
    return ratio(part, whole, 100)


def aov(cents: str, rows: str) -> str:
    """Amount per row from cents: cents / rows is rounded to whole cents."""
    c, r = f"CAST({cents} AS HUGEINT)", f"CAST({rows} AS HUGEINT)"
    return f"CAST(CAST((2 * {c} + {r}) // nullif(2 * {r}, 0) AS DECIMAL(20,0)) * 0.01 AS DECIMAL(18,2))"


def _quality() -> dict[str, str]:
    def nulls(columns: list[str]) -> str:
        return ", ".join(f"count(*) - count({c}) AS {c}" for c in columns)

    stored = STORED.split(", ")
    gap = "category_code IS NULL OR brand IS NULL"
    raw_order = ROW_ORDER.format(clock="event_time")
    view_order = ROW_ORDER.format(clock="normalized_event_time")
    return {
        "row_count": on_records("SELECT count(*) AS row_count FROM tx"),
        "row_count_after_drop": on_base("SELECT count(*) AS row_count FROM bvw"),
        "null_profile_raw": on_records(f"SELECT {nulls(['serial_number', *stored])} FROM tx"),
        "null_profile_after_drop": on_base(f"SELECT {nulls(stored)} FROM bvw"),
        "null_profile_view": on_view(f"SELECT CAST(0 AS BIGINT) AS id, {nulls(VIEW_COLUMNS)} FROM vw"),
        "serial_uniqueness": on_records(
            "SELECT count(DISTINCT serial_number) AS distinct_serials, count(*) AS row_count FROM tx"
        ),
        "user_frequency": on_records("SELECT user_id, count(*) AS total_per_userid FROM tx GROUP BY user_id"),
        "incomplete_row_count": on_records(f"SELECT count(*) AS incomplete_rows FROM tx WHERE {gap}"),
        "incomplete_row_count_after_drop": on_base(f"SELECT count(*) AS incomplete_rows FROM bvw WHERE {gap}"),
        "incomplete_rows": on_records(f"SELECT {STORED} FROM tx WHERE {gap} ORDER BY {raw_order} LIMIT 20"),
        "incomplete_rows_after_drop": on_base(f"SELECT {', '.join(BASE_COLUMNS)} FROM bvw WHERE {gap}"),
        "category_id_conflicts": on_records(
            "SELECT category_id, count(DISTINCT category_code) AS max_names "
            "FROM tx GROUP BY category_id HAVING count(DISTINCT category_code) > 1"
        ),
        "product_brand_conflicts": on_records(
            "SELECT product_id, count(DISTINCT brand) AS brand_count "
            "FROM tx GROUP BY product_id HAVING count(DISTINCT brand) > 1"
        ),
        "category_brand_conflicts": on_records(
            "SELECT category_id, count(DISTINCT brand) AS brand_count "
            "FROM tx GROUP BY category_id HAVING count(DISTINCT brand) > 1"
        ),
        "unlabelled_row_count": on_view(
            "SELECT count(*) AS unlabelled_rows FROM vw WHERE starts_with(category_code, 'unlabelled')"
        ),
        "unknown_brand_row_count": on_view("SELECT count(*) AS unknown_rows FROM vw WHERE starts_with(brand, 'unknown')"),
        "time_range": on_clean(
            "SELECT min(normalized_event_time) AS first_time, max(normalized_event_time) AS last_time FROM clean"
        ),
        "baseline_time_range": on_base("SELECT min(event_time) AS first_time, max(event_time) AS last_time FROM bvw"),
        "distinct_times_per_year": on_clean(
            "SELECT year, count(DISTINCT normalized_event_time) AS distinct_times FROM dated GROUP BY year"
        ),
        "epoch_rows_by_weekday": on_clean(
            f"SELECT weekday AS weekday_of_sales, count(*) AS transaction_count, {money('sum(cents)')} AS total_revenue "
            "FROM dated WHERE year = 1970 GROUP BY weekday"
        ),
        "clean_yearly_sales": on_clean("SELECT year, count(*) AS yearly_sales FROM dated GROUP BY year"),
        "preview_raw": on_records(f"SELECT {STORED} FROM tx ORDER BY {raw_order} LIMIT 5"),
        "preview_clean": on_clean(
            f"SELECT {STORED}, normalized_event_time FROM clean ORDER BY {raw_order} LIMIT 5"
        ),
        "preview_view": on_view(f"SELECT {', '.join(VIEW_COLUMNS)} FROM vw ORDER BY {view_order} LIMIT 10"),
        "preview_baseline": on_base(f"SELECT {', '.join(BASE_COLUMNS)} FROM bvw ORDER BY {raw_order} LIMIT 10"),
        "preview_baseline_page": on_base(
            f"SELECT {', '.join(BASE_COLUMNS)} FROM bvw ORDER BY {raw_order} LIMIT 10 OFFSET 100"
        ),
    }


def _cleaning() -> dict[str, str]:
    ids = (
        "SELECT count(*) AS row_count, count(*) AS distinct_ids, CAST(1 AS BIGINT) AS first_id, "
        "count(*) AS last_id FROM tx"
    )
    mode = (
        "SELECT category_id, category_code AS mapped_category_code FROM (SELECT category_id, category_code, "
        "row_number() OVER (PARTITION BY category_id ORDER BY count(*) DESC, category_code DESC) AS place "
        "FROM tx WHERE category_code IS NOT NULL GROUP BY category_id, category_code) WHERE place = 1"
    )
    return {
        "drop_serial": on_records(f"SELECT {STORED} FROM tx"),
        "drop_incomplete": on_base(f"SELECT {STORED} FROM bvw"),
        "add_surrogate_id": on_records(ids),
        "add_arrival_id": on_records("SELECT count(*) AS row_count, count(*) AS distinct_ids FROM tx"),
        "normalize_event_time": on_clean(
            "SELECT order_id, product_id, event_time, normalized_event_time FROM clean"
        ),
        "add_user_type": on_clean("SELECT order_id, product_id, user_id, user_type FROM clean"),
        "add_calendar": on_clean(
            "SELECT order_id, product_id, event_time, normalized_event_time, year, month, day, weekday, hour FROM dated"
        ),
        "add_calendar_padded": on_records(
            "SELECT order_id, product_id, event_time, CAST(year(event_time) AS INT) AS year, "
            "CAST(month(event_time) AS INT) AS month, CAST(day(event_time) AS INT) AS day, "
            "rpad(dayname(event_time), 9, ' ') AS weekday, CAST(hour(event_time) AS INT) AS hour FROM tx"
        ),
        "category_map": on_records(
            "SELECT category_id, max(category_code) AS mapped_category_code FROM tx "
            "GROUP BY category_id HAVING count(category_code) > 0"
        ),
        "brand_map": on_records(
            "SELECT product_id, max(brand) AS mapped_brand FROM tx GROUP BY product_id HAVING count(brand) > 0"
        ),
        "category_map_by_mode": on_records(mode),
        "impute_category": on_view("SELECT order_id, category_id, category_code FROM vw"),
        "impute_brand": on_view("SELECT order_id, product_id, brand FROM vw"),
        "purchases_view": on_view(f"SELECT {', '.join(VIEW_COLUMNS)} FROM vw"),
        "purchases_view_ids": on_records(ids),
        "baseline_view": on_base(f"SELECT {', '.join(BASE_COLUMNS)} FROM bvw"),
    }


PHONES = "category_code = 'electronics.smartphone'"
FRIDGES = "category_code = 'appliances.kitchen.refrigerators'"


def _grouped(dim: str, measure: str, name: str, where: str, order: str = "", k: int | None = None) -> str:
    tail = f" ORDER BY {name} {order}, {dim} LIMIT {k}" if k else ""
    return on_base(f"SELECT {dim}, {measure} AS {name} FROM bvw WHERE {where} GROUP BY {dim}{tail}")


def _baseline() -> dict[str, str]:
    rows, cents = "count(*)", money("sum(cents)")
    old, new = "year = 1970", "year = 2020"
    category, brand = "category_code", "brand"

    def single(measure: str, name: str, where: str) -> str:
        return on_base(f"SELECT {measure} AS {name} FROM bvw WHERE {where}")

    def top_average(where: str) -> str:
        return on_base(
            f"SELECT row_number() OVER (ORDER BY n DESC, brand) AS rank, brand, {aov('c', 'p')} AS avg_price FROM "
            f"(SELECT brand, count(*) AS n, sum(cents) AS c, count(price) AS p FROM bvw WHERE {where} "
            "GROUP BY brand ORDER BY n DESC, brand LIMIT 10)"
        )

    sql = {
        "yearly_sales": _grouped("year", rows, "yearly_sales", "true"),
        "epoch_null_user_count": single(rows, "null_users", f"{old} AND user_id IS NULL"),
        "epoch_distinct_categories": single("count(DISTINCT category_code)", "categories", old),
        "epoch_distinct_brands": single("count(DISTINCT brand)", "brands", old),
        "epoch_brand_diversity": _grouped(category, "count(DISTINCT brand)", "brand_count", old),
        "epoch_top_categories_volume": _grouped(category, rows, "sales_by_category", old, "DESC", 10),
        "epoch_top_brands_volume": _grouped(brand, rows, "sales_by_brand", old, "DESC", 10),
        "epoch_top_categories_revenue": _grouped(category, cents, "top_earning_category", old, "DESC", 10),
        "epoch_top_brands_revenue": _grouped(brand, cents, "top_earning_brand", old, "DESC", 20),
        "epoch_top_brands_avg_price": top_average(old),
        "epoch_worst_categories_volume": _grouped(category, rows, "worst_sales_by_category", old, "", 15),
        "epoch_worst_categories_revenue": _grouped(category, cents, "worst_revenue_by_category", old, "", 15),
        "epoch_worst_brands_volume": _grouped(brand, rows, "worst_sales_by_brand", old, "", 15),
        "epoch_worst_brands_revenue": _grouped(brand, cents, "worst_revenue_by_brand", old, "", 15),
        "epoch_smartphone_brands_volume": _grouped(brand, rows, "total_sales_by_volume", f"{old} AND {PHONES}"),
        "epoch_smartphone_brands_revenue": _grouped(brand, cents, "total_sales_by_revenue", f"{old} AND {PHONES}"),
        "null_user_count": single(rows, "null_users", f"{new} AND user_id IS NULL"),
        "distinct_categories": single("count(DISTINCT category_code)", "categories", new),
        "distinct_brands": single("count(DISTINCT brand)", "brands", new),
        "brand_diversity": _grouped(category, "count(DISTINCT brand)", "brand_count", new),
        "top_categories_volume": _grouped(category, rows, "sales_by_category", new, "DESC", 10),
        "top_categories_revenue": _grouped(category, cents, "revenue_by_category", new, "DESC", 10),
        "top_brands_volume": _grouped(brand, rows, "brand_sales_by_volume", new, "DESC", 10),
        "top_brands_revenue": _grouped(brand, cents, "brand_sales_by_revenue", new, "DESC", 10),
        "top_brands_avg_price": top_average(new),
        "worst_categories_volume": _grouped(category, rows, "sales_by_category", new, "", 10),
        "worst_brands_volume": _grouped(brand, rows, "brand_sales_by_volume", new),
        "smartphone_brand_count": single(rows, "units", f"{PHONES} AND brand = 'brand1'"),
    }
    for unit, adverb in (("month", "monthly"), ("day", "daily"), ("weekday", "weekday"), ("hour", "hourly")):
        sql[f"epoch_{adverb}_volume"] = _grouped(unit, rows, f"{adverb}_sales", old)
        sql[f"{adverb}_volume"] = _grouped(unit, rows, f"{adverb}_sales", new)
        sql[f"{adverb}_revenue"] = _grouped(unit, cents, f"{adverb}_sales_revenue", new)
    for prefix, where, highest in (("smartphone", PHONES, "maximum_price"), ("fridge", FRIDGES, "highest_price")):
        only = f"{new} AND {where}"
        sql[f"{prefix}_brands_volume"] = _grouped(brand, rows, "total_sales", only)
        sql[f"{prefix}_brands_revenue"] = _grouped(brand, cents, "total_revenue", only)
        sql[f"{prefix}_max_price"] = _grouped(brand, "max(price)", highest, only)
        sql[f"{prefix}_min_price"] = _grouped(brand, "min(price)", "lowest_price", only)
        sql[f"{prefix}_avg_price"] = _grouped(brand, aov("sum(cents)", "count(price)"), "average_price", only)
    return sql


MEASURES = "count(*) AS n, sum(cents) AS c, count(price) AS p"
GUEST, MEMBER = "user_type = 'anonymous'", "user_type = 'registered'"
SIDE_MEASURES = (
    f"count(*) FILTER (WHERE {GUEST}) AS an, count(*) FILTER (WHERE {MEMBER}) AS rn, count(*) AS tn, "
    f"coalesce(sum(cents) FILTER (WHERE {GUEST}), 0) AS ac, coalesce(sum(cents) FILTER (WHERE {MEMBER}), 0) AS rc, "
    f"sum(cents) AS tc, count(price) FILTER (WHERE {GUEST}) AS ap, count(price) FILTER (WHERE {MEMBER}) AS rp"
)


def _over(column: str, within: str = "") -> str:
    return f"sum({column}) OVER ({'PARTITION BY ' + within if within else ''})"


def _status(column: str, prefix: str, gap: str, known: str) -> str:
    return f"if(starts_with({column}, '{prefix}'), '{gap}', '{known}')"


def _dimension(column: str, status: str, status_name: str, other_status: str, other_name: str) -> dict[str, str]:
    sides = f", s AS (SELECT {column}, {SIDE_MEASURES} FROM vw GROUP BY {column})\n"
    volumes = "an AS anon_vol, rn AS reg_vol"
    revenues = f"{money('ac')} AS anon_rev, {money('rc')} AS reg_rev, {money('tc')} AS total_rev"
    values = f"{aov('ac', 'ap')} AS anon_aov, {aov('rc', 'rp')} AS reg_aov"
    total_volume = "tn AS total_vol, " if column == "brand" else ""
    shares = ", ".join(
        f"{share(f'{side}{m}', _over(f'{side}{m}'))} AS {name}_{label}_share_pct"
        for side, name in (("a", "anon"), ("r", "reg"), ("t", "total"))
        for m, label in (("n", "vol"), ("c", "rev"))
    )
    wallet = ", ".join(
        f"{share(f'{side}{m}', _over(f'{side}{m}'))} AS {name}_{label}_share_pct"
        for side, name in (("a", "anon"), ("r", "reg"))
        for m, label in (("n", "vol"), ("c", "rev"))
    )
    return {
        "by_user_type": on_view(
            f", g AS (SELECT {column}, user_type, {MEASURES} FROM vw GROUP BY {column}, user_type)\n"
            f"SELECT {column}, user_type, {status} AS {status_name}, n AS transaction_volume, "
            f"{share('n', _over('n', 'user_type'))} AS vol_share_pct, {money('c')} AS total_revenue, "
            f"{share('c', _over('c', 'user_type'))} AS rev_share_pct, {aov('c', 'p')} AS aov FROM g"
        ),
        "side_by_side": on_view(
            f"{sides}SELECT {column}, {status} AS {status_name}, {total_volume}{volumes}, {revenues}, {values} FROM s"
        ),
        "master": on_view(
            f"{sides}SELECT {column}, {status} AS {status_name}, {volumes}, tn AS total_vol, {revenues}, "
            f"{shares}, {values} FROM s"
        ),
        "share_of_wallet": on_view(
            f", s AS (SELECT {other_status} AS {other_name}, {SIDE_MEASURES} FROM vw GROUP BY 1)\n"
            f"SELECT {other_name}, {wallet} FROM s"
        ),
    }


def _segments() -> str:
    windows = (
        "CASE WHEN hour >= 5 AND hour <= 10 THEN '01. Morning (Premium Window)' "
        "WHEN hour >= 11 AND hour <= 16 THEN '02. Afternoon (Peak Volume)' "
        "WHEN hour >= 17 AND hour <= 22 THEN '03. Evening (Standard)' ELSE '04. Night (Low Activity)' END"
    )
    return (
        f", seg AS (SELECT 'Category' AS dimension, category_code AS segment_name, {MEASURES} FROM vw GROUP BY 2 "
        f"UNION ALL SELECT 'Brand', brand, {MEASURES} FROM vw GROUP BY 2 "
        f"UNION ALL SELECT 'Time Window', {windows}, {MEASURES} FROM vw WHERE year = 2020 GROUP BY 2),\n"
        "tot AS (SELECT CAST(count(*) AS HUGEINT) AS tn, sum(cents) AS tc, CAST(count(price) AS HUGEINT) AS tp FROM vw)\n"
    )


def _portfolio(where: str) -> str:
    role = (
        "CASE WHEN c * tn > tc * n AND c * tp > tc * p THEN 'STAR (High Value & Efficient)' "
        "WHEN c * tn < tc * n AND c * tp < tc * p THEN 'CASH COW (High Volume Traffic)' "
        "WHEN c * tn > tc * n AND c * tp < tc * p THEN 'EFFICIENCY PLAY (Low AOV/High Share)' "
        "ELSE 'LONG TAIL / OPPORTUNITY' END"
    )
    return on_view(
        f"{_segments()}SELECT dimension, segment_name, n AS transaction_count, {money('c')} AS total_revenue, "
        f"{aov('c', 'p')} AS segment_aov, {share('n', 'tn')} AS vol_share_pct, {share('c', 'tc')} AS rev_share_pct, "
        f"{ratio('c * tn', 'tc * n')} AS efficiency_index, {role} AS strategic_role "
        f"FROM seg CROSS JOIN tot WHERE {where}"
    )


def _timed(unit: str, names: tuple[str, ...]) -> str:
    volume, volume_pct, volume_within, rev, rev_pct, rev_within = names
    return on_clean(
        f", g AS (SELECT {unit}, user_type, {MEASURES} FROM dated WHERE year = 2020 GROUP BY {unit}, user_type)\n"
        f"SELECT {unit}, user_type, n AS {volume}, {share('n', _over('n'))} AS {volume_pct}, "
        f"{share('n', _over('n', unit))} AS {volume_within}, {money('c')} AS {rev}, "
        f"{share('c', _over('c'))} AS {rev_pct}, {share('c', _over('c', unit))} AS {rev_within}, "
        f"{aov('c', 'p')} AS aov FROM g"
    )


def _strategy() -> dict[str, str]:
    category = _dimension(
        "category_code",
        _status("category_code", "unlabelled", "Unlabelled", "Labelled"),
        "label_status",
        _status("category_code", "unlabelled", "Unlabelled", "labelled"),
        "category_status",
    )
    brand_status = _status("brand", "unknown", "Unknown", "Known")
    brand = _dimension("brand", brand_status, "brand_status", brand_status, "brand_status")
    segment = f"SELECT dimension, segment_name, n AS vol, {money('c')} AS rev, {aov('c', 'p')} AS aov FROM seg"
    return {
        "user_segmentation": on_view(
            f", g AS (SELECT user_type, {MEASURES}, count(DISTINCT user_id) AS users, "
            "count(DISTINCT category_id) AS cats, count(DISTINCT product_id) AS prods, "
            "coalesce(sum(cents) FILTER (WHERE starts_with(category_code, 'unlabelled')), 0) AS hidden "
            "FROM vw GROUP BY user_type)\n"
            f"SELECT user_type, n AS transaction_volume, {share('n', _over('n'))} AS volume_percentage, "
            f"users AS unique_registered_users, {money('c')} AS total_revenue, "
            f"{share('c', _over('c'))} AS revenue_percentage, {aov('c', 'p')} AS aov, cats AS category_diversity, "
            f"prods AS product_diversity, {share('hidden', 'c')} AS percent_unlabelled_revenue FROM g"
        ),
        "monthly_seasonality": _timed(
            "month",
            (
                "monthly_volume",
                "monthly_volume_pct",
                "volume_within_month_pct",
                "monthly_revenue",
                "monthly_revenue_pct",
                "revenue_within_month_pct",
            ),
        ),
        "weekday_rhythm": _timed(
            "weekday",
            (
                "transaction_volume",
                "volume_total_pct",
                "volume_share_within_day_pct",
                "total_revenue",
                "revenue_total_pct",
                "revenue_share_within_day_pct",
            ),
        ),
        "payday_analysis": on_clean(
            f", g AS (SELECT day, {MEASURES} FROM dated WHERE year = 2020 GROUP BY day)\n"
            f"SELECT day, n AS day_volume, {share('n', _over('n'))} AS volume_pct, {money('c')} AS day_revenue, "
            f"{share('c', _over('c'))} AS revenue_pct, {aov('c', 'p')} AS aov FROM g"
        ),
        "hourly_analysis": on_clean(
            f", g AS (SELECT hour, user_type, {MEASURES} FROM dated WHERE year = 2020 GROUP BY hour, user_type),\n"
            "h AS (SELECT *, (CAST(c AS HUGEINT) * 20000000000 + p) // nullif(CAST(p AS HUGEINT) * 2, 0) AS v FROM g)\n"
            f"SELECT hour, user_type, n AS transaction_volume, {share('n', _over('n', 'user_type'))} AS "
            f"hourly_volume_share, {aov('c', 'p')} AS hourly_aov, "
            "if(v * count(v) OVER (PARTITION BY user_type) > sum(v) OVER (PARTITION BY user_type), "
            "'⭐ Premium Window', 'Standard') AS efficiency_rating FROM h"
        ),
        "category_by_user_type": category["by_user_type"],
        "category_side_by_side": category["side_by_side"],
        "unlabelled_share_of_wallet": category["share_of_wallet"],
        "category_master": category["master"],
        "unlabelled_deep_dive": on_view(
            ", b AS (SELECT category_code, brand, count(*) AS n FROM vw GROUP BY category_code, brand),\n"
            "a AS (SELECT category_code, brand FROM (SELECT category_code, brand, row_number() OVER "
            "(PARTITION BY category_code ORDER BY n DESC, brand) AS place FROM b) WHERE place = 1),\n"
            f"g AS (SELECT category_code, {MEASURES} FROM vw WHERE starts_with(category_code, 'unlabelled') "
            "GROUP BY category_code)\n"
            f"SELECT category_code, n AS transaction_volume, {money('c')} AS total_revenue, "
            f"{aov('c', 'p')} AS category_aov, a.brand AS anchor_brand, {share('c', _over('c'))} AS "
            "share_of_hidden_revenue FROM g JOIN a USING (category_code) ORDER BY c DESC, category_code LIMIT 15"
        ),
        "brand_by_user_type": brand["by_user_type"],
        "brand_side_by_side": brand["side_by_side"],
        "unknown_share_of_wallet": brand["share_of_wallet"],
        "brand_master": brand["master"],
        "unknown_brand_deep_dive": on_view(
            f", g AS (SELECT brand, {MEASURES}, max(category_code) AS hint FROM vw "
            "WHERE starts_with(brand, 'unknown') GROUP BY brand)\n"
            f"SELECT brand, n AS transaction_volume, {money('c')} AS total_revenue, {aov('c', 'p')} AS product_aov, "
            f"hint AS category_hint, {share('c', _over('c'))} AS share_of_unknown_revenue FROM g "
            "ORDER BY c DESC, brand LIMIT 20"
        ),
        "grand_totals": on_records(
            f"SELECT count(*) AS total_vol, {money('sum(cents)')} AS total_rev, "
            f"{aov('sum(cents)', 'count(price)')} AS global_aov FROM tx"
        ),
        "category_segments": on_view(f"{_segments()}{segment} WHERE dimension = 'Category'"),
        "brand_segments": on_view(f"{_segments()}{segment} WHERE dimension = 'Brand'"),
        "time_window_segments": on_view(f"{_segments()}{segment} WHERE dimension = 'Time Window'"),
        "efficiency_index": _portfolio("true"),
        "strategy_portfolio": _portfolio("c * 200 > tc"),
    }


def _sources() -> dict[str, str]:
    stored = f"{STORED}, normalized_event_time"
    strategy = _strategy()
    return {
        "read_purchases": on_clean(f"SELECT {stored} FROM clean"),
        "write_clean": on_clean(f"SELECT {stored}, year, month FROM dated"),
        "baseline_from_stored": on_base(
            f"SELECT month, count(*) AS monthly_sales, {money('sum(cents)')} AS monthly_sales_revenue "
            "FROM bvw WHERE year = 2020 GROUP BY month"
        ),
        "append_ids": on_records("SELECT count(*) AS row_count, count(*) AS distinct_ids FROM tx"),
        "export_reports": strategy["brand_master"],
        "portfolio_from_summaries": strategy["strategy_portfolio"],
    }


def _concentration(label: str, status: str, status_column: str) -> dict[str, str]:
    ranked = (
        f", g AS (SELECT {label}, count(*) AS n, coalesce(sum(cents), 0) AS c FROM vw GROUP BY {label}),\n"
        f"r AS (SELECT *, row_number() OVER (ORDER BY c DESC, {label}) AS place, sum(c) OVER (ORDER BY c DESC, {label} "
        "ROWS UNBOUNDED PRECEDING) AS run, sum(c) OVER () AS total, count(*) OVER () AS labels FROM g)\n"
    )
    core = "(run - c) * 100 < total * 80"
    return {
        "rows": on_view(
            f"{ranked}SELECT place AS revenue_rank, {label}, {status} AS {status_column}, n AS transaction_volume, "
            f"{money('c')} AS total_revenue, {money('run')} AS running_revenue, {share('run', 'total')} AS "
            f"running_share_pct, {core} AS is_core FROM r"
        ),
        "summary": on_view(
            f"{ranked}, s AS (SELECT count(*) AS labels, sum(c) AS total, count(*) FILTER ({core}) AS core, "
            f"coalesce(sum(c) FILTER (NOT {core}), 0) AS tail, max(c) AS top, sum((place - 1) * c) AS weighted FROM r)\n"
            f"SELECT labels, {money('total')} AS total_revenue, core AS core_labels, labels - core AS tail_labels, "
            f"{share('top', 'total')} AS top_share_pct, {share('tail', 'total')} AS tail_share_pct, "
            f"{share('(labels - 1) * total - 2 * weighted', 'labels * total')} AS gini_pct FROM s"
        ),
    }


def _heavy_gaps(key: str, value: str, opening: str, per_mille: int) -> str:
    return on_records(
        f", t AS (SELECT {key}, max({value}) AS text FROM tx GROUP BY {key}),\n"
        f"g AS (SELECT {key}, count(*) AS n, sum(cents) AS c FROM tx WHERE {value} IS NULL GROUP BY {key}),\n"
        "s AS (SELECT *, sum(c) OVER () AS total FROM g)\n"
        f"SELECT {key}, coalesce(text, '{opening}' || CAST({key} AS VARCHAR) || ')') AS label, text IS NOT NULL AS "
        f"is_recoverable, n AS transaction_volume, {money('c')} AS total_revenue, {share('c', 'total')} AS "
        f"share_of_gap_revenue FROM s JOIN t USING ({key}) WHERE c * 1000 >= total * {per_mille}"
    )


MONTHLY_DISTINCT = (
    "SELECT year, month, user_type, count(DISTINCT user_id) AS unique_registered_users, count(DISTINCT product_id) AS "
    "product_diversity, count(DISTINCT category_id) AS category_diversity{more} FROM dated GROUP BY ALL"
)

CATEGORY_GROWTH = f"""
, g AS (SELECT category_code, month, count(*) AS n, sum(cents) AS c FROM vw WHERE year = 2020 GROUP BY ALL),
dense AS (
  SELECT l.category_code, m.month, coalesce(n, 0) AS n, coalesce(c, 0) AS c
  FROM (SELECT DISTINCT category_code FROM g) l CROSS JOIN (SELECT unnest(range(1, 13))::INT AS month) m
  LEFT JOIN g ON g.category_code = l.category_code AND g.month = m.month
),
lagged AS (SELECT *, lag(c) OVER (PARTITION BY category_code ORDER BY month) AS b FROM dense)
SELECT category_code, month, n AS monthly_volume, {money('c')} AS monthly_revenue, {money('b')} AS revenue_before,
  CAST(sign(c - b) * {ratio('abs(c - b)', 'b', 100)} AS DECIMAL(18,2)) AS growth_pct
FROM lagged
"""

MOVED_BRANDS = f"""
, cut AS (SELECT *, least(order_id % 40, 2)::INT AS part FROM clean),
steps AS (SELECT unnest([1, 2]) AS step),
texts AS (
  SELECT step, product_id, max(brand) FILTER (part < step) AS old, max(brand) FILTER (part = step) AS brought
  FROM cut, steps GROUP BY ALL
),
moving AS (
  SELECT step, product_id, user_type, count(*) AS n, sum(cents) AS c, count(price) AS p
  FROM cut, steps WHERE part < step AND brand IS NULL GROUP BY ALL
)
SELECT ['first', 'second', 'third'][step + 1] AS batch, product_id,
  coalesce(old, 'unknown (Prod: ' || CAST(product_id AS VARCHAR) || ')') AS from_label, brought AS to_label, user_type,
  n AS vol, {money('c')} AS rev, p AS priced
FROM texts JOIN moving USING (step, product_id) WHERE brought IS NOT NULL AND (old IS NULL OR brought > old)
"""


WINDOWS = (
    "CASE WHEN year <> 2020 THEN '05. Outside the Year' WHEN hour BETWEEN 5 AND 10 THEN '01. Morning (Premium Window)' "
    "WHEN hour BETWEEN 11 AND 16 THEN '02. Afternoon (Peak Volume)' WHEN hour BETWEEN 17 AND 22 THEN '03. Evening (Standard)' "
    "ELSE '04. Night (Low Activity)' END"
)
STATUS_ROWS = f"""
, st AS (
  SELECT user_type, {WINDOWS} AS time_window, {_status("category_code", "unlabelled", "Unlabelled", "Labelled")} AS category_status,
    {_status("brand", "unknown", "Unknown", "Known")} AS brand_status, cents
  FROM vw
)"""
LEVELS = "user_type, time_window, category_status, brand_status"

INTEGRITY = f"""
{STATUS_ROWS.strip()},
g AS (
  SELECT {LEVELS}, CAST(GROUPING({LEVELS}) AS INT) AS level, count(*) AS n, coalesce(sum(cents), 0) AS c,
    count(*) FILTER (category_status = 'Unlabelled' OR brand_status = 'Unknown') AS hn,
    coalesce(sum(cents) FILTER (category_status = 'Unlabelled' OR brand_status = 'Unknown'), 0) AS h,
    coalesce(sum(cents) FILTER (category_status = 'Unlabelled'), 0) AS hc,
    coalesce(sum(cents) FILTER (brand_status = 'Unknown'), 0) AS hb
  FROM st GROUP BY CUBE ({LEVELS})
)
SELECT level, {LEVELS}, n AS transaction_volume, {money('c')} AS total_revenue, hn AS hidden_volume, {money('h')} AS hidden_revenue,
  {money('hc')} AS hidden_category_revenue, {money('hb')} AS hidden_brand_revenue, {share('h', 'c')} AS hidden_revenue_pct,
  {share('c - h', 'c')} AS integrity_score
FROM g
"""

_VALUES = {
    "user_type": ["anonymous", "registered"],
    "time_window": [
        "01. Morning (Premium Window)",
        "02. Afternoon (Peak Volume)",
        "03. Evening (Standard)",
        "04. Night (Low Activity)",
        "05. Outside the Year",
    ],
    "category_status": ["Labelled", "Unlabelled"],
    "brand_status": ["Known", "Unknown"],
}


def _associations() -> str:
    columns = list(_VALUES)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    tables = " UNION ALL ".join(
        f"SELECT '{a}' AS first_column, '{b}' AS second_column, x.v AS first_value, y.v AS second_value, "
        f"(SELECT count(*) FROM st WHERE {a} = x.v AND {b} = y.v) AS n "
        f"FROM (SELECT unnest({_VALUES[a]}) AS v) x, (SELECT unnest({_VALUES[b]}) AS v) y"
        for a, b in pairs
    )
    pair = "PARTITION BY first_column, second_column"
    return (
        f"{STATUS_ROWS.strip()}, t AS ({tables}),\n"
        f"m AS (SELECT *, sum(n) OVER ({pair}, first_value) AS r, sum(n) OVER ({pair}, second_value) AS c, "
        f"sum(n) OVER ({pair}) AS total FROM t),\n"
        "v AS (SELECT first_column, second_column, sum(n::DOUBLE * n / nullif(r::DOUBLE * c::DOUBLE, 0)) AS s, "
        "least(count(DISTINCT first_value) FILTER (r > 0), count(DISTINCT second_value) FILTER (c > 0)) AS k FROM m GROUP BY ALL)\n"
        "SELECT first_column, second_column, first_value, second_value, n, r::BIGINT AS first_total, c::BIGINT AS second_total, "
        f"{ratio('n * total', 'r * c')} AS lift, "
        "CAST(CASE WHEN k > 1 THEN sqrt(greatest(s - 1, 0) / (k - 1)) END AS DECIMAL(9,4)) AS cramers_v "
        "FROM m JOIN v USING (first_column, second_column)"
    )


def _outliers() -> str:
    def middle(source: str, value: str) -> str:
        return (
            f"(SELECT dimension, sum({value}) * if(max(k) % 2 = 1, 2, 1) AS m2 FROM (SELECT dimension, {value}, row_number() OVER "
            f"(PARTITION BY dimension ORDER BY {value}) - 1 AS place, count(*) OVER (PARTITION BY dimension) AS k FROM {source} "
            f"WHERE {value} IS NOT NULL) WHERE place IN ((k - 1) // 2, k // 2) GROUP BY dimension)"
        )

    return (
        f"{_segments().rstrip()}, a AS (SELECT *, {aov('c', 'p')} AS aov, CAST({aov('c', 'p')} * 100 AS HUGEINT) AS x FROM seg),\n"
        f"d AS (SELECT a.*, m2, 2 * x - m2 AS apart, abs(2 * x - m2) AS away FROM a LEFT JOIN {middle('a', 'x')} USING (dimension)),\n"
        f"s AS (SELECT d.*, q.m2 AS d4 FROM d LEFT JOIN {middle('d', 'away')} q USING (dimension))\n"
        f"SELECT dimension, segment_name, n AS transaction_count, {money('c')} AS total_revenue, aov AS segment_aov, "
        "CAST(CAST(m2 AS DECIMAL(20,0)) * 0.005 AS DECIMAL(18,3)) AS median_aov, "
        "CAST(CAST(d4 AS DECIMAL(20,0)) * 0.0025 AS DECIMAL(18,4)) AS median_deviation, "
        f"CAST(sign(apart) * {ratio('1349 * away', '1000 * d4')} AS DECIMAL(18,2)) AS robust_score, "
        "coalesce(1349 * away > 3500 * d4, false) AS is_outlier FROM s"
    )


def _gap_hours() -> str:
    hours = "SELECT unnest(range(min(h), max(h) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS h FROM sold"
    return (
        ", rows_ AS (SELECT date_trunc('hour', normalized_event_time) AS h, category_code, brand, cents FROM vw WHERE year = 2020),\n"
        "sold AS (SELECT h, count(*) AS n FROM rows_ GROUP BY h),\n"
        "gap AS (SELECT 'Category' AS dimension, h, count(*) AS n, coalesce(sum(cents), 0) AS c FROM rows_ "
        "WHERE starts_with(category_code, 'unlabelled') GROUP BY h UNION ALL SELECT 'Brand', h, count(*), coalesce(sum(cents), 0) "
        "FROM rows_ WHERE starts_with(brand, 'unknown') GROUP BY h),\n"
        f"dense AS (SELECT dimension, c.h, coalesce(s.n, 0) AS sold, coalesce(g.n, 0) AS n FROM ({hours}) c "
        "CROSS JOIN (SELECT unnest(['Category', 'Brand']) AS dimension) LEFT JOIN sold s USING (h) LEFT JOIN gap g USING (h, dimension)),\n"
        "isle AS (SELECT *, h - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY dimension ORDER BY h) AS run FROM gap),\n"
        "runs AS (SELECT dimension, min(h) AS a, max(h) AS b, count(*) AS hours, sum(n) AS n, sum(c) AS c FROM isle GROUP BY dimension, run)\n"
    )


GAP_RUNS = (
    f"SELECT dimension, a AS run_start, b AS run_end, hours, n::BIGINT AS gap_rows, {money('c')} AS gap_revenue FROM runs"
)
GAP_DISPERSION = (
    ", t AS (SELECT dimension, count(*) AS k, count(*) FILTER (n > 0) AS gap_hours, sum(n) AS s, sum(n * n) AS q, sum(sold) AS ss, "
    "sum(sold * sold) AS sq FROM dense GROUP BY dimension),\n"
    "longest AS (SELECT dimension, count(*) AS runs, max(hours) AS longest_run FROM runs GROUP BY dimension)\n"
    "SELECT dimension, k AS hours, gap_hours, coalesce(runs, 0) AS runs, coalesce(longest_run, 0) AS longest_run, s::BIGINT AS gap_rows, "
    f"{ratio('k * q - s * s', 'k * s')} AS gap_dispersion, {ratio('k * sq - ss * ss', 'k * ss')} AS sales_dispersion "
    "FROM t LEFT JOIN longest USING (dimension)"
)


def _questions() -> dict[str, str]:
    category = _concentration("category_code", _status("category_code", "unlabelled", "Unlabelled", "Labelled"), "label_status")
    brand = _concentration("brand", _status("brand", "unknown", "Unknown", "Known"), "brand_status")
    names = ("unique_registered_users", "product_diversity", "category_diversity")
    within = "".join(f", true AS {name}_within" for name in names)
    totals = on_view("SELECT {label}, user_type, count(*) AS vol, {rev} AS rev, count(price) AS priced FROM vw GROUP BY ALL")
    return {
        "distinct_by_month": on_clean(MONTHLY_DISTINCT.format(more="")),
        "distinct_estimates_by_month": on_clean(MONTHLY_DISTINCT.format(more=within)),
        "portfolio_after_appends": _strategy()["strategy_portfolio"],
        "segmentation_after_appends": _strategy()["user_segmentation"],
        "category_totals_after_appends": totals.replace("{label}", "category_code").replace("{rev}", money("sum(cents)")),
        "brand_totals_after_appends": totals.replace("{label}", "brand").replace("{rev}", money("sum(cents)")),
        "moved_brand_totals": on_clean(MOVED_BRANDS.strip()),
        "category_concentration": category["rows"],
        "brand_concentration": brand["rows"],
        "category_concentration_summary": category["summary"],
        "brand_concentration_summary": brand["summary"],
        "category_growth": on_view(CATEGORY_GROWTH.strip()),
        "gap_runs": on_view(_gap_hours() + GAP_RUNS),
        "gap_dispersion": on_view(_gap_hours().rstrip() + GAP_DISPERSION),
        "outlying_segments": on_view(_outliers()),
        "integrity_score": on_view(INTEGRITY.strip()),
        "status_associations": on_view(_associations()),
        "heavy_gap_categories": _heavy_gaps("category_id", "category_code", "unlabelled (ID: ", 5),
        "heavy_gap_products": _heavy_gaps("product_id", "brand", "unknown (Prod: ", 5),
    }


def all_sql() -> dict[str, str]:
    return {**_quality(), **_cleaning(), **_baseline(), **_strategy(), **_sources(), **_questions()}
