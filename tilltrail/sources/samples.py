"""Purchase records derived from order tables (lineitem, orders, part).

Every order line becomes one purchased item. Orders and parts are looked up by their unique
keys with left joins, so a lookup can be left out when no column of it is asked for: the number
of rows does not change. A test checks that the keys are unique. What depends on the order or the
part alone is derived before the join, once per order or part, and so is the price, which is narrower than what it
is made of and goes through the shuffles of both joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilltrail import schema as S

ALL = [field.name for field in S.RAW_SCHEMA]

# Declared, so that no job reads file footers to find them out.
TABLES = {
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "part": "p_partkey long, p_brand string, p_size int",
}

# Fixed values of the mapping: how each column follows from the order tables.
OF_ORDERS = {
    "user_id": "cast(if(o_orderkey % 4 = 0, o_custkey, null) as decimal(20,0))",
    "event_time": """timestampadd(SECOND,
        if(o_orderkey % 141 = 0, 28800L, 1578211200L
           + pmod(datediff(o_orderdate, date'1995-01-01'), 320) * 86400L + o_orderkey * 7919 % 86400),
        timestamp_ntz'1970-01-01 00:00:00')""",
}
OF_PARTS = {
    "category_id": "cast(2268105388421284352L + p_size as decimal(23,0))",
    "category_code": f"""case
        when p_size % 4 = 0 then null
        when p_size = 7 then '{S.SMARTPHONES}'
        when p_size = 13 then '{S.FRIDGES}'
        when p_size = 21 then concat('dept0.cat21', p_partkey % 3)
        else concat('dept', p_size % 7, '.cat', p_size) end""",
    "brand": "if(p_partkey % 20 = 0, null, lower(replace(p_brand, '#', '')))",
}
OF_LINES = {
    "serial_number": "l_orderkey * 8 + l_linenumber",
    "user_id": "user_id",
    "event_time": "event_time",
    "order_id": "cast(l_orderkey as decimal(20,0))",
    "product_id": "cast(l_partkey as decimal(20,0))",
    "category_id": "category_id",
    "category_code": "if(l_linenumber = 5, null, category_code)",
    "brand": "if(l_partkey % 20 = 1 and l_linenumber = 6, null, brand)",
    "price": "price",
}
PRICE = "cast(l_extendedprice as decimal(8,2)) as price"


def sample_purchases(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    wanted = columns or ALL
    unknown = set(wanted) - set(ALL)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    rows = _table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_linenumber", PRICE)
    for name, key, line_key, derived in (
        ("orders", "o_orderkey", "l_orderkey", OF_ORDERS),
        ("part", "p_partkey", "l_partkey", OF_PARTS),
    ):
        asked = [c for c in derived if c in wanted]
        if asked:
            lookup = _table(spark, folder, name).selectExpr(key, *[f"{derived[c]} as {c}" for c in asked])
            rows = rows.join(lookup, F.col(line_key) == F.col(key), "left")
    return rows.selectExpr(*[f"{OF_LINES[c]} as {c}" for c in wanted])


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")
