"""Column layouts and the fixed texts that reports carry."""

from __future__ import annotations

from pyspark.sql import types as T

# Declared column types of the purchase records.
ID_TYPE = T.DecimalType(20, 0)
CATEGORY_ID_TYPE = T.DecimalType(23, 0)
PRICE_TYPE = T.DecimalType(8, 2)

REVENUE_TYPE = T.DecimalType(28, 2)

# Raw record layout. The row number is a long, not an int, because
# a load of the size this is meant for has more than 2^31 rows.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("serial_number", T.LongType()),
        T.StructField("user_id", ID_TYPE),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("order_id", ID_TYPE),
        T.StructField("product_id", ID_TYPE),
        T.StructField("category_id", CATEGORY_ID_TYPE),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", PRICE_TYPE),
    ]
)
MAX_LENGTHS = {"category_code": 50, "brand": 20}

CLEAN_COLUMNS = [
    "id",
    "user_id",
    "event_time",
    "normalized_event_time",
    "order_id",
    "product_id",
    "category_id",
    "category_code",
    "brand",
    "price",
]
VIEW_COLUMNS = [
    "id",
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
BASELINE_COLUMNS = [
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

# Texts that appear in results.
ANONYMOUS = "anonymous"
REGISTERED = "registered"
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKDAY_WIDTH = 9
PREMIUM_HOUR = "⭐ Premium Window"
STANDARD_HOUR = "Standard"
TIME_WINDOWS = [
    (5, 10, "01. Morning (Premium Window)"),
    (11, 16, "02. Afternoon (Peak Volume)"),
    (17, 22, "03. Evening (Standard)"),
]
NIGHT_WINDOW = "04. Night (Low Activity)"
ROLE_STAR = "STAR (High Value & Efficient)"
ROLE_COW = "CASH COW (High Volume Traffic)"
ROLE_PLAY = "EFFICIENCY PLAY (Low AOV/High Share)"
ROLE_TAIL = "LONG TAIL / OPPORTUNITY"

# Years, offsets and category codes the reports are about.
EPOCH_YEAR = 1970
REPORT_YEAR = 2020
CLOCK_OFFSET_HOURS = 8
SMARTPHONES = "electronics.smartphone"
FRIDGES = "appliances.kitchen.refrigerators"
PORTFOLIO_THRESHOLD = "0.005"
