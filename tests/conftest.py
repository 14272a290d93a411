from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import types as T  # noqa: E402

from tilltrail import schema as S  # noqa: E402
from tilltrail.session import build_session  # noqa: E402

DATA = "/root/testdata"

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("user_id", S.ID_TYPE),
        T.StructField("normalized_event_time", T.TimestampNTZType()),
        T.StructField("product_id", S.ID_TYPE),
        T.StructField("category_id", S.CATEGORY_ID_TYPE),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", S.PRICE_TYPE),
    ]
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tilltrail-tests",
        "local[*]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.sql.maxMetadataStringLength": "10000",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return f"{DATA}/sf0.001"


@pytest.fixture
def sales(spark):
    """Clean rows from short tuples, with defaults for what a test does not care about."""

    def build(*rows: dict):
        records = []
        for row in rows:
            price = row.get("price", "1.00")
            records.append(
                (
                    None if row.get("user") is None else Decimal(row["user"]),
                    row.get("at", dt.datetime(2020, 6, 1, 12)),
                    Decimal(row.get("product", 1)),
                    Decimal(row.get("category_id", 1)),
                    row.get("code", "c.one"),
                    row.get("brand", "acme"),
                    None if price is None else Decimal(price),
                )
            )
        return spark.createDataFrame(records, CLEAN_SCHEMA)

    return build


def rows_of(df, *keys: str) -> dict:
    """Rows as dicts, by the values of the keys (one value: itself)."""
    found = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        found[key[0] if len(key) == 1 else key] = row.asDict()
    return found
