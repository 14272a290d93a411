"""Intermediate tables in the shared folder, and keys that tell rows apart."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilltrail.session import remove_folder, scratch_folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What follows neither repeats the work nor depends on the executors that did it.
    """
    return stored_at(df, label)[0]


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = scratch_folder(df.sparkSession, f"{label}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    remove_folder(spark, path)


def row_key() -> Column:
    """A hash of a document's id and text; with the id it tells rows that repeat an id apart."""
    return F.xxhash64("doc_id", "text")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores before it one that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_rows(docs: DataFrame, keys: DataFrame, how: str, key: str | None = None) -> DataFrame:
    """Documents whose ``(doc_id, row_key)`` is (``left_semi``) or is not (``left_anti``) in ``keys``.

    All columns stay as they are, whatever their names; with ``key`` the row key is added under that name.
    """
    own = key or free_name(docs, "_row_key")
    other, theirs = free_name(docs, "_doc_id"), free_name(docs, "_key")
    left = docs.withColumn(own, row_key())
    right = keys.select(F.col("doc_id").alias(other), F.col("row_key").alias(theirs))
    same = (F.col(own) == F.col(theirs)) & F.col("doc_id").eqNullSafe(F.col(other))
    return left.join(right, same, how).select(*docs.columns, *([own] if key else []))
