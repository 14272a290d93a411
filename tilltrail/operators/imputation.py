"""Filling missing categories and brands, and labelling what cannot be filled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimension:
    """A text column, the id that determines it, and the words used where it is missing."""

    name: str
    value: str
    key: str
    opening: str
    gap_prefix: str
    status_column: str
    gap_status: str
    known_status: str

    def gap_label(self) -> Column:
        return F.concat(F.lit(self.opening), F.col(self.key).cast("string"), F.lit(")"))

    def is_gap(self) -> Column:
        return F.col(self.value).startswith(self.gap_prefix)

    def status(self, known_status: str | None = None) -> Column:
        known = known_status or self.known_status
        return F.when(self.is_gap(), self.gap_status).otherwise(known)


# Label and status texts of the two dimensions.
CATEGORY = Dimension(
    name="Category",
    value="category_code",
    key="category_id",
    opening="unlabelled (ID: ",
    gap_prefix="unlabelled",
    status_column="label_status",
    gap_status="Unlabelled",
    known_status="Labelled",
)
BRAND = Dimension(
    name="Brand",
    value="brand",
    key="product_id",
    opening="unknown (Prod: ",
    gap_prefix="unknown",
    status_column="brand_status",
    gap_status="Unknown",
    known_status="Known",
)


def value_map(df: DataFrame, dim: Dimension, strategy: str = "max") -> DataFrame:
    """One row per key with the text to fill in, as ``mapped_<value>``.

    ``max`` takes the largest text, ``mode`` the most frequent (largest on ties). Both first
    count the pairs of key and text, by hash and before the shuffle: a key with a third of all rows
    costs no more than any other, and only pairs are sorted. (A bare maximum of a text sorts every
    row, and Spark drops a mere ``distinct`` below it; ranking by the count as well keeps the pairs.)
    """
    orders = {"max": (dim.value, "_n"), "mode": ("_n", dim.value)}
    if strategy not in orders:
        raise ValueError(f"unknown strategy {strategy!r}: use 'max' or 'mode'")
    known = df.filter(F.col(dim.value).isNotNull())
    pairs = known.groupBy(dim.key, dim.value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by(dim.value, F.struct(*orders[strategy]))
    return pairs.groupBy(dim.key).agg(best.alias(f"mapped_{dim.value}"))


def impute(df: DataFrame, dim: Dimension, mapping: DataFrame) -> DataFrame:
    """Own text, else the mapped one, else a label that names the key. Row by row.

    The join carries no hint: Spark broadcasts the map if its measured size allows and otherwise
    shuffles both sides. The hash of the key as a second join key spreads nothing, but gives the map
    an exchange of its own. Without it the map's aggregate would sit right below the join, and Spark
    splits a hot key only between two plain exchanges. A row without a key meets no map.
    """
    mapped, key_hash = f"mapped_{dim.value}", F.hash(dim.key)
    filled = F.coalesce(F.col(dim.value), F.col(mapped), dim.gap_label())
    joined = df.withColumn("_key_hash", key_hash).join(
        mapping.withColumn("_key_hash", key_hash), [dim.key, "_key_hash"], "left"
    )
    return joined.withColumn(dim.value, filled).drop(mapped, "_key_hash")


def impute_category(df: DataFrame, raw: DataFrame | None = None, strategy: str = "max") -> DataFrame:
    return _impute_gaps(df, CATEGORY, df if raw is None else raw, strategy)


def impute_brand(df: DataFrame, raw: DataFrame | None = None, strategy: str = "max") -> DataFrame:
    return _impute_gaps(df, BRAND, df if raw is None else raw, strategy)


def _impute_gaps(df: DataFrame, dim: Dimension, raw: DataFrame, strategy: str) -> DataFrame:
    missing = F.col(dim.value).isNull()
    filled = impute(df.filter(missing), dim, value_map(raw, dim, strategy))
    return df.filter(~missing).unionByName(filled)


def impute_both(
    df: DataFrame,
    raw: DataFrame | None = None,
    strategy: str = "max",
    maps: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Fill both columns. Complete rows pass by; only rows with a gap meet the two joins.

    ``maps`` holds stored maps by the dimension's name; a map that is not given is made from ``raw``.
    """
    source = df if raw is None else raw
    gap = F.col(CATEGORY.value).isNull() | F.col(BRAND.value).isNull()
    filled = df.filter(gap)
    for dim in (CATEGORY, BRAND):
        given = (maps or {}).get(dim.name)
        filled = impute(filled, dim, value_map(source, dim, strategy) if given is None else given)
    return df.filter(~gap).unionByName(filled)


def impute_groups(groups: DataFrame, dim: Dimension) -> DataFrame:
    """The same filling for rows that are already aggregated by key and text.

    Reports need totals, not rows. They aggregate by the raw key and text first, which combines
    before the shuffle, and fill here, where a key has as many rows as it has spellings. The map
    is the largest text over those rows, so no second scan and no join of fact rows is needed.
    Rows without a key share nothing, so they take no text from each other.
    """
    largest = F.max(dim.value).over(Window.partitionBy(dim.key))
    mapped = F.when(F.col(dim.key).isNotNull(), largest)
    return groups.withColumn(dim.value, F.coalesce(F.col(dim.value), mapped, dim.gap_label()))
