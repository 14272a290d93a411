"""Summaries that survive an append: each batch is summed up alone, and totals are put together from the batches' sums.

Everything kept adds up (or merges by maximum, or as a set or sketch), so no earlier facts are read again:

- ``products`` and ``hours``: the measures all ten reports are computed from,
- ``users``: the distinct users per user type, and ``sketches``: mergeable distinct counts per hour,
- ``map_*``: the largest text per key, ``gaps_*``: measures of rows without a text,
- ``labels_*``: measures per filled label. A batch can bring a larger text for a key; then the rows that were filled by the
  old one belong to another label. Only those groups move: they are taken from the old label and added to the new one, and
  ``moves_*`` keeps what moved.

A batch counts from when its commit is written, after all its tables. A batch that failed half-way is written again from the
start, one that is committed is left as it is, so appends can be retried. Compaction puts all batches into one; it is committed
in the same way, by naming the batches it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilltrail.functions import ratios as R
from tilltrail.operators import measures as M
from tilltrail.operators.imputation import BRAND, CATEGORY, Dimension
from tilltrail.plans import distincts, summaries
from tilltrail.plans.strategy import CLOCK, with_user_type
from tilltrail.session import folder_exists, remove_folder

DIMENSIONS = (CATEGORY, BRAND)
PRODUCT_KEYS = ["product_id", "brand", "category_id", "category_code", "user_type"]
COMMIT = "batch string, replaces array<string>"


class SummaryStore:
    """The summaries of all batches appended so far, in one folder. One writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # What is stored.

    def batches(self) -> list[str]:
        """Committed batches that no compaction replaced, one row each in the folder of commits."""
        where = f"{self.folder}/commits"
        if not folder_exists(self.spark, where):
            return []
        commits = self.spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(where).collect()
        replaced = {name for commit in commits for name in commit.replaces}
        return sorted(commit.batch for commit in commits if commit.batch not in replaced)

    def _stored(self, table: str) -> DataFrame | None:
        paths = [f"{self.folder}/{table}/{batch}" for batch in self.batches()]
        return self.spark.read.parquet(*paths) if paths else None

    def _table(self, table: str) -> DataFrame:
        found = self._stored(table)
        if found is None:
            raise ValueError(f"no batch has been appended to {self.folder}")
        return found

    def products(self) -> DataFrame:
        return self._table("products").groupBy(*PRODUCT_KEYS).agg(*M.merged_measures())

    def hours(self) -> DataFrame:
        return self._table("hours").groupBy(CLOCK, "user_type").agg(*M.merged_measures())

    def users(self) -> DataFrame:
        return self._table("users").distinct()

    def sketches(self) -> DataFrame:
        return distincts.merged_sketches(self._table("sketches"), CLOCK, "user_type")

    def value_map(self, dim: Dimension) -> DataFrame:
        """The largest text per key, as ``mapped_<value>``."""
        text = f"mapped_{dim.value}"
        return self._table(f"map_{dim.value}").groupBy(dim.key).agg(F.max(text).alias(text))

    def label_totals(self, dim: Dimension) -> DataFrame:
        """Measures per filled label and user type; labels that all rows moved away from are gone."""
        totals = self._table(f"labels_{dim.value}").groupBy(dim.value, "user_type").agg(*M.merged_measures())
        return totals.filter("vol != 0")

    def moves(self, dim: Dimension) -> DataFrame:
        """What batches moved from one label to another: ``batch``, the key, both labels, measures."""
        return self._table(f"moves_{dim.value}")

    def reports(self) -> dict[str, DataFrame]:
        """The ten exported reports by file name."""
        products = self.products()
        sold = products.select("user_type", F.lit(None).cast("decimal(20,0)").alias("user_id"), "product_id").distinct()
        bought = self.users().select("user_type", "user_id", F.lit(None).cast("decimal(20,0)").alias("product_id"))
        return summaries.reports_from(products, self.hours(), buyers=sold.unionByName(bought))

    # Appending.

    def append(self, facts: DataFrame, batch: str) -> bool:
        """Add a batch of clean rows under a name of its own; False if that name is committed already."""
        if folder_exists(self.spark, f"{self.folder}/commits/{batch}/_SUCCESS"):
            return False
        typed = with_user_type(facts)
        products = self._write("products", batch, summaries.product_summary(typed))
        self._write("hours", batch, summaries.hour_summary(typed))
        self._write("users", batch, typed.filter("user_id is not null").select("user_type", "user_id").distinct())
        self._write("sketches", batch, distincts.hour_sketches(typed))
        for dim in DIMENSIONS:
            self._append_labels(dim, batch, products)
        self._commit(batch, [])
        return True

    def _append_labels(self, dim: Dimension, batch: str, products: DataFrame) -> None:
        """Label totals of a batch, and what its new texts move among the earlier ones."""
        text, gap = f"mapped_{dim.value}", F.col(dim.value).isNull()
        groups = products.groupBy(dim.key, dim.value, "user_type").agg(*M.merged_measures())
        known = groups.filter(~gap & F.col(dim.key).isNotNull())
        brought = known.groupBy(dim.key).agg(F.max(dim.value).alias(text))
        keys = groups.select(dim.key).distinct().join(brought, dim.key, "left").withColumnRenamed(text, "_brought")
        earlier_map, earlier_gaps = self._stored(f"map_{dim.value}"), self._stored(f"gaps_{dim.value}")
        if earlier_map is None:
            keys = keys.withColumn("_old", F.lit(None).cast("string"))
        else:
            # Only keys of the batch are looked up.
            old = earlier_map.join(keys.select(dim.key), dim.key, "left_semi").groupBy(dim.key).agg(F.max(text).alias("_old"))
            keys = keys.join(old, dim.key, "left")
        keys = keys.withColumn("_new", F.greatest("_old", "_brought"))
        keys = self._write(f"keys_{dim.value}", batch, keys)

        gaps = groups.filter(gap).select(dim.key, "user_type", *M.MEASURES)
        filled = gaps.join(keys, dim.key, "left").withColumn(dim.value, F.coalesce("_new", dim.gap_label()))
        totals = groups.filter(~gap).select(dim.value, "user_type", *M.MEASURES)
        totals = totals.unionByName(filled.select(dim.value, "user_type", *M.MEASURES))

        changed = keys.filter("_brought is not null and (_old is null or _brought > _old)")
        if earlier_gaps is None:
            earlier_gaps = gaps.limit(0)
        moving = earlier_gaps.groupBy(dim.key, "user_type").agg(*M.merged_measures()).join(changed, dim.key)
        moved = moving.select(
            F.lit(batch).alias("batch"), dim.key, F.coalesce("_old", dim.gap_label()).alias("from_label"),
            F.col("_new").alias("to_label"), "user_type", *M.MEASURES,
        )
        moved = self._write(f"moves_{dim.value}", batch, moved)
        taken = [(-F.col(name)).cast(kind).alias(name) for name, kind in zip(M.MEASURES, ("bigint", R.MONEY, "bigint"))]
        totals = totals.unionByName(moved.select(F.col("to_label").alias(dim.value), "user_type", *M.MEASURES)).unionByName(
            moved.select(F.col("from_label").alias(dim.value), "user_type", *taken)
        )
        self._write(f"labels_{dim.value}", batch, totals.groupBy(dim.value, "user_type").agg(*M.merged_measures()))
        self._write(f"gaps_{dim.value}", batch, gaps)
        self._write(f"map_{dim.value}", batch, brought)

    def _write(self, table: str, batch: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{table}/{batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _commit(self, batch: str, replaces: list[str]) -> None:
        commit = self.spark.createDataFrame([(batch, replaces)], COMMIT)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{batch}")

    # Compaction.

    def compact(self, name: str) -> None:
        """Put all batches into one of this name. Readers of the old ones go on until ``remove_replaced``."""
        replaced = self.batches()
        if not replaced or name in replaced:
            return
        merged = {"products": self.products(), "hours": self.hours(), "users": self.users(), "sketches": self.sketches()}
        for dim in DIMENSIONS:
            gaps = self._table(f"gaps_{dim.value}").groupBy(dim.key, "user_type").agg(*M.merged_measures())
            merged |= {f"map_{dim.value}": self.value_map(dim), f"gaps_{dim.value}": gaps}
            merged |= {f"labels_{dim.value}": self.label_totals(dim), f"moves_{dim.value}": self.moves(dim)}
        for table, df in merged.items():
            self._write(table, name, df)
        self._commit(name, replaced)

    def remove_replaced(self) -> None:
        """Delete the tables of batches that a compaction replaced; their commits stay, so they are not appended again."""
        live = set(self.batches())
        commits = self.spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{self.folder}/commits").collect()
        tables = ["products", "hours", "users", "sketches"]
        tables += [f"{kind}_{dim.value}" for dim in DIMENSIONS for kind in ("map", "gaps", "labels", "moves", "keys")]
        for batch in {commit.batch for commit in commits} - live:
            for table in tables:
                remove_folder(self.spark, f"{self.folder}/{table}/{batch}")
