"""Session settings the jobs are written for, and their folder for intermediate tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Join sides are broadcast only when Spark has measured them: from file sizes at
    # planning time, from shuffle statistics at run time. Hot keys are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # All reports together have more generated stages than the 100 that are kept by default.
    "spark.sql.codegen.cache.maxEntries": "1000",
}


def build_session(
    app: str = "tilltrail",
    master: str | None = None,
    extra: dict[str, str] | None = None,
    shuffle_partitions: int | None = None,
) -> SparkSession:
    """A session with the settings above.

    ``shuffle_partitions`` is where adaptive execution starts from before it merges small
    partitions. Choose it by the largest shuffle: shuffled bytes over about 128 MB, so some 100,000
    where a tenth of 100 TB is shuffled. Spark's default of 200 would make such partitions far larger
    than an executor's memory, and splitting hot keys does not help where all are evenly large.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**SETTINGS, **(extra or {})}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, else the warehouse.

    Both are named by the cluster and seen by all executors. Where neither is named, the warehouse is a
    folder below the driver's own, which other machines do not see: such a session must be local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        configured = context.getConf().contains("spark.sql.warehouse.dir")
        if not configured and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A path for one intermediate table of this application, deleted when its driver ends.

    The same label gives the same path, so a second run overwrites what the first one stored;
    ``fresh_folder`` gives another one each time.
    """
    path = f"{shared_folder(spark)}/tilltrail-{spark.sparkContext.applicationId}/{label}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


_calls: dict[tuple[str, str], itertools.count] = {}


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A scratch folder that no earlier call of this application got: what was stored there stays readable."""
    n = next(_calls.setdefault((spark.sparkContext.applicationId, label), itertools.count(1)))
    return scratch_folder(spark, label if n == 1 else f"{label}-{n}")


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a frame to a folder of its own and read it back; the folder is returned to be removed."""
    path = fresh_folder(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
