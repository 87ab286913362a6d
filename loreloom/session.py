"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library expects.  Joins are never hinted: Spark
# broadcasts a side only below its size threshold, and AQE splits hot
# partitions of the others.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "loreloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where that is unset, as in a bare test session, a folder below the
    warehouse is used: Spark's own shared place for tables.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"


def new_path(spark: SparkSession, label: str = "table") -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into as many partitions as the session shuffles into, none merged.

    For narrow rows that become much wider in the same stage: Spark would merge
    small partitions by their size before that.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def few_rows(spark: SparkSession) -> None:
    """Rows that hold whole files go to Python 500 at a time, unless the session has a value of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "500")


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read on from there.

    For results that several branches of a plan use: the work is done once,
    survives the loss of executors, and later scans prune columns and rows.
    Ids are long hex strings, so files are packed with a codec that shortens them.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
