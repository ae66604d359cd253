"""Tables in the folder that all executors share, and their removal."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a finished step's shuffle files go at once, and not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own on a single machine, and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"sluice-shared-{os.getpid()}")
        os.makedirs(found, exist_ok=True)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    if context is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context.hadoopConfiguration()).delete(at, True)


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sluice/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, and survives lost executors.

    The table lives as long as the application, or until `forget`.
    """
    spark = df.sparkSession
    if _folder(spark) not in _KNOWN:
        _KNOWN[_folder(spark)] = spark
    return _write(df, f"{_folder(spark)}/{name}-{uuid.uuid4().hex}")


_KNOWN: dict[str, SparkSession] = {}


@atexit.register
def _at_exit() -> None:
    for spark in list(_KNOWN.values()):
        if spark.sparkContext._jsc is not None:
            forget(spark)


def forget(spark: SparkSession) -> None:
    """Deletes all tables of this application; DataFrames that read them can't be used any more."""
    _delete(spark, _folder(spark))
    _KNOWN.pop(_folder(spark), None)


class Scratch:
    """Tables that only an operator's own steps read; `drop` deletes them all once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{_folder(spark)}/scratch-{uuid.uuid4().hex}"
        _KNOWN.setdefault(_folder(spark), spark)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return _write(df, f"{self.path}/{name}-{uuid.uuid4().hex}")

    def drop(self) -> None:
        _delete(self.spark, self.path)
