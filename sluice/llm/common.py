"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.sources.shared import Scratch, forget, shared_dir, written

__all__ = ["Scratch", "bounded_batches", "forget", "free_name", "quoted", "shared_dir", "table", "written"]

_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, where it sets no bounds of its own, so that a Python worker holds a few MB of text at a time."""
    for name, value in _BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
