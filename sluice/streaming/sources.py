"""Streams of messages in, rows out, and what comes too late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.effects import observations
from sluice.operators.features import features
from sluice.schemas import TABLES

#: How late a row may come.
LATENESS = 600


def message_stream(spark: SparkSession, path: str, kind: str = "parquet", edits: bool = True, **options: str) -> DataFrame:
    """New and edited messages from files that appear in a folder; `edits=False` leaves out the edited ones."""
    rows = spark.readStream.schema(TABLES["messages"]).format(kind).options(**options).load(path)
    return rows if edits else rows.where("update_type <> 'edited_message'")


def timed(rows: DataFrame, time: str = "ts", seconds: int = LATENESS) -> DataFrame:
    """Adds event_time, with a watermark: what operators with timers want."""
    return rows.withColumn("event_time", F.timestamp_seconds(time)).withWatermark("event_time", f"{seconds} seconds")


def observe(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends an observation of every message of the stream, edits too, to a table."""
    return observations(features(messages)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def split_late(rows: DataFrame, on_time: str, late: str, checkpoint: str, time: str = "ts", seconds: int = LATENESS) -> StreamingQuery:
    """Writes rows that come in time to one folder, and those more than so many seconds behind the newest row of earlier batches to another.

    A batch has a folder of its own in each, so that one that is run again
    writes the same; the newest time up to each batch is kept beside them, a
    row a batch, and the next batch reads that of the last one only.
    """
    marks = f"{late.rstrip('/')}-newest"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = (spark.read.schema("newest bigint").parquet(f"{marks}/batch={number - 1}").first()[0] or 0) if number else 0
        edge = before - seconds
        batch.where(F.col(time) >= edge).write.mode("overwrite").parquet(f"{on_time}/batch={number}")
        batch.where(F.col(time) < edge).write.mode("overwrite").parquet(f"{late}/batch={number}")
        # Late rows are older than those before, so only the others can be the newest.
        own = spark.read.schema(batch.schema).parquet(f"{on_time}/batch={number}").agg(F.max(time).cast("bigint").alias("newest"))
        own.select(F.greatest("newest", F.lit(before)).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
