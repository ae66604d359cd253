"""Keyed tables in the shared folder that numbered batches change, and that a batch which is run again changes no further."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Versions:
    """A keyed table that micro-batches change: `base=n` has all of it before batch n, `batch=n` the rows that batch n set.

    A base is written every `every` batches, so a batch reads the last base and
    at most so many sets of changes, however long the stream has run.  Of a
    key's rows the last batch's holds.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: str
    every: int = 32

    def create(self, rows: DataFrame) -> None:
        """The table before the first batch."""
        self._as_declared(rows).write.mode("overwrite").parquet(f"{self.path}/base=0")

    def _as_declared(self, rows: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], self.schema).schema
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def before(self, batch: int) -> DataFrame:
        """The table as the batches before this one left it."""
        return self._since(max(0, batch - 1) // self.every * self.every, batch)

    def _since(self, base: int, batch: int) -> DataFrame:
        rows = self._read(f"{self.path}/base={base}")
        if not batch:
            return rows
        changes = self._read(*(f"{self.path}/batch={n}" for n in range(base, batch))).withColumn("_batch", F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/", 1).cast("int"))
        rest = [c for c in rows.columns if c not in self.keys]
        # Of base and changes together the last row of each key: one aggregate, partial before its shuffle.
        both = rows.withColumn("_batch", F.lit(-1)).unionByName(changes)
        last = both.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
        return last.select(*self.keys, "_last.*").select(*rows.columns)

    def settle(self, batch: int) -> None:
        """Writes the base that the batches after this one begin from, where one is due."""
        if batch and batch % self.every == 0:
            self._since(batch - self.every, batch).write.mode("overwrite").parquet(f"{self.path}/base={batch}")

    def set(self, rows: DataFrame, batch: int) -> None:
        """What a batch makes of its keys; one that is run again replaces its rows."""
        self._as_declared(rows).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
