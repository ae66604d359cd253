"""Effects that wait to be carried out: numbered without gaps over appends, under keys that a replay repeats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.fingerprints import stable_hash

from .effects import numbered


def effect_key(*parts: Column | str) -> Column:
    """The same key for the same effect, whoever makes it and however often; null parts differ from empty ones."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\0")) for p in parts]
    return stable_hash(F.concat_ws("\x1f", *texts))


@dataclass(frozen=True)
class Outbox:
    """An append-only table of effects in a folder, and which of them were carried out.

    Each append has a number and a folder of its own: one that is run again
    writes the same rows with the same ids over its own.  The last id of each
    append is kept beside it, and the next one goes on from there.  `keys` are
    the columns that make an effect what it is; of equal ones within an append
    one stays, and one that an earlier append has is not appended again.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]

    def _at(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={number}"

    def last_id(self, number: int) -> int:
        """The last id of the appends before this one; 0 before the first."""
        return self.spark.read.schema("last bigint").parquet(self._at("mark", number - 1)).first()[0] if number else 0

    def append(self, rows: DataFrame, number: int, time: str, tie: str) -> None:
        """Adds effects in the order of (time, tie), which is total, with id and effect_key."""
        keyed = rows.withColumn("effect_key", effect_key(*self.keys))
        first = keyed.groupBy("effect_key").agg(F.min_by(F.struct(*rows.columns), F.struct(time, tie)).alias("_row")).select("effect_key", "_row.*")
        if number:
            first = first.join(self.rows(number).select("effect_key"), "effect_key", "left_anti")
        last = self.last_id(number)
        numbered(first, "id", time, tie, last + 1).write.mode("overwrite").parquet(self._at("append", number))
        mark = self._rows(number).agg(F.max("id").alias("last"))
        mark.select(F.coalesce("last", F.lit(last)).cast("bigint").alias("last")).write.mode("overwrite").parquet(self._at("mark", number))

    def _rows(self, *numbers: int) -> DataFrame:
        return self.spark.read.parquet(*(self._at("append", n) for n in numbers))

    def rows(self, appends: int) -> DataFrame:
        """The effects of the first appends."""
        return self._rows(*range(appends))

    def deliver(self, keys: DataFrame, number: int) -> None:
        """Notes under a number of its own that the effects with these effect_keys were carried out."""
        keys.select("effect_key").distinct().write.mode("overwrite").parquet(self._at("delivered", number))

    def pending(self, appends: int, deliveries: int = 0) -> DataFrame:
        """The effects of the first appends that none of the first deliveries has, for whoever carries them out; who stops before noting it meets them again, under the same keys."""
        rows = self.rows(appends)
        if not deliveries:
            return rows
        done = self.spark.read.schema("effect_key string").parquet(*(self._at("delivered", n) for n in range(deliveries)))
        return rows.join(done, "effect_key", "left_anti")
