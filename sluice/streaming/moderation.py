"""The cascade on a stream of messages, against tables of state that each micro-batch reads at one version and changes for the next.

A micro-batch is decided by the same operators as a whole table.  It sees the
state as all batches before it left it; what it teaches (hits on fingerprints,
messages seen, vote sessions) is written under its own number and seen from
the next batch on.  So a batch that is run again, after a failure, reads the
same state and writes the same rows over its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators import lookup, rules, state
from sluice.operators.features import features
from sluice.settings import DEFAULT, Settings
from sluice.sources.shared import Scratch
from sluice.sources.versions import Versions
from sluice.streaming.sources import LATENESS


#: Tables of state: their keys and columns.
STATE = {
    "fingerprints": (("value",), "value string, id bigint, fingerprint_type string, weight double, source string, hits bigint"),
    "users": (("chat_id", "user_id"), "chat_id bigint, user_id bigint, reputation_score double, messages_seen bigint, first_seen_at bigint, last_seen_at bigint"),
    "sessions": (("id",), "id bigint, chat_id bigint, suspect_user_id bigint, original_message_id bigint, status string, skeleton_hash string, content_hash string, created_at bigint, expires_at bigint"),
}
#: What later messages are compared with: who sent which skeleton when.
SENT = "message_id bigint, user_id bigint, skeleton_hash string, created_at bigint"
SPAN = "batch int, last bigint"
DECISION = "message_id bigint, chat_id bigint, user_id bigint, action string, reason string, confidence double, scorer boolean, fp_value string"


@dataclass(frozen=True)
class Moderation:
    """The cascade with its state in a folder that all executors share.

    `profiles` and `previews` are tables of what is known of senders and links.
    With `learn=False` the state stays as it was created.
    """

    spark: SparkSession
    path: str
    profiles: DataFrame
    previews: DataFrame
    settings: Settings = DEFAULT
    learn: bool = True
    every: int = 32
    tables: dict[str, Versions] = field(init=False)

    def __post_init__(self) -> None:
        made = {name: Versions(self.spark, f"{self.path}/{name}", keys, schema, self.every) for name, (keys, schema) in STATE.items()}
        object.__setattr__(self, "tables", made)

    def create(self, **rows: DataFrame) -> None:
        """State before the first message: a table for each name in `STATE`, empty where none is given; columns that are not given are null."""
        for name, table in self.tables.items():
            empty = self.spark.createDataFrame([], table.schema)
            table.create(empty.unionByName(rows[name].select(*(c for c in empty.columns if c in rows[name].columns)), allowMissingColumns=True) if name in rows else empty)

    def _spans(self, batch: int) -> list[tuple[int, int]]:
        """(batch, time of its last message) of the earlier batches that a message may still look back to."""
        if not batch:
            return []
        return [(r.batch, r.last) for r in self.spark.read.schema(SPAN).parquet(f"{self.path}/spans/batch={batch - 1}").collect()]

    def _sent(self, own: DataFrame, batch: int) -> DataFrame:
        """Writes what this batch sent, and returns what earlier ones sent in the look-back of its messages.

        Beside its messages a batch keeps a list of the batches that later
        ones may need, those of the last two look-backs and of what comes late,
        so no batch reads more than the last list and the batches it needs.
        """
        window = self.settings.repeat_window_seconds
        own.write.mode("overwrite").parquet(f"{self.path}/sent/batch={batch}")
        least, newest = own.agg(F.min("created_at"), F.max("created_at")).first()
        earlier = self._spans(batch)
        latest = max([last for _, last in earlier] + ([] if newest is None else [newest]), default=0)
        kept = [(n, last) for n, last in [*earlier, (batch, newest)] if last is not None and last >= latest - 2 * window - LATENESS]
        self.spark.createDataFrame(kept, SPAN).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/spans/batch={batch}")
        near = [n for n, last in earlier if least is not None and last >= least - window]
        if not near:
            return self.spark.createDataFrame([], SENT)
        return self.spark.read.schema(SENT).parquet(*(f"{self.path}/sent/batch={n}" for n in near)).where(F.col("created_at") >= least - window)

    def decide(self, messages: DataFrame, batch: int) -> None:
        """Decides one micro-batch and writes its decisions, what it sent and what it teaches, under its number."""
        scratch = Scratch(self.spark)
        for table in self.tables.values():
            table.settle(batch)
        known = {name: table.before(batch) for name, table in self.tables.items()}
        rows = scratch.written(features(messages), "feature-rows")
        own = rows.select("message_id", "user_id", "skeleton_hash", "created_at")
        earlier = self._sent(own, batch)
        told = lookup.with_preview(lookup.with_profile(rows, self.profiles), self.previews)
        best = lookup.strongest_fingerprint(told, known["fingerprints"], phrase_texts=lookup.phrase_fields(), scratch=scratch)
        counted = lookup.prior_senders(earlier.unionByName(own), self.settings.repeat_window_seconds, scratch)
        again = lookup.open_repeats(rows, known["sessions"], self.settings, scratch)
        found = lookup.with_context(told, known["users"], self.settings)
        for more in (best, counted, again):
            found = found.join(more, "message_id", "left")
        decided = rules.decide(found, self.settings).select("message_id", "chat_id", "user_id", "action", "reason", "confidence", "scorer", "fp_value")
        decided.write.mode("overwrite").parquet(f"{self.path}/decisions/batch={batch}")
        self._teach(known, rows, self.spark.read.schema(DECISION).parquet(f"{self.path}/decisions/batch={batch}"), batch)
        scratch.drop()

    def _teach(self, known: dict[str, DataFrame], rows: DataFrame, decided: DataFrame, batch: int) -> None:
        """Changes for the next batch: hits raise fingerprints, messages are counted, votes are opened."""
        if not self.learn:
            for table in self.tables.values():
                table.set(self.spark.createDataFrame([], table.schema), batch)
            return
        hits = decided.where("fp_value IS NOT NULL").groupBy(F.col("fp_value").alias("value")).agg(F.count("*").alias("more"))
        raised = known["fingerprints"].join(hits, "value")
        self.tables["fingerprints"].set(raised.withColumn("weight", state.hit_weight(F.col("weight"), F.col("more"), self.settings)).withColumn("hits", F.coalesce("hits", F.lit(0)) + F.col("more")), batch)

        seen = state.user_activity(rows.where("user_id IS NOT NULL")).withColumnsRenamed({"messages_seen": "more", "first_seen_at": "first", "last_seen_at": "last"})
        users = seen.join(known["users"], ["chat_id", "user_id"], "left")
        self.tables["users"].set(users.select(
            "chat_id", "user_id", F.coalesce("reputation_score", F.lit(self.settings.default_reputation)).alias("reputation_score"),
            (F.coalesce("messages_seen", F.lit(0)) + F.col("more")).alias("messages_seen"), F.coalesce("first_seen_at", "first").alias("first_seen_at"),
            F.greatest("last_seen_at", "last").alias("last_seen_at"),
        ), batch)

        opened = decided.where("action = 'withdraw_vote'").select("message_id").join(rows, "message_id")
        self.tables["sessions"].set(opened.select(
            F.col("message_id").alias("id"), "chat_id", F.col("user_id").alias("suspect_user_id"), F.col("message_id").alias("original_message_id"), F.lit("open").alias("status"),
            "skeleton_hash", "content_hash", "created_at", (F.col("created_at") + self.settings.vote_timeout_seconds).alias("expires_at"),
        ), batch)

    def start(self, messages: DataFrame, checkpoint: str) -> StreamingQuery:
        """Decides all messages that the stream has, a micro-batch at a time."""
        return messages.writeStream.foreachBatch(self.decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def decisions(self, batches: int) -> DataFrame:
        """The decisions of the first batches."""
        return self.spark.read.schema(DECISION).parquet(*(f"{self.path}/decisions/batch={n}" for n in range(batches)))
