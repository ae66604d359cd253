"""The feature row of a message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.functions import links as L
from sluice.functions import text as T


#: Bytes of a table, as Spark reckons them, for one task.
PIECE = 32 << 20


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of a table dealt out by `by`: to all cores, and in more parts where it is large.

    The work on a message's text outweighs its move many times, and a row
    group, which one task reads, may be large or the only one.
    """
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores * max(1, -(-size // (cores * PIECE))), *by)


def features(messages: DataFrame) -> DataFrame:
    """Adds clean, skeleton, links, mentions, has_preview, preview_link, content_hash, skeleton_hash, punctuation_only, carrier and strong.

    One projection; no shuffle.  A caption stands in for a missing text where
    there is one.  A preview counts only if its link is not in the text or
    among its entities, and says where it leads.
    """
    text = L.message_text(F.col("text"), F.col("caption")) if "caption" in messages.columns else F.coalesce("text", F.lit(""))
    entities = None
    if "entities" in messages.columns:
        entities = F.when(F.size("entities") > 0, F.col("entities"))
        if "caption_entities" in messages.columns:
            entities = F.coalesce(entities, F.col("caption_entities"))
    # Step by step, so that what several functions begin with is made once.
    rows = messages.withColumn("text", text)
    rows = rows.withColumns({"clean": T.normalize(F.col("text")), "skeleton": P.skeleton(F.col("text")), "links": L.extract_links(F.col("text"), F.col("preview_url"), entities), "mentions": T.mention_count(F.col("text"))})
    rows = rows.withColumn("preview_link", L.preview_link(F.col("links"))).withColumn("has_preview", F.col("preview_link").isNotNull())
    return rows.withColumns({
        "content_hash": P.stable_hash(F.col("clean")), "skeleton_hash": P.stable_hash(F.col("skeleton")), "punctuation_only": T.is_punctuation_only(F.col("clean")),
        "carrier": L.has_carrier(F.col("text"), F.col("links"), F.col("mentions"), F.col("has_preview")), "strong": L.has_strong_token(F.col("clean")),
    })
