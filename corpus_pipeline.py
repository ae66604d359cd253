"""From raw documents to packed training sequences.

Toxic documents go, one document of each near-duplicate group stays, sources
are mixed to their target weights, and the result is packed.  Each stage takes
and, but for the last, returns rows with the columns of documents, whatever
further columns those have; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm import dedup, mixing, packing, toxicity
from sluice.llm.common import free_name, quoted, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; learns from the labels of `docs`.

    Null and empty texts have a low score and stay; repeated rows go or stay
    together.  Labels of documents that are not in `docs` are not used; where
    none is left, every document stays.
    """
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    return toxicity.with_scores(docs, net, into=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8: that with the least doc_id.

    Rows without a doc_id are known by their text and come after all others,
    so equal texts without one are one document.  Rows with one doc_id are one
    group, of which that with the least text hash stays.  Documents without
    words are no one's copies and stay.
    """
    key, turn, place = (free_name(docs, name) for name in ("key", "turn", "place"))
    named = F.coalesce(F.col("doc_id").cast("bigint"), F.pmod(F.xxhash64("text"), F.lit(2**62)) + F.lit(2**62))
    rows = docs.withColumn(key, named)
    kept = dedup.near_duplicates(rows, key, width=5, percent=80).where("kept").select(key).distinct()
    # The rank goes before the shuffle as well, so a key that many rows share sends on one row of each task.
    first = F.row_number().over(Window.partitionBy(key).orderBy(turn))
    single = rows.withColumn(turn, F.xxhash64("text")).withColumn(place, first).where(F.col(place) == 1)
    return single.join(kept.hint("merge"), key, "left_semi").select(*map(quoted, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the curriculum takes them, in its order.

    Null sources are a source of their own; documents without words are taken
    by no source and go.  Repeated rows are documents of their own.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places; repeated rows are documents of their own."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: SQL can't express a trained network; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each writes its rows to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
