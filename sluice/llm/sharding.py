"""Sharding: longest-processing-time scheduling of groups that must stay together.

Groups are equal texts.  The few groups larger than a fixed part of a shard
are dealt out first, on the driver: largest first, each to the least loaded
shard, through a heap.  Their number is bounded by that part, not by the
corpus.  All others fall by hash into blocks of bounded size; every block
deals its groups out in the same way onto its share of the loads so far, so
blocks run in parallel and their sums stay as even as each of them is.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, table, written

SHARDS = 40
#: What a row costs besides its text.
ROW_BYTES = 16
#: A group above 1 / (SHARDS * LARGE) of all bytes or all rows is dealt out on the driver: at most twice SHARDS * LARGE groups.
LARGE = 50
#: Groups that a block deals out.
BLOCK_GROUPS = 8192


def longest_first(sizes: list[int], loads: list[float]) -> list[int]:
    """A shard for each size: largest first, to the least loaded (of equal ones the lowest). `loads` is brought up to date."""
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, k = heap[0]
        out[i] = k
        heapq.heapreplace(heap, (load + sizes[i], k))
    for load, k in heap:
        loads[k] = load
    return out


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """key, size, text_crc32, shard, slot of each row; rows with equal texts share a shard; other columns play no part.

    Size is the UTF-8 bytes of the text (null: none, and grouped with the empty
    text) plus 16.  Slots number a shard's rows without gaps.  A group larger
    than a shard's even part makes its shard larger by as much.  Null and
    repeated keys are rows like others; an empty table gives no rows.

    The groups that are large by bytes or by rows, of which there are at most
    2 * SHARDS * LARGE, are broadcast to their rows, so a text that any share of
    all rows have goes through no shuffle by text; slots are counted within the
    parts of a stored table.  Texts of any length only have their bytes
    counted and hashed; other columns may have any names.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.md5(body.cast("binary")).alias("group"), (F.octet_length(body) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = scratch.written(rows, "shard-rows")
    groups = scratch.written(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    total, all_rows, n = groups.agg(F.sum("bytes"), F.sum("rows"), F.count("*")).first()
    # Large by bytes, or by rows: of empty texts there may be very many that weigh little.
    is_large = (F.col("bytes") > (total or 0) // (shards * LARGE)) | (F.col("rows") > max(1, (all_rows or 0) // (shards * LARGE)))
    large = sorted(((r.bytes, r.group) for r in groups.where(is_large).collect()), reverse=True)
    loads = [0.0] * shards
    dealt = [(g, k) for (_, g), k in zip(large, longest_first([b for b, _ in large], loads), strict=True)]
    blocks = max(1, -(-n // block_groups))
    # Loads above the even part can't be made up for; below it, each block makes up for its share.
    share = [load / blocks for load in loads]

    def deal(part: pa.Table) -> pa.Table:
        sizes, names = part["bytes"].to_pylist(), part["group"].to_pylist()
        at = sorted(range(len(names)), key=names.__getitem__)
        own = longest_first([sizes[i] for i in at], list(share))
        return pa.table({"group": pa.array([names[i] for i in at], pa.string()), "shard": pa.array(own, pa.int32())})

    rest = groups.where(~is_large).withColumn("block", F.conv(F.substring("group", 1, 8), 16, 10).cast("bigint") % blocks)
    placed = rest.groupBy("block").applyInArrow(deal, "group string, shard int")
    known = F.broadcast(spark.createDataFrame(dealt, "group string, large int"))
    marked = rows.join(known, "group", "left")
    small = marked.where("large is null").drop("large").join(placed, "group")
    both = small.unionByName(marked.where("large is not null").withColumnRenamed("large", "shard"))
    found = scratch.written(both.withColumn("place", F.monotonically_increasing_id()), "shard-placed").withColumn("cell", F.shiftright("place", 33))
    counts = found.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("cell_begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy("shard", "cell").orderBy("place")
    slots = found.withColumn("inside", F.row_number().over(inner) - 1).join(counts, ["shard", "cell"])
    out = written(slots.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("cell_begin") + F.col("inside")).cast("bigint").alias("slot")), "shards")
    scratch.drop()
    return out


def op10_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes for all documents."""
    rows = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
