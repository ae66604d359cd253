"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions alone.

Each source streams its documents in a fixed shuffled order, once and then
again, until it has given its target of words; so its words are known exactly
and no document is taken more than twice.  A source's share of the mix may
change over training: its weight goes linearly from (1 + tilt) to (1 - tilt)
times its mean while training time goes from 0 to 1.  Integrated, that is the
source's cumulative demand; inverting it at the middle of each document's words
gives the time at which the document is trained on, and a range sort by that
time is the order of the mix.

The running sum over a source is taken in two steps: sums of hashed blocks
within a source, then rows within a block.  There are as many blocks as make a
block of a few thousand rows even if all are of one source, so a source holding
any share of all rows spreads over as many tasks as its rows call for.  Words
are counted once, into a table of keys and sizes that all sums read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, table, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: How far the weights of the sources, in turn, lean towards the beginning (or, below 0, the end) of training.
TILTS = (-0.5, 0.0, 0.5)
#: Rows of a block of the running sum, and the most blocks of a source (then larger ones).
BLOCK_ROWS, MOST_BLOCKS = 4096, 1 << 24
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Runs of characters other than U+0020 and U+0009-U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sums: DataFrame) -> DataFrame:
    """name, source, source_size, place, weight, target from rows (name, source, block_size).

    Targets are min(2 size, level * weight); the level follows in closed form
    from the sources in ascending order of cap / weight: it is the first that
    the sources not yet full can share without another becoming full.
    Works on one row for each source, which all meet in one task: some tens of
    bytes each, so this is for sources that are sites or files and not for one
    of each document.
    """
    rows = sums.groupBy("name").agg(F.first("source").alias("source"), F.sum("block_size").alias("source_size"))
    # UTF-8 strings compare by byte, which is the order of their code points.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = rows.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    rows = rows.withColumn("cap", MOST * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "place")
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("need", F.sum("source_size").over(whole) * F.lit(SHARE))
        .withColumn("left", F.col("need") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("weights_left"))
    )
    fits = F.col("level") <= F.col("full_at")
    rows = rows.withColumn("water", F.min(F.when(fits, F.struct("full_at", "place", "level"))).over(whole)["level"])
    target = F.when(F.col("full_at") <= F.col("water"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("water"))
    return rows.select("name", "source_size", "place", F.coalesce(target, F.lit(0.0)).alias("target"))


def _tilt(place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TILTS)), (place % len(TILTS) + 1).cast("int"))


def position(share: Column, tilt: Column) -> Column:
    """Time at which a source has given `share` of its words.

    Demand up to time t is (1 + a) t - a t^2; its inverse is taken in the form
    that stays exact for small a.
    """
    b = 1 + tilt
    return 2 * share / (b + F.sqrt(F.greatest(b * b - 4 * tilt * share, F.lit(0.0))))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of `docs`: key, the columns in `carry` (as a struct `row`), size, source_size, target,
    taken_first and taken_again (words it gives the first and the second time), taken, position_first and
    position_again (when it is trained on, from 0 to 1; null if nothing is taken).

    A null text has size 0, and so does one without words; null is a source of
    its own, the last.  The shuffled order is that of the MD5 of key and text,
    so that rows with null or equal keys spread too; rows that are equal in
    both follow one another.  An empty table gives no rows.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    content = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    turn = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), content).cast("binary"))

    def sized(*more: Column) -> DataFrame:
        return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), name.alias("name"), word_count(text).alias("size"), turn.alias("turn"), *more)

    light = written(sized(), "mix-sizes")
    blocks = min(MOST_BLOCKS, max(1, -(-light.count() // block_rows)))
    block = F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("bigint") * blocks / 2**32).cast("int")
    sums = light.groupBy("name", block.alias("block")).agg(F.first("source").alias("source"), F.sum("size").alias("block_size"))
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("block_begin", F.coalesce(F.sum("block_size").over(before), F.lit(0)))
    begins = begins.select("name", "block", "block_begin").join(source_targets(sums), "name")
    rows = sized(F.struct(*map(quoted, carry)).alias("row")) if carry else light
    inner = Window.partitionBy("name", "block").orderBy("turn", F.col("key").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("block", block).withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).drop("source", "turn")
    rows = rows.join(begins, ["name", "block"]).withColumn("begin", F.col("block_begin") + F.col("inside"))
    goal, zero = F.round("target").cast("bigint"), F.lit(0).cast("bigint")
    rows = rows.withColumn("taken_first", F.greatest(zero, F.least(F.col("size"), goal - F.col("begin"))))
    rows = rows.withColumn("taken_again", F.greatest(zero, F.least(F.col("size"), goal - F.col("begin") - F.col("source_size"))))

    def when(start: Column, taken: str) -> Column:
        share = F.least((start + F.col(taken) / 2) / F.col("target"), F.lit(1.0))
        return F.when(F.col(taken) > 0, position(share, _tilt(F.col("place"))))

    return rows.select(
        F.col("key").alias(key), *(["row"] if carry else []), "size", "source_size", "target", "taken_first", "taken_again",
        (F.col("taken_first") + F.col("taken_again")).alias("taken"),
        when(F.col("begin"), "taken_first").alias("position_first"), when(F.col("begin") + F.col("source_size"), "taken_again").alias("position_again"),
    )


def mixed(docs: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """The documents as often as the mix takes them, range-sorted by position; columns as in `docs`.

    Where a source's target ends within a document, that copy ends there too:
    it keeps the words taken, joined by one space.  Documents that the mix
    does not take are not in it.
    """
    rows = plan(docs, text=text, carry=tuple(docs.columns), **names)
    turns = F.array(*[F.struct(F.col(f"taken_{k}").alias("taken"), F.col(f"position_{k}").alias("position")) for k in ("first", "again")])
    rows = rows.select("row", "size", F.explode(turns).alias("turn")).where("turn.taken > 0")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row")[text], F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("turn.taken").cast("int")), " ")
    whole = F.when(F.col("turn.taken") < F.col("size"), cut).otherwise(F.col("row")[text])
    rows = rows.orderBy("turn.position")
    kept = [whole.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*kept)


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and when."""
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position_first", "position_again")


def _sql() -> str:
    pick = lambda values: f"([{', '.join(map(str, values))}])[1 + CAST(place % {len(values)} AS INTEGER)]"
    at = lambda start, taken: (
        f"CASE WHEN {taken} > 0 THEN 2 * least(({start} + {taken} / 2.0::DOUBLE) / target, 1.0::DOUBLE) / (1 + tilt + sqrt(greatest("
        f"(1 + tilt) * (1 + tilt) - 4 * tilt * least(({start} + {taken} / 2.0::DOUBLE) / target, 1.0::DOUBLE), 0.0::DOUBLE))) END"
    )
    return f"""
WITH sizes AS (
  SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS turn,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM by_source),
weighed AS (SELECT *, {pick(WEIGHTS)} AS weight, CAST({pick(TILTS)} AS DOUBLE) AS tilt FROM placed),
capped AS (SELECT *, {MOST} * source_size AS cap, CAST({MOST} * source_size AS DOUBLE) / weight AS full_at FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER w, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM capped WINDOW w AS (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, (full_at, place)) AS water FROM levels WHERE level <= full_at),
targets AS (
  SELECT source, source_size, place, tilt,
         coalesce(CASE WHEN full_at <= water THEN CAST(cap AS DOUBLE) ELSE weight * water END, 0) AS target FROM levels, water),
begins AS (
  SELECT doc_id, size, source_size, target, tilt, CAST(round(target) AS BIGINT) AS goal,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, greatest(0, least(size, goal - begins)) AS first, greatest(0, least(size, goal - begins - source_size)) AS again FROM begins)
SELECT doc_id, size, source_size, target, CAST(first + again AS BIGINT) AS taken,
       {at("begins", "first")} AS position_first, {at("(begins + source_size)", "again")} AS position_again
FROM taken
"""


SQL = {"op8_curriculum_mix": _sql()}
