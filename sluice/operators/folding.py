"""Folds of a key's ordered events, and what they amount to before each row.

An event is a step, a struct `f` that composes: two steps in a row are one
step.  So a key's events are folded in a tree whose lists are bounded however
many events the key has, and a row in the midst of them sees the state that the
steps before it lead to without any task holding the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from sluice.sources.shared import Scratch, written

#: Entries of a list that is folded at once, as a power of two.
BITS = 14

Compose = Callable[[Column, Column], Column]


def _chained(steps: Column, kind: DataType, compose: Compose) -> Column:
    """One step for the steps of an ordered array of (at, f)."""
    none = F.lit(None).cast(kind)
    return F.aggregate(steps, none, lambda a, e: F.when(a.isNull(), e["f"]).when(e["f"].isNull(), a).otherwise(compose(a, e["f"])))


def _level(rows: DataFrame, keys: list[str], part: Column | None, compose: Compose) -> DataFrame:
    """keys, at and f, where rows of a key with the same `part` have become one."""
    kind = rows.schema["f"].dataType
    groups = [*keys] if part is None else [*keys, part.alias("part")]
    found = rows.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("steps"))
    at = [] if part is None else [F.col("part").alias("at")]
    return found.select(*keys, *at, _chained(F.col("steps"), kind, compose).alias("f"))


def folded(events: DataFrame, keys: list[str], compose: Compose, order: str = "seq") -> DataFrame:
    """keys and f, the composition of each key's steps in ascending `order`, whole numbers that differ within a key.

    Level by level, steps whose numbers differ only in the lowest bits become
    one, so no list has more than 2**BITS entries, whether a key's numbers are
    dense or far apart.  How many levels there are depends on the range of all
    numbers, and each but the last only joins what the hot keys have.
    """
    rows = events.select(*keys, F.col(order).alias("at"), "f")
    least, most = rows.agg(F.min("at"), F.max("at")).first()
    shift = 0
    while least is not None and (most >> shift) - (least >> shift) >= 1 << BITS:
        rows = _level(rows, keys, F.shiftright("at", BITS), compose)
        shift += BITS
    return _level(rows, keys, None, compose)


#: Takes the state and a step, gives the state after it; the state is a tuple or None.
Through = Callable[[tuple | None, dict[str, Any]], tuple | None]


def _states(through: Through, start: tuple | None, keys: list[str], state: pa.StructType, first: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds `before` to rows sorted by their keys and then in order; a column `first` has the state before a run of rows, if that is not the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, now = None, start
        names = [state.field(i).name for i in range(state.num_fields)]
        for batch in batches:
            before = []
            own = zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True)
            steps = batch.column(batch.schema.get_field_index("f")).to_pylist()
            begins = batch.column(batch.schema.get_field_index(first)).to_pylist() if first else [None] * len(steps)
            for key, f, begin in zip(own, steps, begins, strict=True):
                if key != current:
                    current, now = key, start if begin is None else tuple(begin.values())
                before.append(None if now is None else dict(zip(names, now, strict=True)))
                if f is not None:
                    now = through(now, f)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, state)], names=[*batch.schema.names, "before"])

    return run


def scanned(rows: DataFrame, keys: list[str], order: list[str], compose: Compose, through: Through, start: tuple | None, state: str) -> DataFrame:
    """`rows` with `before`, the state that the steps `f` of a key's earlier rows lead to; a row without a step has a null one.

    Rows are dealt by ranges of key and `order`, so a hot key lies in many
    tasks.  Pieces of at most 2**BITS rows of one key each become one step, in
    parallel; the states before pieces follow from these steps alone, and the
    states before rows from the piece's.  `order` must be total within a key,
    and no column's name may begin with an underscore.
    `state` is the state's type as a DDL struct, and tuples have its fields.
    """
    spark = rows.sparkSession
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    arrow = _arrow_struct(spark, state)
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_place", F.monotonically_increasing_id())
    # Stored, as places must be the same in all that follows.
    placed = written(dealt.withColumn("_piece", F.shiftright("_place", BITS)), "scan-rows")
    named = {k: f"{k}_" for k in keys}
    # A piece without steps has a null one: a row in it sees what the pieces before it lead to.
    whole = _level(placed.select(*keys, "_piece", F.col("_place").alias("at"), "f"), [*keys, "_piece"], None, compose)
    kind = whole.schema["f"].dataType.simpleString()
    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", _piece bigint, f {kind}"
    ran = whole.repartition(*keys).sortWithinPartitions(*keys, "_piece").mapInArrow(_states(through, start, keys, arrow, None), f"{ddl}, before {state}")
    begins = ran.select(*(F.col(k).alias(n) for k, n in named.items()), F.col("_piece").alias("_own"), F.col("before").alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()] + [F.col("_piece") == F.col("_own")]
    joined = placed.join(begins.hint("merge"), same, "left").drop(*named.values(), "_own")
    columns = ", ".join(f"`{c}` {t}" for c, t in types.items()) + f", _place bigint, _piece bigint, _first {state}"
    ordered = joined.sortWithinPartitions(*keys, "_piece", "_place")
    return ordered.mapInArrow(_states(through, start, [*keys, "_piece"], arrow, "_first"), f"{columns}, before {state}").drop("_place", "_piece", "_first")


def running(rows: DataFrame, keys: list[str], order: list[str], step: str, name: str, scratch: Scratch | None = None) -> DataFrame:
    """`rows` with `name`, the sum of `step` over a key's rows up to and with each of them in `order`, by built-in functions alone.

    Where no key has more than 2**BITS rows, this is a window over keys.
    Otherwise rows are dealt as in `scanned`: a window holds at most 2**BITS
    rows of a key, and what pieces before it sum to comes from one row a piece.
    Keys must not be null, `order` must be total within a key but for rows
    whose places may be swapped, and no column's name may begin with an
    underscore.  What is stored goes with `scratch`, and with the application
    where none is given.
    """
    store = scratch.written if scratch else written
    to_here = (Window.unboundedPreceding, 0)
    rows = store(rows, "running-rows")
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= 1 << BITS:
        return rows.withColumn(name, F.sum(step).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*to_here)))
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_place", F.monotonically_increasing_id())
    # Stored, as places must be the same in all that follows.
    placed = store(dealt.withColumn("_piece", F.shiftright("_place", BITS)), "running-places")
    sums = placed.groupBy(*keys, "_piece").agg(F.sum(step).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_piece", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_piece").orderBy("_place").rowsBetween(*to_here)
    joined = placed.join(before.hint("merge"), [*keys, "_piece"])
    return joined.select(*rows.columns, (F.col("_before") + F.sum(step).over(within)).alias(name))


def _arrow_struct(spark: Any, ddl: str) -> pa.StructType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark.createDataFrame([], f"s {ddl}").schema["s"].dataType)
