"""The filter that goes before the explode of a message's keys."""

from pyspark.sql import functions as F

from sluice.operators import lookup


def test_filter_passes_all_known_values_and_few_others(spark):
    known = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("value"))
    may_be = lookup.known_values(known)
    assert known.where(~may_be(F.col("value"))).isEmpty()
    others = spark.range(10**6, 10**6 + 50_000).select(F.md5(F.col("id").cast("string")).alias("value"))
    assert others.where(may_be(F.col("value"))).count() < 1500
    # Within an array, as it is used.
    rows = known.limit(10).unionByName(others.limit(90)).groupBy().agg(F.collect_list("value").alias("values"))
    assert 10 <= len(rows.select(F.filter("values", may_be).alias("v")).first().v) < 30


def test_filter_of_none_and_of_too_many(spark):
    none = lookup.known_values(spark.createDataFrame([], "value string"))
    assert spark.range(100).select(F.md5(F.col("id").cast("string")).alias("value")).where(none(F.col("value"))).isEmpty()
    assert lookup.known_values(spark.range(11).select(F.col("id").cast("string").alias("value")), most=10) is None


def test_strongest_is_the_same_with_and_without_a_filter(spark, monkeypatch):
    from sluice.plans import QUERIES
    from sluice.plans.decision_queries import known_of, messages
    from sluice.sources.shared import written

    sf = "/root/testdata/sf0.001"
    found = sorted(map(tuple, QUERIES["strongest_fingerprint"](spark, sf).collect()))
    rows = known_of(written(messages(spark, sf), "feature-rows"), spark, sf)
    every = lookup.keys_of(rows, "message_id", lookup.phrase_fields())
    few = lookup.keys_of(rows, "message_id", lookup.phrase_fields(), may_be=lookup.known_values(spark.createDataFrame([(r[3],) for r in found], "value string").distinct()))
    assert few.count() < every.count() / 10
    monkeypatch.setattr(lookup, "MOST_VALUES", 0)
    monkeypatch.setattr(lookup.known_values, "__defaults__", (0,))
    assert sorted(map(tuple, QUERIES["strongest_fingerprint"](spark, sf).collect())) == found


def test_keys_are_made_once(spark):
    """An explode of a named array asks for its size first, which made all keys twice."""
    rows = spark.createDataFrame([(1, "click here", "video", False, "h", "c")], "message_id long, clean string, bio string, low_shape boolean, skeleton_hash string, content_hash string")
    keys = lookup.keys_of(rows, "message_id", (F.col("bio"),), may_be=lookup.known_values(spark.createDataFrame([("h",), ("c",)], "value string")))
    assert keys._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, keys.collect())) == [(1, 0, "skeleton", "h"), (1, 1, "content", "c")]
