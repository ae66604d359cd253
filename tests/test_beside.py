"""Texts are moved once, and no task holds all messages without a link."""

from pyspark.sql import functions as F

from sluice.functions import phrases as R
from sluice.functions import text as T
from sluice.operators import lookup, scoring
from sluice.operators.features import spread
from sluice.plans import decision_queries as Q
from sluice.plans.state_queries import _asking


def test_messages_without_a_link_are_dealt_out(spark):
    rows = spark.range(4000).select(F.col("id").alias("message_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("u"), F.col("id"))).alias("preview_link"))
    previews = spark.range(4000).select(F.concat(F.lit("u"), F.col("id")).alias("url"), F.col("id").cast("string").alias("og_title"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = lookup.with_preview(rows, previews)
        sizes = [r["count"] for r in found.where("og_url is null").groupBy(F.spark_partition_id()).count().collect()]
        assert found.count() == 4000 and found.where("og_url is not null and og_title = cast(message_id as string)").count() == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 3960 and max(sizes) < 2000


def test_rows_beside_their_keys(spark):
    rows = spark.createDataFrame([(1, 7, "a"), (1, 7, "b"), (None, 7, "c"), (2, None, "d")], "message_id long, user_id long, text string")
    known = spark.createDataFrame([(7, "seven")], "user_id long, name string")
    found = lookup.beside(rows, ["message_id", "user_id"], lambda keys: keys.join(known, "user_id", "left"))
    assert found.columns == ["message_id", "user_id", "text", "name"]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[2]) == [(1, 7, "a", "seven"), (1, 7, "b", "seven"), (None, 7, "c", "seven"), (2, None, "d", None)]


def test_keys_are_those_of_single_steps(spark):
    texts = ["轻松日入过万 click here now", "", "a_b", "可以", "video " * 400, "加群日结兼职 一天几百 t.me/abc", "Words of Phrase 12", "ab cd 中x文x字"]
    rows = spark.createDataFrame([(i, t, f"Ｔitle {t}") for i, t in enumerate(texts)], "id int, text string, title string")
    rows = rows.withColumns({"clean": T.normalize("text"), "shape": F.when(F.col("id") % 2 == 0, F.lit("s")), "whole": F.lit("w")})
    plain = R.lookup_hashes(R.candidates(F.col("clean"), T.normalize(F.col("title"))))
    for r in rows.select("shape", plain.alias("p"), R.lookup_keys(F.col("shape"), F.col("whole"), F.col("clean"), F.col("title")).alias("k")).collect():
        assert [tuple(k) for k in r.k] == [("skeleton", "s")] * (r.shape is not None) + [("content", "w")] + [("phrase", v) for v in r.p]


def test_a_filter_in_tasks_and_in_expressions_is_one(spark):
    values = [f"{i:032x}" for i in range(3000)]
    known = lookup.known_values(spark.createDataFrame([(v,) for v in values[:300]], "value string"))
    asked = spark.createDataFrame([(v,) for v in values], "value string").select("value", known(F.col("value")).alias("may")).collect()
    assert [r.may for r in asked] == [r.value in known for r in asked] and all(r.may for r in asked[:300]) and sum(r.may for r in asked) < 450


def test_large_tables_are_dealt_into_more_parts_than_cores(spark, monkeypatch):
    rows = spark.range(1000).withColumn("t", F.repeat(F.lit("x"), 10)).coalesce(1)
    assert spread(rows, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr("sluice.operators.features.PIECE", 1000)
    assert spread(rows, "id").rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


def test_evidence_of_messages_that_something_is_told_of(spark):
    sf = "/root/testdata/sf0.001"
    few = Q.taught_rows(spark, sf)
    every = Q.messages(spark, sf)
    assert 0 < few.count() < every.count()
    assert sorted(map(tuple, Q.evidence(few, spark, sf).collect())) == sorted(map(tuple, Q.evidence(every, spark, sf).collect()))


def test_decisions_are_made_once(spark):
    found = Q.decisions(spark, "/root/testdata/sf0.001", "text")
    assert found.columns[-1] == "text" and found.agg(F.max(F.length("text"))).first()[0] <= Q.SHOWN
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ArrowEvalPython" not in plan


def test_requests_have_what_they_need_of_long_texts(spark):
    long = "x y" * 3000
    rows = spark.createDataFrame([(1, long, long, long)], "message_id long, text string, clean string, skeleton string")
    assert scoring.cut(rows).select(*(F.length(c) for c in scoring.LONGEST)).first() == (4000, 4000, 1000)
    asking = _asking(spark, "/root/testdata/sf0.001")
    assert asking.agg(F.max(F.length("text"))).first()[0] <= 4000 and {"carrier", "strong"}.isdisjoint(asking.columns)


def test_evidence_moves_hashes_and_no_texts(spark):
    """Where labels and verdicts are too many to be broadcast, all rows cross the joins with them."""
    found = Q.evidence(Q.taught_rows(spark, "/root/testdata/sf0.001"), spark, "/root/testdata/sf0.001")

    def joined(plan):
        below = plan.children()
        inputs = [below.apply(i) for i in range(below.size())]
        return ([x.output().toString() for x in inputs] if plan.nodeName() == "Join" else []) + [o for x in inputs for o in joined(x)]

    sides = joined(found._jdf.queryExecution().optimizedPlan())
    assert len(sides) >= 4 and not any("clean#" in s or "skeleton#" in s for s in sides)
    assert "skeleton" not in Q._ROW
