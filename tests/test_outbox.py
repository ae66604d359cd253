"""Numbers without gaps, effects under keys of their own, and links that are fetched once."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators.effects import ban_events, numbered
from sluice.operators.outbox import Outbox, effect_key
from sluice.operators.previews import PreviewCache, Response, answered_by, fetched


def test_numbers_of_one_busy_time(spark):
    """90 % of the rows have one time: they lie in several ranges, and numbers are consecutive all the same."""
    rows = spark.range(50_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(7)).alias("at")).repartition(9)
    got = numbered(rows, "number", "at", "id", first=5)
    ordered = sorted((r.at, r.id, r.number) for r in got.collect())
    assert [n for *_, n in ordered] == list(range(5, 50_005))
    assert numbered(rows.limit(0), "number", "at", "id").collect() == []


def box_rows(spark, numbers):
    return spark.createDataFrame([("ban", k % 3, k, f"t{k}", 1000 - k % 7) for k in numbers], "kind string, chat_id long, message_id long, body string, at long")


def test_appends_go_on_where_the_last_one_ended(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"), ("kind", "chat_id", "message_id"))
    parts = [range(40), [], range(30, 70), range(100, 110)]  # the third has ten of the first's again
    for k, numbers in enumerate(parts):
        box.append(box_rows(spark, numbers).repartition(3), k, "at", "message_id")
    before = sorted(map(tuple, box.rows(4).select("id", "effect_key", "message_id", "body").collect()))
    assert [r[0] for r in before] == list(range(1, 81)) and len({r[1] for r in before}) == 80 == len({r[2] for r in before})
    for k in (1, 2, 3):  # run again, as after a failure; in another order of rows
        box.append(box_rows(spark, list(parts[k])[::-1]).repartition(2), k, "at", "message_id")
    assert sorted(map(tuple, box.rows(4).select("id", "effect_key", "message_id", "body").collect())) == before


def test_effects_are_pending_until_noted(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"), ("kind", "chat_id", "message_id"))
    twice = box_rows(spark, range(10)).unionByName(box_rows(spark, range(10)))
    box.append(twice, 0, "at", "message_id")
    assert box.pending(1).count() == 10
    some = box.pending(1).where("message_id < 4").select("effect_key")
    box.deliver(some.unionByName(some), 0)
    assert sorted(r.message_id for r in box.pending(1, 1).collect()) == list(range(4, 10))
    box.append(box_rows(spark, [3, 20]), 1, "at", "message_id")
    assert sorted(r.message_id for r in box.pending(2, 1).collect()) == [*range(4, 10), 20]


def test_keys_of_effects(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", ""), (1, "a", None), (11, "a", None)], "k long, x string, y string")
    keys = [r[0] for r in rows.select(effect_key("k", "x", "y")).collect()]
    assert keys[0] == keys[2] and len(set(keys)) == 3


def plain_cache(runs, pages, retry):
    known, asked = {}, []
    for links, now in runs:
        due = {u for u in links if u and not (u in known and (known[u][0] == "ok" or known[u][1] + retry > now))}
        asked.append(due)
        for u in due:
            known[u] = ("ok" if u in pages else "failed", now)
    return known, asked


@pytest.mark.parametrize("seed", [1, 2])
def test_cache_fetches_what_is_due_and_nothing_else(spark, tmp_path, seed):
    g = random.Random(seed)
    links = [f"http://h{k % 3}.example/{k}" for k in range(30)]
    pages = {u: f"<title>{u}</title>" for u in links if g.random() < 0.6}
    runs = [([g.choice([*links, None]) for _ in range(20)], 1000 * k) for k in range(6)]
    known, asked = plain_cache(runs, pages, 2500)
    table = spark.createDataFrame(list(pages.items()), "url string, html string")
    cache = PreviewCache(spark, str(tmp_path / "cache"), 2500, every=2)
    cache.create()
    for k, (some, now) in enumerate(runs):
        candidates = spark.createDataFrame([(u,) for u in some], "url string")
        for _ in range(2):  # a repeated run changes nothing
            assert {r.url for r in cache.due(candidates, k, now).collect()} == asked[k]
            cache.refresh(candidates, lambda due: answered_by(due, table), k, now)
    rows = cache.before(len(runs)).collect()
    assert {r.url: (r.status, r.fetched_at) for r in rows} == known
    assert all((r.preview.title == r.url) if r.status == "ok" else r.preview is None for r in rows)


def test_cache_over_the_network_asks_no_host_from_many_tasks(spark, tmp_path):
    """All links are one host's: they lie in several tasks, but no more than a host may have; the second run asks nothing."""
    from sluice.operators.previews import HOST_PARTS

    links = spark.createDataFrame([(f"http://big.example/{k}",) for k in range(400)], "url string")
    cache = PreviewCache(spark, str(tmp_path / "cache"))
    cache.create()
    tasks = []

    def answers(due):
        tasks.append(due.groupBy(F.spark_partition_id()).count().count())
        return fetched(due, lambda url, address: Response(200, f"<title>{url[-3:]}</title>".encode()), lambda host, port: ["93.184.216.34"], url="url", dealt=True)

    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        cache.refresh(links, answers, 0, 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 4 < tasks[0] <= HOST_PARTS
    assert cache.before(1).where("status = 'ok' AND preview.title IS NOT NULL").count() == 400
    assert cache.due(links, 1, 10**9).isEmpty()


def test_events_of_bans(spark):
    bans = spark.createDataFrame([(5, 1, 7, True, -35.0), (6, 1, 7, False, None), (7, 2, None, False, None)], "id long, chat_id long, suspect_user_id long, banned boolean, reputation_delta double")
    assert [tuple(r) for r in ban_events(bans).collect()] == [(5, 1, 7, -35.0)]
