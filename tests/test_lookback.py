"""Look-back windows whose hot keys lie in many tasks, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.operators import folding, lookup
from sluice.settings import Settings


@pytest.fixture(params=[2, 14])
def bits(request, monkeypatch):
    monkeypatch.setattr(folding, "BITS", request.param)
    return request.param


def test_running_sums_equal_a_loop(spark, bits):
    g = random.Random(bits)
    rows = [("hot" if g.random() < 0.9 else f"k{g.randrange(5)}", i % 97, i, g.choice([-1, 0, 1, 5])) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t long, i long, step int").repartition(6)
    got = {r.i: r.total for r in folding.running(df, ["k"], ["t", "i"], "step", "total").collect()}
    sums, plain = {}, {}
    for k, _, i, step in sorted(rows, key=lambda r: r[1:3]):
        plain[i] = sums[k] = sums.get(k, 0) + step
    assert got == plain
    assert folding.running(df.limit(0), ["k"], ["t", "i"], "step", "total").count() == 0


def test_windows_of_running_sums_hold_one_piece(spark, monkeypatch):
    """With one key for all rows, rows still lie in several tasks."""
    monkeypatch.setattr(folding, "BITS", 4)
    df = spark.range(2000).select(F.lit(1).alias("k"), "id", F.lit(1).alias("step"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = folding.running(df, ["k"], ["id"], "step", "n")
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 2000 and max(sizes) < 1200
    assert out.where("n != id + 1").isEmpty()


MESSAGES = "message_id long, chat_id long, user_id long, created_at long, content_hash string, skeleton_hash string, skeleton string"
SESSIONS = "id long, chat_id long, suspect_user_id long, created_at long, status string, content_hash string, skeleton_hash string"
SHAPE = "buy <W> now at <URL> for <N> coins today"


def plain_repeats(messages, sessions, most):
    out = {}
    for m, c, u, t, content, shape, _ in messages:
        own = [s for s in sessions if None not in (c, u, t, s[3]) and s[4] == "open" and (s[1], s[2]) == (c, u) and s[3] < t]
        newest = sorted(own, key=lambda s: (s[3], s[0]), reverse=True)[:most]
        same = [s[0] for s in newest if (content is not None and content == s[5] != P.EMPTY_HASH) or (shape is not None and shape == s[6] != P.EMPTY_HASH)]
        if same:
            out[m] = same[:10]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_open_repeats_equal_a_loop(spark, bits, seed):
    """Nine of ten rows are one sender's; half of these have one text."""
    g = random.Random(seed * 100 + bits)
    who = lambda: (1, 7) if g.random() < 0.9 else (g.choice([None, 1, 2]), g.choice([None, 7, 8]))
    text = lambda: g.choice(["a", "a", "a", "b", "c", None, P.EMPTY_HASH])
    messages = [(k, *who(), g.choice([None, *range(60)]), text(), text(), SHAPE) for k in range(400)]
    sessions = [(k, *who(), g.choice([None, *range(60)]), g.choice(["open", "open", "open", "closed"]), text(), text()) for k in range(120)]
    most = 5 if seed else 50
    got = lookup.open_repeats(spark.createDataFrame(messages, MESSAGES).repartition(5), spark.createDataFrame(sessions, SESSIONS), Settings(max_sessions=most))
    plain = plain_repeats(messages, sessions, most)
    assert len(plain) > 50
    assert {r.message_id: list(r.session_ids) for r in got.collect()} == plain


def test_open_repeats_without_rows(spark):
    none, some = spark.createDataFrame([], MESSAGES), spark.createDataFrame([(1, 1, 7, 5, "a", "b", SHAPE)], MESSAGES)
    sessions = spark.createDataFrame([(1, 1, 7, 4, "open", "a", None)], SESSIONS)
    assert lookup.open_repeats(none, sessions).count() == 0
    assert lookup.open_repeats(some, sessions.limit(0)).count() == 0
    assert [tuple(r) for r in lookup.open_repeats(some, sessions).collect()] == [(1, [1])]


@pytest.mark.parametrize("seed", range(2))
def test_prior_senders_of_one_hot_shape(spark, bits, seed):
    g = random.Random(seed)
    rows = [("hot" if g.random() < 0.9 else g.choice([None, "s"]), i, g.choice([None, *range(30)]), g.choice([None, *range(900)])) for i in range(400)]
    df = spark.createDataFrame(rows, "skeleton_hash string, message_id long, user_id long, created_at long").repartition(5)
    known = [r for r in rows if r[0] is not None and r[3] is not None]
    plain = {m: len({u2 for s2, m2, u2, t2 in known if s2 == s and (t2, m2) < (t, m) and t2 >= t - 100 and u2 is not None and u2 != u}) if s is not None and t is not None else 0 for s, m, u, t in rows}
    assert {r.message_id: r.prior_senders for r in lookup.prior_senders(df, 100).collect()} == plain


def test_only_messages_about_an_earlier_session_are_numbered(spark):
    """Each message has a session of its own, opened as it came; only sessions of a sender who repeats one are looked at."""
    messages = [(k, 1, 7 + k % 2, k, f"c{k}" if k != 40 else "c20", f"s{k}", SHAPE) for k in range(50)]
    sessions = [(k, 1, u, t, "open", content, shape) for k, _, u, t, content, shape, _ in messages]
    scratch = lookup.Scratch(spark)
    got = lookup.open_repeats(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(sessions, SESSIONS), scratch=scratch)
    assert {r.message_id: list(r.session_ids) for r in got.collect()} == plain_repeats(messages, sessions, 50) == {40: [20]}
    assert spark.read.parquet(f"{scratch.path}/running-rows-*").count() == 25 + 1
    scratch.drop()
