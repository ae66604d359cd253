"""State on streams: equal to the folds of whole tables however the stream is cut, and gone when it is over."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import state
from sluice.operators.lookup import heaviest
from sluice.settings import Settings
from sluice.sources.shared import _folder
from sluice.streaming import folds
from sluice.streaming.sources import timed

from .test_asof import EVIDENCE, LOOKUPS, context_rows, fingerprint_rows, plain_context, plain_fingerprints

pytest.importorskip("google.protobuf")


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def cut(rows, time, seed, parts=4):
    """The rows in the order of their times, in parts that no time is split over."""
    g = random.Random(seed)
    times = sorted({r[time] for r in rows})
    edges = sorted(g.sample(times[1:], parts - 1))
    return [[r for r in rows if sum(r[time] >= e for e in edges) == k] for k in range(parts)]


def source(spark, parts, path, schema):
    """A stream of the parts, one micro-batch each."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def run(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return df.sparkSession.table(name).collect(), q


@pytest.mark.parametrize("seed", [1, 2])
def test_fingerprints_on_a_stream_equal_the_scan(spark, tmp_path, seed):
    """Messages fan out to their keys and are gathered again; one stream of both kinds of rows, so that cuts go through both."""
    lookups, evidence = fingerprint_rows(seed, 120)
    both = [(t, m, p, "look", kind, v, None, None) for m, t, p, kind, v in lookups] + [(t, s, 0, kind, ft, v, w, src) for s, v, kind, ft, w, src, t in evidence]
    schema = "ts long, number long, place int, kind string, fingerprint_type string, value string, weight double, source string"
    stream = source(spark, cut(both, 0, seed), str(tmp_path / "in"), schema)
    asked = stream.where("kind = 'look'").withColumnRenamed("number", "message_id")
    found = folds.fingerprints_found(asked, stream.where("kind <> 'look'").withColumnRenamed("number", "seq"))
    got, _ = run(found, f"found{seed}", str(tmp_path / "a"))
    assert {(r.message_id, r.place): (r.fingerprint_type, r.weight, r.false_positives, r.source) for r in got} == plain_fingerprints(lookups, evidence)
    gathered, _ = run(folds.strongest_found(found), f"strongest{seed}", str(tmp_path / "b"))
    table = state.fingerprints_as_of(spark.createDataFrame(lookups, LOOKUPS), spark.createDataFrame(evidence, EVIDENCE))
    best = heaviest(table, fp_type="fingerprint_type", fp_value="value", fp_weight="weight")
    columns = ["message_id", "fp_type", "fp_value", "fp_weight"]
    assert sorted(tuple(r[c] for c in columns) for r in gathered) == sorted(map(tuple, best.select(*columns).collect()))


def test_fingerprints_begin_with_a_table_and_hits_raise_them(spark, tmp_path):
    known = spark.createDataFrame([("a", "content", 60.0, "vote", 0), ("b", "phrase", 90.0, "vote", 2), ("c", "content", 78.0, "x", 0)], "value string, fingerprint_type string, weight double, source string, false_positives long")
    schema = "ts long, number long, place int, kind string, fingerprint_type string, value string, weight double, source string"
    look = lambda t, v, kind="content": (t, t, 0, "look", kind, v, None, None)
    hit = lambda t, v: (t, t, 0, "hit", None, v, None, None)
    parts = [[look(1, "a"), hit(2, "a"), look(3, "a"), look(4, "a", "phrase"), hit(5, "c"), look(6, "c")], [hit(7, "b"), look(8, "b", "phrase"), (9, 9, 0, "down", None, "b", None, None), look(10, "b", "phrase"), hit(11, "new"), look(12, "new")]]
    stream = source(spark, parts, str(tmp_path / "in"), schema)
    found = folds.fingerprints_found(stream.where("kind = 'look'").withColumnRenamed("number", "message_id"), stream.where("kind <> 'look'").withColumnRenamed("number", "seq"), known)
    got, _ = run(found, "begun", str(tmp_path / "state"))
    assert {r.message_id: (r.weight, r.source, r.false_positives) for r in got} == {1: (60.0, "vote", 0), 3: (65.0, "vote", 0), 6: (80.0, "x", 0), 8: (90.0, "vote", 2), 10: (60.0, "disabled_false_positive", 3)}


@pytest.mark.parametrize("seed", [3, 4])
def test_contexts_on_a_stream_equal_the_scan(spark, tmp_path, seed):
    messages, events = context_rows(seed, 150)
    both = [(t, m, c, u, "message", kind, None) for m, c, u, t, kind in messages] + [(t, s, c, u, "change", None, d) for s, c, u, d, t in events]
    stream = source(spark, cut(both, 0, seed), str(tmp_path / "in"), "ts long, number long, chat_id long, user_id long, kind string, update_type string, delta double")
    asked = stream.where("kind = 'message'").withColumnRenamed("number", "message_id").withColumnRenamed("ts", "created_at")
    got, _ = run(folds.contexts(asked, stream.where("kind = 'change'").withColumnRenamed("number", "seq")), f"contexts{seed}", str(tmp_path / "state"))
    without_sender = {m for m, _, u, *_ in messages if u is None}
    assert {r.message_id: (r.reputation_score, r.messages_seen) for r in got} == {m: v for m, v in plain_context(messages, events).items() if m not in without_sender}


def rows_kept(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_skeletons_without_senders_are_forgotten(spark, tmp_path):
    rows = [(f"s{k}", k * 10 + j, j, 1000 + 10 * k, 1000 + 10 * k) for k in range(8) for j in range(5)]
    parts = [rows[:20], rows[20:], [("late", 900, 1, 90_000, 90_000)], [("later", 901, 1, 200_000, 200_000)], [("last", 902, 1, 300_000, 300_000)]]
    stream = timed(source(spark, parts, str(tmp_path / "in"), "skeleton_hash string, message_id long, user_id long, created_at long, ts long"))
    got, q = run(folds.repeat_senders(stream, Settings(), ends=True), "forgotten", str(tmp_path / "state"))
    assert {r.message_id: r.prior_senders for r in got} == {r[1]: r[1] % 10 if r[1] < 900 else 0 for p in parts for r in p}
    kept = rows_kept(q)
    assert max(kept) > 40 and kept[-1] < 15


def test_votes_and_ends_of_sessions_are_forgotten(spark, tmp_path):
    g = random.Random(7)
    votes = [(s, g.randrange(9), g.choice(["spam", "ham"]), 1000 + i, i, 1000 + i) for i, s in enumerate(g.randrange(12) for _ in range(200))]
    later = lambda t: [(99, 1, "spam", t, t, t)]
    schema = "session_id long, voter_user_id long, vote string, seq long, ts long, at long"
    parts = [[(s, v, k, q, t, t) for s, v, k, q, t, _ in part] for part in (votes[:100], votes[100:])] + [later(50_000), later(150_000), later(250_000)]
    stream = timed(source(spark, parts, str(tmp_path / "in"), schema))
    got, q = run(folds.vote_outcomes(stream, Settings(), keep=3600), "outcomes_kept", str(tmp_path / "state"))
    table = spark.createDataFrame([r for p in parts for r in p], schema)
    columns = ["session_id", "outcome", "closed_seq", "spam_votes", "ham_votes"]
    assert sorted(tuple(r[c] for c in columns) for r in got if r.session_id < 99) == sorted(map(tuple, state.vote_outcome(table.where("session_id < 99")).select(*columns).collect()))
    assert max(rows_kept(q)) > 20 and rows_kept(q)[-1] <= 6

    events = [(s, "open", None, None, 2000 + s, 1000, s) for s in range(10)] + [(s, "vote", "spam", v, None, 1500 + v, 100 + 10 * s + v) for s in range(5) for v in range(3)]
    early = [(50, "vote", "spam", v, None, 1200 + v, 900 + v) for v in range(3)]  # opened after its votes
    parts = [events + early, [(50, "open", None, None, 3000, 1300, 950)], [(70, "close", "admin_banned", None, None, 4000, 960)], *[[(99, "vote", "ham", 1, None, t, t)] for t in (50_000, 200_000, 350_000, 500_000)]]
    stream = timed(source(spark, parts, str(tmp_path / "ends"), "session_id long, kind string, what string, voter_user_id long, expires_at long, ts long, seq long"))
    got, q = run(folds.session_ends(stream, 0), "ends_kept", str(tmp_path / "ends-state"))
    assert {r.session_id: r.status for r in got} == {**{s: "confirmed_spam" for s in (*range(5), 50)}, **{s: "expired_released" for s in range(5, 10)}}
    assert len(got) == 11 and max(rows_kept(q)) > 20 and rows_kept(q)[-1] <= 6


def test_a_vote_costs_no_more_in_a_large_session(spark, monkeypatch):
    """The tally is kept, so a vote looks up its voter and no one else."""

    class Votes(dict):
        def containsKey(self, k):  # noqa: N802
            return k in self

        def getValue(self, k):  # noqa: N802
            return self[k]

        def updateValue(self, k, v):  # noqa: N802
            self[k] = v

        def iterator(self):
            raise AssertionError("all votes are read")

    votes, spam, ham, last = Votes(), 0, 0, {}
    g = random.Random(1)
    for _ in range(2000):
        voter, vote = g.randrange(300), g.choice(["spam", "ham"])
        spam, ham = folds.voted(votes, voter, vote, spam, ham)
        last[voter] = vote
        assert (spam, ham) == (list(last.values()).count("spam"), list(last.values()).count("ham"))


@pytest.fixture(scope="module")
def moderation_inputs(spark):
    from sluice.plans import decision_queries as Q
    from sluice.sources.bindings import relation
    from sluice.sources.shared import written

    sf = "/root/testdata/sf0.001"
    rows = written(Q.messages(spark, sf), "feature-rows")
    base = {"fingerprints": Q.fingerprints(rows, spark, sf), "users": relation(spark, sf, "user_reputation"), "sessions": Q.sessions_of(rows, spark, sf)}
    expected = {r.message_id: (r.action, r.reason, r.confidence, r.scorer) for r in Q.rule_decision(spark, sf).collect()}
    return relation(spark, sf, "messages"), {k: written(v, k) for k, v in base.items()}, relation(spark, sf, "user_profiles"), relation(spark, sf, "previews"), Q.SETTINGS, expected


def tables_of(spark, path):
    """All rows under a folder, file names left out."""
    names = ("decisions", "fingerprints", "users", "sessions", "sent", "spans")
    return {n: sorted(map(str, spark.read.option("recursiveFileLookup", True).parquet(f"{path}/{n}").collect())) for n in names}


def test_cascade_on_a_stream_equals_the_batch_and_replays_change_nothing(spark, tmp_path, moderation_inputs):
    from sluice.streaming.moderation import Moderation

    messages, base, profiles, previews, settings, expected = moderation_inputs
    edges = [0, 60, 130, 1_200_000_050, 2**62]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        messages.where(F.col("message_id").between(a, b - 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    still = Moderation(spark, f"{tmp_path}/still", profiles, previews, settings, learn=False)
    still.create(**base)
    assert still.start(stream, f"{tmp_path}/state").awaitTermination(300)
    got = {r.message_id: (r.action, r.reason, r.confidence, r.scorer) for r in still.decisions(4).collect()}
    assert got == expected

    learning = Moderation(spark, f"{tmp_path}/learning", profiles, previews, settings, every=2)
    learning.create(**base)
    parts = [spark.read.schema(messages.schema).parquet(f"{tmp_path}/in/{k}") for k in range(4)]
    stored = sorted(os.listdir(_folder(spark)))
    for k, part in enumerate(parts):
        learning.decide(part, k)
    assert sorted(os.listdir(_folder(spark))) == stored  # a stream that runs for long leaves nothing of its steps
    before = tables_of(spark, f"{tmp_path}/learning")
    for k in (1, 2, 3):
        learning.decide(parts[k], k)  # as after a failure between a batch and its commit
    assert tables_of(spark, f"{tmp_path}/learning") == before
    # State at the end: hits and messages seen add up over all batches, whether read from bases or from changes.
    whole = Moderation(spark, f"{tmp_path}/learning", profiles, previews, settings, every=2)
    users = whole.tables["users"].before(4).agg(F.sum("messages_seen")).first()[0]
    counted = messages.where("update_type <> 'edited_message' AND user_id IS NOT NULL").count()
    assert users == base["users"].agg(F.sum("messages_seen")).first()[0] + counted
    hits = whole.tables["fingerprints"].before(4)
    assert hits.agg(F.sum("hits")).first()[0] == learning.decisions(4).where("fp_value IS NOT NULL").count()
    plain = state.hit_weight(F.col("old"), F.coalesce("hits", F.lit(0)), settings)
    old = base["fingerprints"].select("value", F.col("weight").alias("old"))
    assert hits.join(old, "value").where(F.col("weight") != plain).isEmpty()
    opened = whole.tables["sessions"].before(4)
    assert opened.count() == base["sessions"].count() and opened.where("status = 'open'").count() > 0  # ids are those of messages


def test_versions_of_a_table(spark, tmp_path):
    """Any batch reads what those before it left, through several bases; a batch run again changes nothing."""
    from sluice.sources.versions import Versions

    table = Versions(spark, f"{tmp_path}/t", ("k",), "k bigint, v bigint", every=3)
    table.create(spark.createDataFrame([(None, 0), (1, 0), (2, 0)], "k long, v long"))
    g, plain, states = random.Random(2), {None: 0, 1: 0, 2: 0}, []
    for n in range(8):
        for _ in range(2):
            table.settle(n)
            assert {r.k: r.v for r in table.before(n).collect()} == plain
            changes = {g.choice([None, 1, 2, 3, 4]): 100 * n + 1}
            table.set(spark.createDataFrame(list(changes.items()), "k long, v long"), n)
        plain = {**plain, **changes}
        states.append(plain)
    assert {r.k: r.v for r in table.before(8).collect()} == states[-1]
    assert {r.k: r.v for r in table.before(5).collect()} == states[4]
