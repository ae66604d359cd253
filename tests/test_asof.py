"""State as of a row, and folds of hot keys, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import folding, state


def plain_context(messages, events):
    """(score, seen) of each message, one event after another."""
    rows = [(t, 0, m, c, u, kind) for m, c, u, t, kind in messages] + [(t, 1, s, c, u, d) for s, c, u, d, t in events]
    score, seen, out = {}, {}, {}
    for _, phase, number, c, u, what in sorted(rows, key=lambda r: r[:3]):
        if phase:
            score[c, u] = max(0.0, min(100.0, score.get((c, u), 50.0) + what))
        elif u is None:
            out[number] = (50.0, 0)
        else:
            out[number] = (score.get((c, u), 50.0), seen.get((c, u), 0))
            seen[c, u] = seen.get((c, u), 0) + (what != "edited_message")
    return out


def context_rows(seed, n=400):
    """Two of three rows are one busy sender's."""
    g = random.Random(seed)
    who = lambda: (1, 7) if g.random() < 0.66 else (g.randrange(3), g.choice([None, 1, 2, 3]))
    messages = [(k, *who(), g.randrange(200), g.choice(["message", "message", "edited_message"])) for k in range(n)]
    events = [(k, c, u, g.choice([8.0, -35.0, 60.0]), g.randrange(200)) for k in range(n) for c, u in [who()] if u is not None]
    return messages, events


@pytest.mark.parametrize("bits", [2, 14])
def test_context_as_of_equals_a_loop(spark, monkeypatch, bits):
    monkeypatch.setattr(folding, "BITS", bits)
    messages, events = context_rows(bits)
    got = state.context_as_of(
        spark.createDataFrame(messages, "message_id long, chat_id long, user_id long, created_at long, update_type string").repartition(7),
        spark.createDataFrame(events, "seq long, chat_id long, user_id long, delta double, ts long").repartition(5),
    )
    assert {r.message_id: (r.reputation_score, r.messages_seen) for r in got.collect()} == plain_context(messages, events)
    none = state.context_as_of(got.sparkSession.createDataFrame([], "message_id long, chat_id long, user_id long, created_at long, update_type string"), spark.createDataFrame(events, "seq long, chat_id long, user_id long, delta double, ts long"))
    assert none.collect() == []


def plain_fingerprints(lookups, evidence):
    known, out = {}, {}
    rows = [(t, 0, m, p, kind, v) for m, t, p, kind, v in lookups] + [(t, 1, s, v, kind, ft, w, src) for s, v, kind, ft, w, src, t in evidence]
    for row in sorted(rows, key=lambda r: r[:3]):
        if row[1] == 0:
            _, _, m, p, asked, v = row
            if v in known and known[v][0] == asked:
                out[m, p] = known[v]
        else:
            _, _, _, v, kind, ft, w, src = row
            if kind == "up":
                old = known.get(v, (None, 0.0, 0, None))
                known[v] = (ft, max(old[1], max(0.0, min(100.0, w))), old[2], src)
            elif v in known:
                t0, w0, n, s0 = known[v]
                known[v] = (t0, max(0.0, w0 - 30), n + 1, "disabled_false_positive" if n + 1 >= 3 else s0)
    return out


def fingerprint_rows(seed, n=300):
    g = random.Random(seed)
    value = lambda: "hot" if g.random() < 0.6 else f"v{g.randrange(5)}"
    lookups = [(k, t, p, g.choice(["content", "phrase"]), g.choice([value(), "never"])) for k in range(n) for t in [g.randrange(100)] for p in range(2)]
    evidence = [(k, value(), g.choice(["up", "down", "down"]), g.choice(["content", "phrase"]), float(g.randrange(-10, 120)), f"s{k}", g.randrange(100)) for k in range(n)]
    return lookups, evidence


LOOKUPS, EVIDENCE = "message_id long, ts long, place int, fingerprint_type string, value string", "seq long, value string, kind string, fingerprint_type string, weight double, source string, ts long"


@pytest.mark.parametrize("bits", [3, 14])
def test_fingerprints_as_of_equal_a_loop(spark, monkeypatch, bits):
    """Evidence that comes before, between and after the messages, ups and downs of one hot value."""
    monkeypatch.setattr(folding, "BITS", bits)
    lookups, evidence = fingerprint_rows(bits)
    got = state.fingerprints_as_of(spark.createDataFrame(lookups, LOOKUPS).repartition(6), spark.createDataFrame(evidence, EVIDENCE).repartition(4)).collect()
    assert {(r.message_id, r.place): (r.fingerprint_type, r.weight, r.false_positives, r.source) for r in got} == plain_fingerprints(lookups, evidence)


def test_lists_stay_bounded_for_a_sparse_hot_key(spark, monkeypatch):
    """One key with all events, far apart: no list at any level is longer than the bound, and the fold is the loop's."""
    monkeypatch.setattr(folding, "BITS", 4)
    sizes = []
    chained = folding._chained

    def noted(steps, kind, compose):
        sizes.append(F.size(steps))
        return F.when(F.size(steps) > 16, F.raise_error(F.lit("long list")).cast(kind)).otherwise(chained(steps, kind, compose))

    monkeypatch.setattr(folding, "_chained", noted)
    g = random.Random(3)
    seqs = sorted(g.sample(range(-(10**9), 10**12), 3000))
    deltas = [g.choice([8.0, -35.0, 20.0]) for _ in seqs]
    score = 50.0
    for d in deltas:
        score = max(0.0, min(100.0, score + d))
    rows = [(s, 1, 1, d) for s, d in zip(seqs, deltas, strict=True)]
    got = state.reputation(spark.createDataFrame(rows, "seq long, chat_id long, user_id long, delta double")).collect()
    assert [r.reputation_score for r in got] == [score] and len(sizes) > 5
    assert state.reputation(spark.createDataFrame([], "seq long, chat_id long, user_id long, delta double")).collect() == []


def test_a_hot_key_lies_in_many_tasks(spark):
    """90 % of the rows are one key's; no piece of the scan is more than a part of them."""
    rows = spark.range(60_000).selectExpr("id AS message_id", "1L AS chat_id", "IF(id % 10 = 0, id, 7L) AS user_id", "id AS created_at", "'message' AS update_type")
    events = spark.range(60_000).selectExpr("id AS seq", "1L AS chat_id", "IF(id % 10 = 0, id, 7L) AS user_id", "IF(id % 3 = 0, -8D, 5D) AS delta", "id AS ts")
    got = state.context_as_of(rows, events)
    hot = got.where("message_id % 10 <> 0")
    assert hot.agg(F.max("messages_seen")).first()[0] == 54_000 - 1
    assert got.where("message_id % 10 = 0 AND (messages_seen <> 0 OR reputation_score <> 50)").isEmpty()
