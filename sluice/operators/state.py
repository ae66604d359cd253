"""State as folds over append-only event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.settings import DEFAULT, Settings
from sluice.sources.shared import written

from .folding import folded, scanned


def latest(events: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The last event of each key; keys whose last event is a deletion are gone."""
    rest = [c for c in events.columns if c not in keys]
    out = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")
    return out.where(~F.col(deleted)).drop(deleted) if deleted else out


def latest_known(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last value of each column that is not null, by key."""
    return events.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def running_votes(votes: DataFrame) -> DataFrame:
    """Adds spam and ham, the session's tally after each vote. A voter's later vote replaces the earlier; others than spam and ham are dropped."""
    rows = votes.where(F.col("vote").isin("spam", "ham"))
    before = F.lag("vote").over(Window.partitionBy("session_id", "voter_user_id").orderBy("ts", "seq"))
    rows = rows.withColumn("before", before)
    running = Window.partitionBy("session_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    for kind in ("spam", "ham"):
        step = (F.col("vote") == kind).cast("int") - F.coalesce((F.col("before") == kind).cast("int"), F.lit(0))
        rows = rows.withColumn(kind, F.sum(step).over(running))
    return rows.drop("before")


def vote_tally(votes: DataFrame) -> DataFrame:
    """session_id, spam_votes, ham_votes: each voter's last vote counts."""
    last = votes.where(F.col("vote").isin("spam", "ham")).groupBy("session_id", "voter_user_id").agg(F.max_by("vote", F.struct("ts", "seq")).alias("vote"))
    return last.groupBy("session_id").agg(F.count_if(F.col("vote") == "spam").alias("spam_votes"), F.count_if(F.col("vote") == "ham").alias("ham_votes"))


def vote_outcome(votes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """session_id, outcome, closed_seq, spam_votes, ham_votes, reputation_delta of sessions that reach a threshold, spam looked at first."""
    n = settings.vote_min_confirmations
    hit = running_votes(votes).where((F.col("spam") >= n) | (F.col("ham") >= n))
    first = hit.groupBy("session_id").agg(F.min_by(F.struct("seq", "spam", "ham"), F.struct("ts", "seq")).alias("at"))
    spam = F.col("at.spam") >= n
    return first.select(
        "session_id", F.when(spam, "confirmed_spam").otherwise("released").alias("outcome"), F.col("at.seq").alias("closed_seq"), F.col("at.spam").alias("spam_votes"),
        F.col("at.ham").alias("ham_votes"), F.when(spam, -settings.spam_penalty).otherwise(settings.ham_reward).alias("reputation_delta"),
    )


def score_step(delta: Column) -> Column:
    """A change of reputation as a step x -> min(high, max(low, x + sum)), which composes."""
    return F.struct(F.lit(0.0).alias("low"), F.lit(100.0).alias("high"), delta.cast("double").alias("sum"))


def then_score(a: Column, b: Column) -> Column:
    """Two such steps in turn."""
    through = lambda x: F.greatest(b["low"], F.least(b["high"], x + b["sum"]))
    return F.struct(through(a["low"]).alias("low"), through(a["high"]).alias("high"), (a["sum"] + b["sum"]).alias("sum"))


def reputation(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """chat_id, user_id, reputation_score: from the default, each delta in turn, clamped to 0..100 at every step."""
    steps = events.select("chat_id", "user_id", "seq", score_step(F.col("delta")).alias("f"))
    out = folded(steps, ["chat_id", "user_id"], then_score)
    return out.select("chat_id", "user_id", F.greatest("f.low", F.least("f.high", settings.default_reputation + F.col("f.sum"))).alias("reputation_score"))


def context_as_of(messages: DataFrame, events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """message_id, reputation_score, messages_seen of the sender in the chat when each message came.

    `events` are changes (seq, chat_id, user_id, delta, ts); those before a
    message's created_at count.  Messages are in (created_at, message_id)
    order; an edit sees the state, but is not counted as seen.
    """
    step = lambda f, seen: F.struct(f["low"].alias("low"), f["high"].alias("high"), f["sum"].alias("sum"), seen.cast("bigint").alias("seen"))
    still = F.struct(F.lit(0.0).alias("low"), F.lit(100.0).alias("high"), F.lit(0.0).alias("sum"))
    # At one time messages come before changes.
    asked = messages.select(
        "chat_id", "user_id", F.col("created_at").alias("at"), F.lit(0).alias("phase"), F.col("message_id").alias("number"),
        F.when(F.col("update_type") != "edited_message", step(still, F.lit(1))).alias("f"),
    )
    changes = events.select("chat_id", "user_id", F.col("ts").alias("at"), F.lit(1).alias("phase"), F.col("seq").alias("number"), step(score_step(F.col("delta")), F.lit(0)).alias("f"))
    compose = lambda a, b: step(then_score(a, b), a["seen"] + b["seen"])
    rows = asked.where("user_id is not null").unionByName(changes)
    known = scanned(rows, ["chat_id", "user_id"], ["at", "phase", "number"], compose, _through_context, (settings.default_reputation, 0), "struct<score:double,seen:bigint>").where("phase = 0")
    known = known.select(F.col("number").alias("message_id"), F.col("before.score").alias("reputation_score"), F.col("before.seen").alias("messages_seen"))
    unknown = messages.where("user_id is null").select("message_id", F.lit(settings.default_reputation).alias("reputation_score"), F.lit(0).cast("bigint").alias("messages_seen"))
    return known.unionByName(unknown)


def _through_context(state: tuple, f: dict) -> tuple:
    return min(f["high"], max(f["low"], state[0] + f["sum"])), state[1] + f["seen"]


def user_activity(messages: DataFrame) -> DataFrame:
    """Messages seen, first and last time by chat and user; edits do not count."""
    return messages.where("update_type <> 'edited_message'").groupBy("chat_id", "user_id").agg(F.count("*").alias("messages_seen"), F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"))


def hit_weight(weight: Column, hits: Column, settings: Settings = DEFAULT) -> Column:
    """A fingerprint's weight after so many hits: up by 5 each, not beyond 80 unless it was."""
    return F.greatest(weight, F.least(weight + settings.hit_increment * hits, F.lit(settings.hit_cap)))


def penalised_weight(weight: Column, times: Column, settings: Settings = DEFAULT) -> Column:
    """A fingerprint's weight after so many false alarms."""
    return F.greatest(F.lit(0.0), weight - settings.false_positive_penalty * times)


def upsert_fingerprints(evidence: DataFrame) -> DataFrame:
    """id, fingerprint_type, value, weight, source, n from (seq, fingerprint_type, value, weight, source): one row a value.

    The weight is the largest, type and source are the last, the id the first's seq.
    """
    last = lambda c: F.max_by(c, "seq").alias(c)
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.max("weight")))
    return evidence.groupBy("value").agg(F.min("seq").alias("id"), last("fingerprint_type"), clamp.alias("weight"), last("source"), F.count("*").alias("n"))


#: What closed votes leave as the source of a fingerprint, and the source of one with too many false alarms.
VOTE_SOURCE, DISABLED_SOURCE, DISABLED_AFTER = "vote_confirmed", "disabled_false_positive", 3


def fold_feedback(evidence: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """value, fingerprint_type, weight, false_positives, source from ordered (seq, value, kind, fingerprint_type, weight, source).

    kind `up` adds the fingerprint or raises it to a weight, and sets type and
    source; `down` takes 30 off and counts a false alarm, and from the third on
    sets the source to disabled; on a value that is not there it does nothing.

    Both are x -> max(low, x + sum), which composes; a step says what becomes
    of a value that is there, and, from its first `up`, of one that is not.
    """
    steps = evidence.select("value", "seq", feedback_step(settings).alias("f"))
    return _fingerprint(folded(steps, ["value"], then_feedback).where("f.w >= 0"), F.col("f"))


def feedback_step(settings: Settings = DEFAULT) -> Column:
    """One piece of evidence (kind, fingerprint_type, weight, source) as a step."""
    up = F.col("kind") == "up"
    weight, text = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("weight"))), F.lit(None).cast("string")
    return F.struct(
        # What a value that is there has at least, its change of weight and its false alarms; what one that is not there comes to, or -1.
        F.when(up, weight).otherwise(0.0).alias("low"), F.when(up, 0.0).otherwise(-settings.false_positive_penalty).alias("sum"), F.when(up, 0).otherwise(1).alias("downs"),
        F.when(up, weight).otherwise(-1.0).alias("w"), F.lit(0).alias("n"), F.col("kind").alias("last"),
        F.when(up, F.col("fingerprint_type")).otherwise(text).alias("kind"), F.when(up, F.col("source")).otherwise(text).alias("source"),
    )


def then_feedback(a: Column, b: Column) -> Column:
    """Two such steps in turn."""
    there = a["w"] >= 0
    return F.struct(
        F.greatest(b["low"], a["low"] + b["sum"]).alias("low"), (a["sum"] + b["sum"]).alias("sum"), (a["downs"] + b["downs"]).alias("downs"),
        F.when(there, F.greatest(b["low"], a["w"] + b["sum"])).otherwise(b["w"]).alias("w"), F.when(there, a["n"] + b["downs"]).otherwise(b["n"]).alias("n"),
        b["last"].alias("last"), F.coalesce(b["kind"], a["kind"]).alias("kind"), F.coalesce(b["source"], a["source"]).alias("source"),
    )


def _through_feedback(state: tuple | None, f: dict) -> tuple | None:
    """(w, n, last, kind, source) of a value after a step; None while it is not there."""
    if state is None:
        return (f["w"], f["n"], f["last"], f["kind"], f["source"]) if f["w"] >= 0 else None
    w, n, _, kind, source = state
    return max(f["low"], w + f["sum"]), n + f["downs"], f["last"], f["kind"] or kind, source if f["source"] is None else f["source"]


def _fingerprint(rows: DataFrame, f: Column, *more: Column | str) -> DataFrame:
    """value, fingerprint_type, weight, false_positives and source of a state, and further columns."""
    disabled = (f["last"] == "down") & (f["n"] >= DISABLED_AFTER)
    return rows.select(
        "value", f["kind"].alias("fingerprint_type"), f["w"].alias("weight"), f["n"].cast("bigint").alias("false_positives"),
        F.when(disabled, DISABLED_SOURCE).otherwise(f["source"]).alias("source"), *more,
    )


def fingerprints_as_of(lookups: DataFrame, evidence: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """message_id, place, value, fingerprint_type, weight, false_positives, source of every lookup that finds something.

    `lookups` are (message_id, ts, place, fingerprint_type, value), `evidence`
    as `fold_feedback` has it, with ts.  A lookup sees the evidence before its
    time, and finds a fingerprint if its type is the one asked for.  Values that
    no evidence is about leave before anything is sorted.
    """
    none = lambda kind: F.lit(None).cast(kind)
    steps = evidence.select("value", F.col("ts").alias("at"), F.lit(1).alias("phase"), F.col("seq").alias("number"), none("bigint").alias("place"), none("string").alias("asked"), feedback_step(settings).alias("f"))
    steps = written(steps, "evidence-steps")
    known = lookups.join(steps.select("value").distinct(), "value", "left_semi")
    asked = known.select("value", F.col("ts").alias("at"), F.lit(0).alias("phase"), F.col("message_id").alias("number"), F.col("place").cast("bigint").alias("place"), F.col("fingerprint_type").alias("asked"), none(steps.schema["f"].dataType).alias("f"))
    state = "struct<w:double,n:int,last:string,kind:string,source:string>"
    rows = scanned(asked.unionByName(steps), ["value"], ["at", "phase", "number", "place", "asked"], then_feedback, _through_feedback, None, state)
    found = rows.where((F.col("phase") == 0) & (F.col("before.kind") == F.col("asked")))
    return _fingerprint(found, F.col("before"), F.col("number").alias("message_id"), "place")


def vote_evidence(outcomes: DataFrame, sessions: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Evidence for `fold_feedback` from closed sessions: their hashes up if confirmed, down if released, but for sentinels."""
    rows = outcomes.join(sessions.select(F.col("id").alias("session_id"), "skeleton_hash", "content_hash"), "session_id")
    hashes = F.array(*(F.struct(F.lit(kind).alias("type"), F.col(f"{kind}_hash").alias("value")) for kind in ("skeleton", "content")))
    both = rows.select("outcome", F.posexplode(hashes).alias("k", "h"), (F.col("closed_seq") * 2).alias("base"))
    kind = F.when(F.col("outcome") == "confirmed_spam", "up").otherwise("down")
    return both.where(P.meaningful(F.col("h.value"))).select(
        (F.col("base") + F.col("k")).alias("seq"), F.col("h.value").alias("value"), kind.alias("kind"), F.col("h.type").alias("fingerprint_type"),
        F.lit(settings.vote_weight).alias("weight"), F.lit(VOTE_SOURCE).alias("source"),
    )


def expired(sessions: DataFrame, now: int | Column, settings: Settings = DEFAULT) -> DataFrame:
    """Open sessions past their time, the oldest first, as many as one sweep takes; closed_at is the sweep's time."""
    due = sessions.where((F.col("status") == "open") & (F.col("expires_at") <= now)).orderBy("expires_at", "id").limit(settings.expire_batch)
    return due.withColumns({"status": F.lit("expired_released"), "closed_at": now if isinstance(now, Column) else F.lit(now).cast("bigint")})


def sweep_time(expires_at: Column, start: int, settings: Settings = DEFAULT) -> Column:
    """The first sweep at or after a time; sweeps come every interval (5 seconds at least) from `start` on. Votes until then count."""
    step = max(5, settings.sweep_interval_seconds)
    return (F.lit(start) + F.ceil((expires_at - start) / step) * step).cast("bigint")


def close_sessions(sessions: DataFrame, votes: DataFrame, closes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """session_id, status, closed_at, spam_votes, ham_votes of every session after its votes and `closes` (session_id, status, at).

    The first to close a session wins: the vote that reaches a threshold (spam
    looked at first), or a close by an admin or a sweep; of equal times the
    close, which then stops the vote.  Votes after that change nothing.
    """
    first = closes.groupBy("session_id").agg(F.min_by(F.struct("status", "at"), F.struct("at", "status")).alias("c"))
    rows = running_votes(votes.join(first, "session_id", "left").where("c is null or ts < c.at").select(*votes.columns))
    n = settings.vote_min_confirmations
    hit = (F.col("spam") >= n) | (F.col("ham") >= n)
    tally = F.struct("ts", "seq", "spam", "ham")
    done = rows.groupBy("session_id").agg(F.min_by(tally, F.when(hit, F.struct("ts", "seq"))).alias("hit"), F.max_by(tally, F.struct("ts", "seq")).alias("end"))
    out = sessions.select(F.col("id").alias("session_id")).join(done, "session_id", "left").join(first, "session_id", "left")
    at = F.coalesce("hit", "end")
    by_vote = F.when(F.col("hit.spam") >= n, "confirmed_spam").otherwise("released")
    status = F.when(F.col("hit").isNotNull(), by_vote).otherwise(F.coalesce("c.status", F.lit("open")))
    zero = F.lit(0).cast("bigint")
    return out.select(
        "session_id", status.alias("status"), F.when(F.col("hit").isNotNull(), F.col("hit.ts")).otherwise(F.col("c.at")).alias("closed_at"),
        F.coalesce(at["spam"], zero).alias("spam_votes"), F.coalesce(at["ham"], zero).alias("ham_votes"),
    )


def ban_cascade(bans: DataFrame, sessions: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """For each (chat_id, user_id, message_id) banned: session_ids of the user's open sessions in the chat (newest 50), and
    deleted_ids of all messages to delete.

    Which sessions are newest does not depend on the ban, so they are ranked
    and gathered once a user and chat, and a ban joins one row.
    """
    opened = sessions.where("status = 'open' and suspect_user_id is not null")
    newest = Window.partitionBy("chat_id", "suspect_user_id").orderBy(F.desc("created_at"), F.desc("id"))
    opened = opened.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= settings.max_sessions)
    known = opened.groupBy("chat_id", F.col("suspect_user_id").alias("user_id")).agg(F.array_sort(F.collect_set("id")).alias("session_ids"), F.collect_set("original_message_id").alias("originals"))
    rows = bans.select("chat_id", "user_id", "message_id").join(known, ["chat_id", "user_id"], "left")
    none = F.array().cast("array<bigint>")
    gone = F.array_sort(F.array_distinct(F.concat(F.coalesce("originals", none), F.array("message_id"))))
    return rows.select("chat_id", "user_id", "message_id", F.coalesce("session_ids", none).alias("session_ids"), gone.alias("deleted_ids"))


def set_value(rows: DataFrame, changes: DataFrame, key: str, column: str, order: str = "seq") -> DataFrame:
    """`rows` with `column` of the last of `changes` (key, column, order) where there is one, a null value too; changes of
    rows that are not there do nothing.  Bios, ids of vote messages and times of notifications are set so."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(column), order).alias("_set"))
    out = rows.join(last, key, "left")
    return out.withColumn(column, F.when(F.col("_set").isNotNull(), F.col(f"_set.{column}")).otherwise(F.col(column))).drop("_set")


def delete_rows(rows: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """`rows` without those whose `key` is among `deletes`."""
    return rows.join(deletes.select(key), key, "left_anti")


def deleted_counts(rows: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """key and n, the rows that each of `deletes` takes away; 0 for one that finds none."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"))
    return deletes.select(key).distinct().join(found, key, "left").select(key, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def refresh_bios(profiles: DataFrame, answers: DataFrame, now: int, settings: Settings = DEFAULT) -> DataFrame:
    """`profiles` after asking for the bios of the stale ones: `answers` has (user_id, bio) of those that answered.

    An answer sets the bio, to none too; who did not answer keeps the old one.
    Either way the time of asking is noted, so that a failure waits as long.
    """
    if not settings.bio_enabled:
        return profiles
    stale = F.col("bio_fetched_at").isNull() | (F.lit(now) - F.col("bio_fetched_at") >= settings.bio_ttl_seconds)
    rows = profiles.join(answers.groupBy("user_id").agg(F.max_by(F.struct("bio"), F.lit(1)).alias("_answer")), "user_id", "left")
    return rows.withColumns({"bio": F.when(stale & F.col("_answer").isNotNull(), F.col("_answer.bio")).otherwise(F.col("bio")), "bio_fetched_at": F.when(stale, F.lit(now).cast("bigint")).otherwise(F.col("bio_fetched_at"))}).drop("_answer")
