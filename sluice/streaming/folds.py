"""The batch folds as `transformWithState` operators.

Each keeps what the fold needs of a key and nothing more.  Within a
micro-batch a key's rows are put in order.  Operators with timers work in event
time: they want a watermark on the stream (`sources.timed`), and rows that come
later than that do not reach them; `sources.split_late` keeps those.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.operators.state import DISABLED_AFTER, DISABLED_SOURCE
from sluice.settings import DEFAULT, Settings


class _Ending(StatefulProcessor):
    """A key's state that goes once nothing has come for it for a while.

    `keep` is that while in seconds of event time; None keeps state for good,
    and needs no watermark.  One timer a key is enough: rows move it on.
    """

    keep: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def stay(self, last: int) -> None:
        """State is wanted until `keep` after the time `last`, at least."""
        if self.keep is None:
            return
        old, new = self.due.get()[0] if self.due.exists() else None, last + self.keep + 1
        if old is None or new > old:
            if old is not None:
                self.handle.deleteTimer(old * 1000)
            self.handle.registerTimer(new * 1000)
            self.due.update((new,))

    def clear(self) -> None:
        """Ends all further state of the key."""

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.clear()
        self.due.clear()
        yield from ()

    def close(self) -> None:
        pass


class RepeatSenders(_Ending):
    """By skeleton: the last time of each user in the window; out comes each message's number of other users.

    The users in the window are read once a batch, and looked at in the order
    of their times from then on, so a batch costs its rows and those users.
    """

    def __init__(self, window: int, ends: bool = False):
        self.window, self.keep = window, window if ends else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getMapState("last", "user_id long", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["created_at", "message_id"])
        stored = {k[0]: v[0] for k, v in self.last.iterator()}
        last, out = dict(stored), []
        order = collections.deque(sorted((at, user) for user, at in last.items()))
        for message, user, at in zip(batch.message_id, batch.user_id, batch.created_at, strict=True):
            while order and order[0][0] < at - self.window:
                old, gone = order.popleft()
                if last.get(gone) == old:
                    del last[gone]
            known = not pd.isna(user)
            out.append((message, len(last) - (known and int(user) in last)))
            if known:
                # A user's latest time is enough: it is in the window if any is.
                last[int(user)] = int(at)
                order.append((int(at), int(user)))
        for user in stored.keys() - last.keys():
            self.last.removeKey((user,))
        for user, at in last.items():
            if stored.get(user) != at:
                self.last.updateValue((user,), (at,))
        self.stay(int(batch.created_at.max()))
        yield pd.DataFrame(out, columns=["message_id", "prior_senders"])

    def clear(self) -> None:
        self.last.clear()


class VoteSession(_Ending):
    """By session: each voter's last vote and the tally, until a threshold closes it; out comes the outcome, once. Votes go when it closes."""

    def __init__(self, least: int, keep: int | None = None):
        self.least, self.keep = least, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.votes = handle.getMapState("votes", "voter_user_id long", "vote string")
        self.tally = handle.getValueState("tally", "spam long, ham long, closed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        self.stay(int(batch.ts.max()))
        spam, ham, closed = self.tally.get() if self.tally.exists() else (0, 0, False)
        if closed:
            return
        for voter, vote, seq in zip(batch.voter_user_id, batch.vote, batch.seq, strict=True):
            if vote not in ("spam", "ham"):
                continue
            spam, ham = voted(self.votes, int(voter), vote, spam, ham)
            if spam >= self.least or ham >= self.least:
                self.tally.update((spam, ham, True))
                self.votes.clear()
                yield pd.DataFrame([(key[0], "confirmed_spam" if spam >= self.least else "released", seq, spam, ham)], columns=["session_id", "outcome", "closed_seq", "spam_votes", "ham_votes"])
                return
        self.tally.update((spam, ham, False))

    def clear(self) -> None:
        self.votes.clear()
        self.tally.clear()


def voted(votes: Any, voter: int, vote: str, spam: int, ham: int) -> tuple[int, int]:
    """The tally after one more vote, which replaces the voter's earlier one; only that is looked up."""
    old = votes.getValue((voter,))[0] if votes.containsKey((voter,)) else None
    if old != vote:
        votes.updateValue((voter,), (vote,))
        spam += (vote == "spam") - (old == "spam")
        ham += (vote == "ham") - (old == "ham")
    return spam, ham


class Reputation(StatefulProcessor):
    """By chat and user: the score, clamped at every step; out comes the score after each batch."""

    def __init__(self, default: float):
        self.default = default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.score = handle.getValueState("score", "score double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        score = self.score.get()[0] if self.score.exists() else self.default
        for delta in pd.concat(list(rows)).sort_values("seq").delta:
            score = max(0.0, min(100.0, score + float(delta)))
        self.score.update((score,))
        yield pd.DataFrame([(*key, score)], columns=["chat_id", "user_id", "reputation_score"])

    def close(self) -> None:
        pass


class SessionLife(_Ending):
    """By session: its opening, votes and closes until the first of them closes it, or the first sweep after its time; out comes how it ended, once.

    Votes count until that sweep, though the session's time is over; votes at
    or after it do not, whenever they come.  What comes before the opening
    waits for it.  Votes go when the session ends, and the rest when nothing
    has come for it for `keep` seconds.
    """

    def __init__(self, least: int, start: int, interval: int, keep: int):
        self.least, self.start, self.interval, self.keep = least, start, interval, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.votes = handle.getMapState("votes", "voter_user_id long", "vote string")
        # ends: the sweep; status, at: how it ended, or what ends it once it is opened; done: whether that was said.
        self.life = handle.getValueState("life", "spam long, ham long, ends long, status string, at long, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        spam, ham, ends, status, at, done = self.life.get() if self.life.exists() else (0, 0, None, None, None, False)
        for kind, what, voter, ts, until in zip(batch.kind, batch.what, batch.voter_user_id, batch.ts, batch.expires_at, strict=True):
            if kind == "open" and ends is None:
                ends = self.start + -(-(int(until) - self.start) // self.interval) * self.interval
                self.handle.registerTimer(ends * 1000)
            elif status is not None or (ends is not None and ts >= ends):
                continue
            elif kind == "close":
                status, at = what, int(ts)
            elif what in ("spam", "ham"):
                spam, ham = voted(self.votes, int(voter), what, spam, ham)
                if spam >= self.least or ham >= self.least:
                    status, at = "confirmed_spam" if spam >= self.least else "released", int(ts)
        if ends is not None and status is not None and not done:
            done = True
            self.votes.clear()
            yield self._end(key, status, at, spam, ham)
        self.life.update((spam, ham, ends, status, at, done))
        self.stay(max(int(batch.ts.max()), ends or 0))

    def _end(self, key: Any, status: str, at: int, spam: int, ham: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], status, at, spam, ham)], columns=["session_id", "status", "closed_at", "spam_votes", "ham_votes"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spam, ham, ends, status, at, done = self.life.get() if self.life.exists() else (0, 0, None, None, None, True)
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if ends == now and not done:
            self.votes.clear()
            self.life.update((spam, ham, ends, "expired_released", ends, True))
            yield self._end(key, "expired_released", ends, spam, ham)
        if self.due.exists() and self.due.get()[0] <= now:
            yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def clear(self) -> None:
        self.votes.clear()
        self.life.clear()


class Fingerprints(StatefulProcessor):
    """By value: what is known of it; evidence changes that, and out comes what each lookup finds before the evidence after it."""

    def __init__(self, penalty: float, increment: float, cap: float):
        self.penalty, self.increment, self.cap = penalty, increment, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "fingerprint_type string, weight double, source string, false_positives long, hits long")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        for row in initialState.itertuples():
            self.known.update((row.fingerprint_type, float(row.weight), row.source, int(row.false_positives), 0))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["at", "phase", "number"])
        now, out = self.known.get() if self.known.exists() else None, []
        before = now
        for kind, number, place, asked, weight, source in zip(batch.kind, batch.number, batch.place, batch.fingerprint_type, batch.weight, batch.source, strict=True):
            if kind == "look":
                if now and now[0] == asked:
                    out.append((int(number), int(place), asked, key[0], now[1], now[2], now[3]))
            elif kind == "up":
                old = now or (None, 0.0, None, 0, 0)
                now = (asked, max(old[1], max(0.0, min(100.0, float(weight)))), source, old[3], old[4])
            elif now and kind == "down":
                wrong = now[3] + 1
                now = (now[0], max(0.0, now[1] - self.penalty), DISABLED_SOURCE if wrong >= DISABLED_AFTER else now[2], wrong, now[4])
            elif now and kind == "hit":
                now = (now[0], max(now[1], min(now[1] + self.increment, self.cap)), now[2], now[3], now[4] + 1)
        if now != before:
            self.known.update(now)
        yield pd.DataFrame(out, columns=["message_id", "place", "fingerprint_type", "value", "weight", "source", "false_positives"])

    def close(self) -> None:
        pass


class Heaviest(StatefulProcessor):
    """By message: the heaviest of what its lookups found, of equal ones the first place's. Lookups of a message come in one batch, so nothing is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = pd.concat(list(rows)).sort_values(["weight", "place"], ascending=[False, True]).iloc[:1]
        yield found.rename(columns={"fingerprint_type": "fp_type", "value": "fp_value", "weight": "fp_weight", "source": "fp_source"}).drop(columns="place")

    def close(self) -> None:
        pass


class Context(StatefulProcessor):
    """By chat and user: score and messages seen; out comes the state before each message, which then counts as seen unless it is an edit."""

    def __init__(self, default: float):
        self.default = default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "score double, seen long")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        for row in initialState.itertuples():
            self.state.update((float(row.reputation_score), int(row.messages_seen)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        score, seen = self.state.get() if self.state.exists() else (self.default, 0)
        out = []
        batch = pd.concat(list(rows)).sort_values(["at", "phase", "number"])
        for phase, number, delta, counts in zip(batch.phase, batch.number, batch.delta, batch.counts, strict=True):
            if phase:
                score = max(0.0, min(100.0, score + float(delta)))
            else:
                out.append((int(number), score, seen))
                seen += int(counts)
        self.state.update((score, seen))
        yield pd.DataFrame(out, columns=["message_id", "reputation_score", "messages_seen"])

    def close(self) -> None:
        pass


class Delayed(StatefulProcessor):
    """By chat and message: something to do later; out comes a row to do it, when its time has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = int(pd.concat(list(rows)).due_at.min())
        if not self.due.exists():
            self.due.update((at,))
            self.handle.registerTimer(at * 1000)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = self.due.get()[0]
        self.due.clear()
        yield pd.DataFrame([("delete", *key, at)], columns=["kind", "chat_id", "message_id", "due_at"])

    def close(self) -> None:
        pass


class BioCache(StatefulProcessor):
    """By user: that the bio was asked for, which is forgotten after its time; out comes for each message whether to ask now."""

    def __init__(self, ttl_seconds: int):
        self.ttl_seconds = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.asked = handle.getValueState("asked", "message_id long", ttlDurationMs=self.ttl_seconds * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, out = pd.concat(list(rows)).sort_values("message_id"), []
        for message in batch.message_id:
            fresh = self.asked.exists()
            if not fresh:
                self.asked.update((int(message),))
            out.append((int(key[0]), int(message), not fresh))
        yield pd.DataFrame(out, columns=["user_id", "message_id", "ask"])

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str, time: str = "None", known: DataFrame | None = None) -> DataFrame:
    first = None if known is None else known.groupBy(*keys)
    return df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode=mode, timeMode=time, initialState=first)


def _timed(ends: bool) -> tuple[tuple[str, ...], str]:
    return (("event_time",), "EventTime") if ends else ((), "None")


def repeat_senders(messages: DataFrame, settings: Settings = DEFAULT, ends: bool = False) -> DataFrame:
    """message_id, prior_senders of a stream with skeleton_hash, message_id, user_id, created_at; of a timed one with `ends`,
    where a skeleton's state goes once no message can count its users any more."""
    more, time = _timed(ends)
    rows = messages.select("skeleton_hash", "message_id", "user_id", "created_at", *more)
    return _run(rows, ["skeleton_hash"], RepeatSenders(settings.repeat_window_seconds, ends), "message_id long, prior_senders long", "Append", time)


def vote_outcomes(votes: DataFrame, settings: Settings = DEFAULT, keep: int | None = None) -> DataFrame:
    """Outcomes of a stream of votes, as `operators.state.vote_outcome` has them; with `keep`, of a timed one, where a
    session without votes for so many seconds is forgotten."""
    more, time = _timed(keep is not None)
    rows = votes.select("session_id", "voter_user_id", "vote", "ts", "seq", *more)
    return _run(rows, ["session_id"], VoteSession(settings.vote_min_confirmations, keep), "session_id long, outcome string, closed_seq long, spam_votes long, ham_votes long", "Append", time)


def fingerprints_found(lookups: DataFrame, evidence: DataFrame, known: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """message_id, place, fingerprint_type, value, weight, source, false_positives of what each lookup finds, as
    `operators.state.fingerprints_as_of` has it, on streams.

    `lookups` and `evidence` have that operator's columns; evidence may have
    the kind `hit` too.  `known` is a table of fingerprints (value,
    fingerprint_type, weight, source, false_positives) to begin with.  Within a
    micro-batch a value's rows are in the order of their times; what comes in a
    later batch is later.
    """
    none = lambda kind: F.lit(None).cast(kind)
    asked = lookups.select("value", F.col("ts").alias("at"), F.lit(0).alias("phase"), F.col("message_id").alias("number"), F.col("place").cast("int"), F.lit("look").alias("kind"), "fingerprint_type", none("double").alias("weight"), none("string").alias("source"))
    steps = evidence.select("value", F.col("ts").alias("at"), F.lit(1).alias("phase"), F.col("seq").alias("number"), F.lit(0).alias("place"), "kind", "fingerprint_type", F.col("weight").cast("double"), "source")
    processor = Fingerprints(settings.false_positive_penalty, settings.hit_increment, settings.hit_cap)
    schema = "message_id long, place int, fingerprint_type string, value string, weight double, source string, false_positives long"
    return _run(asked.unionByName(steps), ["value"], processor, schema, "Append", known=known)


def strongest_found(found: DataFrame) -> DataFrame:
    """message_id, fp_type, fp_value, fp_weight, fp_source, false_positives: of each message's finds the heaviest."""
    return _run(found, ["message_id"], Heaviest(), "message_id long, fp_type string, fp_value string, fp_weight double, fp_source string, false_positives long", "Append")


def contexts(messages: DataFrame, events: DataFrame, known: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """message_id, reputation_score, messages_seen of senders when their messages come, as `operators.state.context_as_of`
    has them, on streams. `known` is a table of (chat_id, user_id, reputation_score, messages_seen) to begin with."""
    seen = (F.col("update_type") != "edited_message").alias("counts")
    asked = messages.where("user_id is not null").select("chat_id", "user_id", F.col("created_at").alias("at"), F.lit(0).alias("phase"), F.col("message_id").alias("number"), F.lit(0.0).alias("delta"), seen)
    changes = events.select("chat_id", "user_id", F.col("ts").alias("at"), F.lit(1).alias("phase"), F.col("seq").alias("number"), "delta", F.lit(False).alias("counts"))
    return _run(asked.unionByName(changes), ["chat_id", "user_id"], Context(settings.default_reputation), "message_id long, reputation_score double, messages_seen long", "Append", known=known)


def reputation(events: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Scores of a stream of (seq, chat_id, user_id, delta), one row a key and batch."""
    return _run(events, ["chat_id", "user_id"], Reputation(settings.default_reputation), "chat_id long, user_id long, reputation_score double", "Update")


#: How long a session that has ended is known, and one that is never opened.
SESSION_KEEP = 86_400


def session_ends(events: DataFrame, start: int, settings: Settings = DEFAULT, keep: int = SESSION_KEEP) -> DataFrame:
    """How sessions end, as `operators.state.close_sessions` has it, from a timed stream of (session_id, kind, what,
    voter_user_id, expires_at, ts, seq): kind open (with expires_at), vote (what: spam or ham) or close (what: the status)."""
    life = SessionLife(settings.vote_min_confirmations, start, max(5, settings.sweep_interval_seconds), keep)
    return _run(events, ["session_id"], life, "session_id long, status string, closed_at long, spam_votes long, ham_votes long", "Append", "EventTime")


def delayed_deletes(effects: DataFrame) -> DataFrame:
    """Rows to delete what a timed stream of (chat_id, message_id, due_at) says, once its time has come."""
    return _run(effects, ["chat_id", "message_id"], Delayed(), "kind string, chat_id long, message_id long, due_at long", "Append", "EventTime")


def bios_to_ask(messages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """user_id, message_id, ask of a stream of messages: whether the sender's bio is due to be asked for."""
    rows = messages.where("user_id is not null").select("user_id", "message_id")
    return _run(rows, ["user_id"], BioCache(settings.bio_ttl_seconds), "user_id long, message_id long, ask boolean", "Append", "ProcessingTime")
