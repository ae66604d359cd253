"""Context, profiles and fingerprints of a message."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.functions import phrases as R
from sluice.functions import text as T
from sluice.settings import DEFAULT, Settings
from sluice.sources.shared import Scratch, written

from .folding import running


def with_context(messages: DataFrame, reputation: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds reputation_score and messages_seen of the sender in the chat, with defaults for a new one, and is_first_message."""
    known = reputation.select("chat_id", "user_id", "reputation_score", "messages_seen")
    rows = messages.join(known, ["chat_id", "user_id"], "left")
    return rows.withColumns({"reputation_score": F.coalesce("reputation_score", F.lit(settings.default_reputation)), "messages_seen": F.coalesce("messages_seen", F.lit(0).cast("bigint"))}).withColumn("is_first_message", F.col("messages_seen") <= 0)


def with_profile(messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds username, display_name, first_name, last_name and bio."""
    known = profiles.select("user_id", "username", T.display_name(F.col("first_name"), F.col("last_name")).alias("display_name"), "first_name", "last_name", "bio")
    return messages.join(known, "user_id", "left")


#: Fields whose phrases are looked up besides the message's own, in this order.
PREVIEW_FIELDS = ("title", "description", "site_name", "image_alt", "text")
PROFILE_FIELDS = ("username", "display_name", "first_name", "last_name", "bio")


def with_preview(messages: DataFrame, previews: DataFrame) -> DataFrame:
    """Adds og_url and og_ with each of `PREVIEW_FIELDS` of the message's preview link; a field that `previews` (url and og_ columns) lacks is null."""
    fields = [f"og_{f}" for f in PREVIEW_FIELDS]
    known = previews.select(F.col("url").alias("og_url"), *((F.col(f) if f in previews.columns else F.lit(None).cast("string")).alias(f) for f in fields))
    # Most messages have no link, and rows of a null key would all meet in one task: a second key deals them out.
    rows = messages.withColumn("_dealt", F.xxhash64(F.coalesce("preview_link", F.col("message_id").cast("string"))))
    same = (F.col("preview_link") == F.col("og_url")) & (F.col("_dealt") == F.col("_og_dealt"))
    return rows.join(known.withColumn("_og_dealt", F.xxhash64("og_url")), same, "left").drop("_dealt", "_og_dealt")


def beside(rows: DataFrame, keys: list[str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows` with the columns that `add` adds to their `keys` alone.

    Those few columns go through all joins of `add`, and texts are moved once,
    by keys that no other row has, however often a sender or a link recurs.
    """
    told = add(rows.select(*keys).distinct())
    named = {k: f"_of_{k}" for k in keys}
    told = told.select(*(F.col(k).alias(n) for k, n in named.items()), *(c for c in told.columns if c not in keys))
    return rows.join(told, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()], "left").drop(*named.values())


def phrase_fields() -> tuple[Column, ...]:
    """The preview's and the sender's texts, after `with_preview` and `with_profile`."""
    return tuple(F.col(f"og_{f}") for f in PREVIEW_FIELDS) + tuple(F.col(f) for f in PROFILE_FIELDS)


def lookup_keys(phrase_texts: tuple[Column, ...] = (), known: R.Known | None = None, low: Column | None = None) -> Column:
    """Array of (type, value) under which a message's fingerprints may be known, strongest evidence first. low: whether the skeleton says nothing, where it is known."""
    low = P.is_low_entropy_skeleton(F.col("skeleton")) if low is None else low
    skeleton = F.when(P.meaningful(F.col("skeleton_hash")) & ~low, F.col("skeleton_hash"))
    content = F.when(P.meaningful(F.col("content_hash")) & ~T.is_low_entropy_text(F.col("clean")), F.col("content_hash"))
    return R.lookup_keys(skeleton, content, F.col("clean"), *phrase_texts, known=known)


#: Values that a filter is made of, at most, its places for each, and its places in all (32 MB). With 16 places a value,
#: two of them set, one unknown value in 70 passes; of 60 million values, one in six.
MOST_VALUES, PLACES, MOST_PLACES = 1 << 26, 16, 1 << 28


def known_values(values: DataFrame, most: int = MOST_VALUES) -> R.Known | None:
    """A test whether a value may be among the rows of `values` (a column value); null if those are more than `most`.

    A Bloom filter: bits are joined by an aggregate, come to the driver in
    words of 64, at most two a value, and go to the tasks with their function.
    """
    n = values.count()
    if n > most:
        return None
    places = 192 * max(1, -(-min(n * PLACES, MOST_PLACES) // 192))  # whole words, and whole sixes of bits
    each = values.where("value is not null").select(F.explode(F.array(*R.Known.slots(F.col("value"), places))).alias("slot"))
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("slot") % 64).cast("int"))).alias("bits")
    bits = each.groupBy(F.shiftright("slot", 6).alias("at")).agg(word).toArrow()
    table = np.zeros(places // 64, "<i8")
    table[bits["at"].to_numpy()] = bits["bits"].to_numpy()
    return R.Known(table.tobytes(), places)


def keys_of(features: DataFrame, key: str = "message_id", phrase_texts: tuple[Column, ...] = (), *more: str, may_be: R.Known | None = None) -> DataFrame:
    """key, place, fingerprint_type and value of the keys of all messages, and further columns of theirs.

    `may_be` says which values are wanted, and others never leave their
    message's task; places are in the keys' order, but count only the rest.
    """
    # Explodes the keys as they are made: of a named array Spark would ask first whether it has any, and make it for that, too.
    rows = features.select(key, *more, F.posexplode(lookup_keys(phrase_texts, may_be, P.low_shape(features))).alias("place", "k"))
    return rows.select(key, *more, "place", F.col("k.type").alias("fingerprint_type"), F.col("k.value").alias("value"))


def heaviest(hits: DataFrame, key: str = "message_id", **columns: str) -> DataFrame:
    """key and, under other names, `columns` of the heaviest of its hits (weight, place, ...); of equal ones the first place's.

    An aggregate, so that the choice is partial before the shuffle: no window over a message's keys.
    """
    best = F.max_by(F.struct(*columns.values()), F.struct(F.col("weight"), -F.col("place"))).alias("best")
    return hits.groupBy(key).agg(best).select(key, *(F.col(f"best.{c}").alias(n) for n, c in columns.items()))


def strongest_fingerprint(features: DataFrame, fingerprints: DataFrame, key: str = "message_id", phrase_texts: tuple[Column, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """key, fp_id, fp_type, fp_value, fp_weight of the heaviest known fingerprint; of equal ones the first key's.

    Fingerprints are stored first, and a filter of their values, where they are
    few enough, is asked before a message's keys are exploded; so what crosses
    the shuffle are hits and few others.  What is stored goes with `scratch`,
    and with the application where none is given.
    """
    known = (scratch.written if scratch else written)(fingerprints.select("id", "fingerprint_type", "value", "weight"), "known-fingerprints")
    keys = keys_of(features, key, phrase_texts, may_be=known_values(known))
    hits = keys.join(known, ["fingerprint_type", "value"])
    return heaviest(hits, key, fp_id="id", fp_type="fingerprint_type", fp_value="value", fp_weight="weight")


def prior_senders(features: DataFrame, window: int, scratch: Scratch | None = None) -> DataFrame:
    """message_id, prior_senders: other users with the same skeleton in the last `window` seconds before each message.

    Crosses chats.  Rows are in (created_at, message_id) order; only earlier
    ones count, and rows that are equal in both are not earlier than one another.

    Time is cut into buckets as long as the window.  A user's messages of one
    skeleton in a bucket reach from the first of them to the bucket's end, and
    into the next bucket for a window after the last.  So a user is at most two
    spans in a bucket, known from two partial aggregates; the users that reach a
    message are a running sum over the spans' ends in its bucket, less its own.
    The work is linear in a skeleton's rows, however often it is copied, and no
    task holds all rows of a skeleton.  A row whose skeleton or time is null has
    no prior senders; rows of no user have some and are none.
    """
    # Stored, as three branches read these few columns of rows that took long to make.
    sent = (scratch.written if scratch else written)(features.select("message_id", "user_id", "skeleton_hash", "created_at"), "sent")
    timeless = F.col("skeleton_hash").isNull() | F.col("created_at").isNull()
    rows = sent.where(~timeless).withColumn("bucket", F.floor(F.col("created_at") / window))
    group = ["skeleton_hash", "bucket"]
    at = F.struct(F.col("created_at").alias("t"), F.col("message_id").alias("m"))
    own = rows.where("user_id is not null").groupBy(*group, "user_id").agg(F.min(at).alias("first"), F.max("created_at").alias("last"))
    none = F.lit(None)
    here = own.select(*group, "user_id", "first", none.cast("bigint").alias("until"))
    before = own.select("skeleton_hash", (F.col("bucket") + 1).alias("bucket"), "user_id", none.cast(own.schema["first"].dataType).alias("first"), (F.col("last") + window).alias("until"))
    spans = here.unionByName(before).groupBy(*group, "user_id").agg(F.max("first").alias("first"), F.max("until").alias("until"))
    # A user reaches into the bucket from before, until a time; and from the first message on, to the bucket's end.
    least, most = F.lit(-(2**63)).cast("bigint"), F.lit(2**63 - 1).cast("bigint")
    event = lambda t, m, step: F.struct(t.alias("t"), m.alias("m"), F.lit(step).alias("step"))
    whole = F.col("until").isNotNull() & F.col("first").isNotNull() & (F.col("first.t") <= F.col("until"))
    enters = F.when(F.col("until").isNotNull(), event(least, least, 1))
    leaves = F.when(F.col("until").isNotNull() & ~whole, event(F.col("until"), most, -1))
    writes = F.when(F.col("first").isNotNull() & ~whole, event(F.col("first.t"), F.col("first.m"), 1))
    ends = spans.select(*group, F.explode(F.array_compact(F.array(enters, leaves, writes))).alias("e")).select(*group, "e.t", "e.m", F.lit(1).alias("kind"), "e.step")
    own_reach = F.coalesce(F.col("created_at") <= F.col("until"), F.lit(False)) | F.coalesce(F.col("first") < at, F.lit(False))
    seen = rows.join(spans, [*group, "user_id"], "left").select(*group, F.col("created_at").alias("t"), F.col("message_id").alias("m"), F.lit(0).alias("kind"), F.lit(0).alias("step"), own_reach.cast("int").alias("own"))
    both = seen.unionByName(ends.withColumn("own", F.lit(0)))
    # A row's own beginning stands after the row and all that equal it.
    out = running(both, group, ["t", "m", "kind"], "step", "reached", scratch).where("kind = 0")
    out = out.select(F.col("m").alias("message_id"), (F.col("reached") - F.col("own")).cast("bigint").alias("prior_senders"))
    return out.unionByName(sent.where(timeless).select("message_id", F.lit(0).cast("bigint").alias("prior_senders")))


#: Parts that the messages about one text of a sender are dealt into.
PARTS = 16


def open_repeats(features: DataFrame, sessions: DataFrame, settings: Settings = DEFAULT, scratch: Scratch | None = None) -> DataFrame:
    """message_id, session_ids (at most 10, newest first): earlier open sessions of the sender in the chat about the same text.

    Only the newest 50 sessions of a user count; an earlier session is one
    opened before the message was written.

    Messages that share no text with an earlier session of their sender leave
    first, then the sessions of senders that have no message left.
    Sessions are numbered in the order of a sender's, and a message knows how
    many of them are before it, both from one running sum; so the newest 50 are
    a range of numbers, which two blocks of 50 numbers cover, and blocks are
    keys of a join: a message meets at most 100 sessions, and carries none.
    Sessions about a text that is asked for lie in each of `PARTS` parts of a
    key, a message in one.  Rows with a null chat or user have no repeats, rows
    of one message are one.
    """
    content = F.when(F.col("content_hash") != P.EMPTY_HASH, F.col("content_hash"))
    shape = F.when((F.col("skeleton_hash") != P.EMPTY_HASH) & ~P.low_shape(features), F.col("skeleton_hash"))
    # Explodes an array as it is made: for a filtered one, Spark would make it twice.
    about = lambda c, s: F.explode(F.array(F.struct(F.lit(0).alias("of"), c.alias("hash")), F.struct(F.lit(1).alias("of"), s.alias("hash")))).alias("about")
    sender = ["chat_id", "user_id"]
    text = [*sender, "of", "hash"]
    both = F.col("content_hash"), F.col("skeleton_hash")
    opened = sessions.where("status = 'open' and chat_id is not null and suspect_user_id is not null and created_at is not null")
    opened = opened.select("chat_id", F.col("suspect_user_id").alias("user_id"), F.col("created_at").alias("at"), F.col("id").alias("key"), *both)
    store = scratch.written if scratch else written
    opened = store(opened, "open-sessions")
    # A message mostly has a session of its own, which is no earlier one: the first session about a text tells.
    first = opened.select(*sender, "at", about(*both)).groupBy(*sender, "about.of", "about.hash").agg(F.min("at").alias("first"))
    own = features.select(*sender, F.col("created_at").alias("at"), F.col("message_id").alias("key"), about(content, shape)).select(*sender, "at", "key", "about.*")
    own = store(own.where("at is not null and hash is not null").join(first, text).where("first < at").drop("first"), "asking-messages")
    opened = opened.join(own.select(*sender).distinct(), sender, "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    steps = opened.withColumns({"of": none("int"), "hash": none("string"), "step": F.lit(1)})
    asks = own.withColumns({"content_hash": none("string"), "skeleton_hash": none("string"), "step": F.lit(0)})
    numbered = running(steps.unionByName(asks), sender, ["at", "step", "key"], "step", "number", scratch)
    most = settings.max_sessions
    block = lambda number: F.floor((number - 1) / most)
    asked = numbered.where("step = 0 and number > 0").select(*text, F.col("key").alias("message_id"), "number")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("message_id"), F.lit(PARTS)).cast("int")).withColumn("block", F.explode(F.array(block(F.col("number")), block(F.col("number")) - 1)))
    known = numbered.where("step = 1").select(*sender, F.col("key").alias("session_id"), F.col("number").alias("n"), block(F.col("number")).alias("block"), about(*both))
    known = known.select(*sender, "about.*", "session_id", "n", "block").join(own.select(*text).distinct(), text, "left_semi")
    known = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    found = asked.join(known.hint("merge"), [*text, "block", "part"]).where(F.col("n") > F.col("number") - most)
    # Newest first: numbers are in the order of time.
    found = found.where(F.col("n") <= F.col("number")).groupBy("message_id").agg(F.sort_array(F.collect_set(F.struct("n", "session_id")), asc=False).alias("found"))
    return found.select("message_id", F.transform(F.slice("found", 1, 10), lambda s: s["session_id"]).alias("session_ids"))
