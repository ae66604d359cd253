"""Gating, joins, repeats, the rule cascade and verdicts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.operators import gating, lookup, rules, scoring, state
from sluice.operators.features import features, spread
from sluice.settings import Settings
from sluice.sources.bindings import SHORT_IDS, START, relation
from sluice.sources.shared import written

from . import duck as D
from .registry import query
from .text_queries import phrases_of

#: The provided rows are far apart in time, so the look-back is a day.
WINDOW = 86_400
SETTINGS = Settings(repeat_window_seconds=WINDOW, notify_user_ids=(7, 9), admin_user_ids=(3, 14, 15))

#: What is known of fingerprints: both hashes of labelled messages, the text of toxic ones, and what verdicts say of spam.
_LABELLED = f"features f JOIN labels l ON l.doc_id = f.message_id % {SHORT_IDS}"
D.EXTRA |= {
    "sessions": "SELECT s.*, f.content_hash, f.skeleton_hash FROM vote_sessions s JOIN features f ON f.message_id = s.original_message_id",
    "evidence": f"""SELECT message_id * 4 AS seq, 'skeleton' AS fingerprint_type, skeleton_hash AS value, CAST(30 + (message_id * 7) % 66 AS DOUBLE) AS weight, 'manual' AS source FROM {_LABELLED}
      UNION ALL SELECT message_id * 4 + 1, 'content', content_hash, CAST(30 + message_id % 66 AS DOUBLE), 'vote' FROM {_LABELLED}
      UNION ALL SELECT message_id * 4 + 2, 'phrase', {D.digest("concat('phrase:', clean)")}, CAST(25 + message_id % 60 AS DOUBLE), 'scorer' FROM {_LABELLED} WHERE toxic = 1 AND clean <> ''
      UNION ALL SELECT message_id * 4 + 3, 'phrase', value, CAST(20 + message_id % 40 AS DOUBLE), 'llm_spam_phrase' FROM learnt WHERE fingerprint_type = 'phrase'""",
    "said": "SELECT message_id, unnest(string_split(phrases, '|')) AS phrase FROM verdicts WHERE status = 'ok' AND is_spam AND confidence >= 0.70",
    "learnt": f"""SELECT f.message_id, 'skeleton' AS fingerprint_type, skeleton_hash AS value, 50.0::DOUBLE AS weight, 'llm_spam' AS source FROM features f JOIN verdicts v ON v.chat_id = f.chat_id AND v.message_id = f.message_id
        WHERE status = 'ok' AND is_spam AND confidence >= 0.70 AND {D.meaningful('skeleton_hash')} AND NOT {D.low_skeleton('skeleton')}
      UNION ALL SELECT message_id, 'phrase', {D.digest(f"concat('phrase:', {D.normalize('phrase')})")}, 50.0::DOUBLE, 'llm_spam_phrase' FROM said WHERE NOT {D.low_text(D.normalize('phrase'))}""",
    "fingerprints": "SELECT value, min(seq) AS id, arg_max(fingerprint_type, seq) AS fingerprint_type, greatest(0.0::DOUBLE, least(100.0::DOUBLE, max(weight))) AS weight, arg_max(source, seq) AS source, count(*) AS n FROM evidence GROUP BY value",
    "keys": f"""SELECT message_id, 0 AS place, 'skeleton' AS fingerprint_type, skeleton_hash AS value FROM features WHERE {D.meaningful("skeleton_hash")} AND NOT {D.low_skeleton("skeleton")}
      UNION ALL SELECT message_id, 1, 'content', content_hash FROM features WHERE {D.meaningful("content_hash")} AND NOT {D.low_text("clean")}
      UNION ALL SELECT message_id, 1 + n, 'phrase', {D.digest("concat('phrase:', phrase)")} FROM phrases WHERE NOT {D.low_text("phrase")}""",
    "strongest": """SELECT message_id, id AS fp_id, fingerprint_type AS fp_type, value AS fp_value, weight AS fp_weight FROM keys JOIN fingerprints USING (fingerprint_type, value)
      QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY weight DESC, place) = 1""",
    "repeats": f"""SELECT a.message_id, count(DISTINCT b.user_id) AS prior_senders FROM features a LEFT JOIN features b
      ON b.skeleton_hash = a.skeleton_hash AND b.message_id < a.message_id AND b.created_at >= a.created_at - {WINDOW} AND b.user_id <> a.user_id GROUP BY a.message_id""",
    "open_repeats": f"""SELECT message_id, list(session_id ORDER BY place)[1:10] AS session_ids FROM (
        SELECT f.message_id, s.id AS session_id, f.content_hash AS fc, f.skeleton_hash AS fs, f.skeleton, s.content_hash AS sc, s.skeleton_hash AS ss,
               row_number() OVER (PARTITION BY f.message_id ORDER BY s.created_at DESC, s.id DESC) AS place
        FROM features f JOIN sessions s ON s.chat_id = f.chat_id AND s.suspect_user_id = f.user_id AND s.status = 'open' AND s.created_at < f.created_at QUALIFY place <= 50)
      WHERE (fc = sc AND fc <> '{P.EMPTY_HASH}') OR (fs = ss AND fs <> '{P.EMPTY_HASH}' AND NOT {D.low_skeleton("skeleton")}) GROUP BY message_id""",
    "inputs": """SELECT f.*, coalesce(r.reputation_score, 50.0::DOUBLE) AS reputation_score, coalesce(r.messages_seen, 0) AS messages_seen, p.bio, g.og_text, s.fp_type, s.fp_weight, s.fp_value, o.session_ids, q.prior_senders
      FROM features f LEFT JOIN user_reputation r ON r.chat_id = f.chat_id AND r.user_id = f.user_id LEFT JOIN user_profiles p ON p.user_id = f.user_id
      LEFT JOIN previews g ON g.url = f.preview_link LEFT JOIN strongest s ON s.message_id = f.message_id LEFT JOIN open_repeats o ON o.message_id = f.message_id LEFT JOIN repeats q ON q.message_id = f.message_id""",
    "ranked": f"""SELECT *, CASE WHEN fp_value NOT IN ({D.quoted(P.SENTINELS)}) THEN fp_weight END AS w, CASE WHEN reputation_score <= 20 THEN '_low_reputation' ELSE '' END AS low,
      (skeleton_hash <> '{P.EMPTY_HASH}' AND NOT {D.low_skeleton("skeleton")}) AS shape, {D.spam_bio("bio")} AS bad_bio, coalesce({D.strong(D.normalize("og_text"))}, false) AS bad_og FROM inputs""",
    "decided": """SELECT *, CASE WHEN rule <= 6 THEN 'ban' WHEN rule IN (7, 8, 10) THEN 'withdraw_vote' ELSE 'review' END AS action,
      CASE rule WHEN 1 THEN 'repeated_open_vote_message_same_user' WHEN 2 THEN 'repeated_skeleton_across_senders' WHEN 3 THEN concat('known_high_weight_fingerprint', low) WHEN 4 THEN 'spam_profile_bio'
        WHEN 5 THEN 'hard_spam_message' WHEN 6 THEN 'hard_spam_link_preview' WHEN 7 THEN 'known_high_weight_fingerprint_generalized' WHEN 8 THEN 'known_fingerprint' WHEN 9 THEN 'weak_fingerprint_needs_llm'
        WHEN 10 THEN 'empty_or_punctuation_with_link_preview' WHEN 11 THEN 'link_message_needs_llm' ELSE 'unmatched_message_needs_llm' END AS reason,
      CAST(CASE rule WHEN 1 THEN 0.97 WHEN 2 THEN 0.97 WHEN 3 THEN 0.95 WHEN 4 THEN 0.96 WHEN 5 THEN 0.96 WHEN 6 THEN 0.96 WHEN 7 THEN least(0.90::DOUBLE, w / 100) WHEN 8 THEN least(0.90::DOUBLE, w / 100)
        WHEN 9 THEN least(0.55::DOUBLE, w / 100) WHEN 10 THEN 0.82 WHEN 11 THEN 0.45 ELSE 0 END AS DOUBLE) AS confidence, rule > 6 AS scorer FROM (
      SELECT *, CASE WHEN reputation_score < 80 AND len(session_ids) > 0 THEN 1 WHEN len(links) > 0 AND reputation_score < 80 AND shape AND coalesce(prior_senders, 0) + 1 >= 3 THEN 2
        WHEN w >= 85 AND fp_type = 'content' AND reputation_score < 80 THEN 3 WHEN bad_bio THEN 4 WHEN clean <> '' AND carrier AND strong THEN 5 WHEN has_preview AND bad_og THEN 6
        WHEN w >= 85 THEN 7 WHEN w >= 40 THEN 8 WHEN w IS NOT NULL THEN 9 WHEN punctuation_only AND has_preview THEN 10 WHEN len(links) > 0 THEN 11 ELSE 12 END AS rule FROM ranked)""",
    "judged": """SELECT d.*, v.status AS verdict_status, v.is_spam, v.error, v.category, v.phrases, v.confidence AS verdict_confidence,
      CASE WHEN v.status = 'ok' THEN CASE WHEN NOT v.is_spam THEN 'allow' WHEN v.confidence >= 0.85 AND reputation_score < 80 THEN 'ban' WHEN v.confidence >= 0.70 THEN 'withdraw_vote' ELSE 'review' END END AS v_action,
      CASE WHEN v.status = 'ok' THEN CASE WHEN NOT v.is_spam THEN 'llm_not_spam' WHEN v.confidence >= 0.85 AND reputation_score < 80 THEN concat('llm_spam_high_confidence', low) WHEN v.confidence >= 0.70 THEN 'llm_spam' ELSE 'llm_low_confidence' END END AS v_reason
      FROM decided d LEFT JOIN verdicts v ON v.chat_id = d.chat_id AND v.message_id = d.message_id""",
    "outcomes": """SELECT session_id, arg_min(spam, (ts, seq)) AS spam_votes, arg_min(ham, (ts, seq)) AS ham_votes, arg_min(seq, (ts, seq)) AS closed_seq FROM (
      SELECT *, sum(CAST(vote = 'spam' AS INT) - CAST(before IS NOT NULL AND before = 'spam' AS INT)) OVER w AS spam, sum(CAST(vote = 'ham' AS INT) - CAST(before IS NOT NULL AND before = 'ham' AS INT)) OVER w AS ham FROM (
        SELECT *, lag(vote) OVER (PARTITION BY session_id, voter_user_id ORDER BY ts, seq) AS before FROM votes WHERE vote IN ('spam', 'ham'))
      WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE spam >= 3 OR ham >= 3 GROUP BY session_id""",
}
_TEXTS = ("messages", "texts", "features")


_FIELDS = ("username", f"CASE WHEN p.user_id IS NOT NULL THEN concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')) END", "first_name", "last_name", "bio")
#: Relation `phrases` of a message's text, its link's preview and its sender's profile, in that order.
ALL_PHRASES = phrases_of(
    "SELECT message_id, 0 AS f, clean FROM texts"
    + "".join(f" UNION ALL SELECT f.message_id, {1 + i}, {D.normalize(c)} FROM features f JOIN previews g ON g.url = f.preview_link" for i, c in ((0, "og_title"), (1, "og_description"), (4, "og_text")))
    + "".join(f" UNION ALL SELECT f.message_id, {6 + i}, {D.normalize(c)} FROM features f JOIN user_profiles p USING (user_id)" for i, c in enumerate(_FIELDS))
)


def chain(*more: str) -> str:
    """WITH of all that a decision rests on, and of `more`."""
    first = D.with_(*_TEXTS, "user_profiles", "previews", "verdicts", "said", "learnt").rstrip() + ALL_PHRASES
    return first + ",\n" + D.with_(*more).removeprefix("WITH ")


_ALL = ("user_reputation", "vote_sessions", "sessions", "evidence", "fingerprints", "keys", "strongest", "repeats", "open_repeats", "inputs", "ranked", "decided")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(features(spread(relation(spark, sf_dir, "messages"), "message_id")))


def shaped(rows: DataFrame) -> DataFrame:
    """Feature rows with low_shape, which stands in for skeletons where rows are stored or moved."""
    return rows.withColumn("low_shape", P.is_low_entropy_skeleton(F.col("skeleton")))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "verdicts").withColumnRenamed("confidence", "verdict_confidence")
    return rows.withColumn("signal_phrases", F.filter(F.split("phrases", r"\|"), lambda p: p != "")).drop("phrases")


def sessions_of(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote sessions with the hashes of their messages, among the feature rows."""
    hashes = rows.select(F.col("message_id").alias("original_message_id"), "content_hash", "skeleton_hash")
    return relation(spark, sf_dir, "vote_sessions").join(hashes, "original_message_id")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_of(messages(spark, sf_dir), spark, sf_dir)


def evidence(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of fingerprints, from the feature rows."""
    labels = relation(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "toxic")
    m = F.col("message_id")
    row = lambda seq, kind, value, weight, source: F.struct(seq.alias("seq"), F.lit(kind).alias("fingerprint_type"), value.alias("value"), weight.cast("double").alias("weight"), F.lit(source).alias("source"))
    both = [row(m * 4, "skeleton", F.col("skeleton_hash"), 30 + (m * 7) % 66, "manual"), row(m * 4 + 1, "content", F.col("content_hash"), 30 + m % 66, "vote")]
    phrase = F.when((F.col("toxic") == 1) & F.col("whole").isNotNull(), row(m * 4 + 2, "phrase", F.col("whole"), 25 + m % 60, "scorer"))
    # Hashes go through the join, and no texts.
    hashes = rows.select("message_id", "content_hash", "skeleton_hash", F.when(F.col("clean") != "", P.stable_hash(F.concat(F.lit("phrase:"), "clean"))).alias("whole"))
    labelled = hashes.join(labels, m % SHORT_IDS == F.col("label_id"))
    known = labelled.select(F.explode(F.array_compact(F.array(*both, phrase))).alias("e")).select("e.*")
    said = learnt(rows, spark, sf_dir).where("fingerprint_type = 'phrase'")
    return known.unionByName(said.select((m * 4 + 3).alias("seq"), "fingerprint_type", "value", (20 + m % 40).cast("double").alias("weight"), "source"))


#: What evidence is made of, and what else the lookup of fingerprints reads.
EVIDENCE = ("message_id", "chat_id", "clean", "low_shape", "content_hash", "skeleton_hash")
LOOKUP = (*EVIDENCE, "user_id", "created_at", "preview_link")


def taught_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of the messages that a label or a verdict is about, which all evidence comes from; others' features aren't made."""
    labels = relation(spark, sf_dir, "labels").select(F.col("doc_id").cast("bigint").alias("about"))
    judged_ = relation(spark, sf_dir, "verdicts").select((F.col("message_id") % SHORT_IDS).alias("about"))
    sent = relation(spark, sf_dir, "messages").join(labels.unionByName(judged_).distinct(), F.col("message_id") % SHORT_IDS == F.col("about"), "left_semi")
    return written(shaped(features(spread(sent, "message_id"))).select(*EVIDENCE), "feature-rows")


def learnt(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verdicts teach, from the feature rows."""
    return scoring.spam_evidence(rows.join(verdicts(spark, sf_dir), ["chat_id", "message_id"]))


def fingerprints(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert_fingerprints(evidence(rows, spark, sf_dir))


def told_of(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a user_id and a preview_link, with that sender's profile and that link's preview."""
    return lookup.with_preview(lookup.with_profile(rows, relation(spark, sf_dir, "user_profiles")), relation(spark, sf_dir, "previews"))


def known_of(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows with their sender's profile and their link's preview."""
    return lookup.beside(rows, ["message_id", "user_id", "preview_link"], lambda keys: told_of(keys, spark, sf_dir))


def in_context(rows: DataFrame, spark: SparkSession, sf_dir: str, *more: DataFrame) -> DataFrame:
    """Feature rows with profile, preview and the sender's reputation, and with what tables by message_id tell."""

    def add(keys: DataFrame) -> DataFrame:
        found = lookup.with_context(told_of(keys, spark, sf_dir), relation(spark, sf_dir, "user_reputation"))
        return functools.reduce(lambda known, one: known.join(one, "message_id", "left"), more, found)

    return lookup.beside(rows, ["message_id", "chat_id", "user_id", "preview_link"], add)


def strongest_of(rows: DataFrame, spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """The heaviest known fingerprint of every message, its link's preview and its sender's profile. known: the fingerprints, where they are made."""
    known = fingerprints(rows, spark, sf_dir) if known is None else known
    return lookup.strongest_fingerprint(known_of(rows, spark, sf_dir), known, phrase_texts=lookup.phrase_fields())


#: What decisions read of a feature row; of the text itself, reports and the log show so many characters.
_ROW = ("message_id", "chat_id", "user_id", "created_at", "clean", "low_shape", "content_hash", "skeleton_hash", "links", "preview_link", "has_preview", "punctuation_only", "carrier", "strong")
SHOWN = 800
_DECIDED = ("message_id", "chat_id", "user_id", "created_at", "reputation_score", "action", "reason", "confidence", "scorer")


def decisions(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The whole local decision of every message, with `more` columns of what it rests on (the text up to `SHOWN` characters).

    The feature rows, which several branches read, are stored once, and each
    reads the columns that it needs.  Decisions are stored, too: what is asked
    of them, and numbers that look at them twice, don't make them again.
    """
    shown = [F.substring("text", 1, SHOWN).alias("text")] if "text" in more else []
    rows = written(messages(spark, sf_dir).select(*_ROW, *shown), "feature-rows")
    best = strongest_of(rows, spark, sf_dir)
    repeats = lookup.prior_senders(rows, WINDOW)
    again = lookup.open_repeats(rows, sessions_of(rows, spark, sf_dir), SETTINGS)
    # A rule only asks whether there is a canonical text.
    rows = rows.withColumn("clean", F.substring("clean", 1, 1))
    decided = rules.decide(in_context(rows, spark, sf_dir, best, repeats, again), SETTINGS)
    return written(decided.select(*_DECIDED, *more), "decisions")


def judged(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return rules.merge(decisions(spark, sf_dir, *more).join(verdicts(spark, sf_dir), ["chat_id", "message_id"], "left"), SETTINGS)


_SCOPE = """chat_type IN ('group', 'supergroup') AND NOT (update_type <> 'edited_message' AND coalesce(is_automatic_forward AND (sender_chat_id IS NULL OR sender_chat_id <> chat_id), false))
  AND user_id IS NOT NULL AND user_id <> 0 AND NOT starts_with(trim(text), '/')"""


@query(D.with_("messages") + f"SELECT message_id FROM messages WHERE {_SCOPE}")
def moderation_scope(spark, sf_dir):
    return relation(spark, sf_dir, "messages").where(gating.in_scope()).select("message_id")


@query(D.with_("messages", "allowed_chats") + f"SELECT message_id, chat_id FROM messages WHERE {_SCOPE} AND user_id <> 777000 AND chat_id IN (SELECT chat_id FROM allowed_chats)")
def allowed_chats(spark, sf_dir):
    return gating.gate(relation(spark, sf_dir, "messages"), relation(spark, sf_dir, "allowed_chats")).select("message_id", "chat_id")


@query(D.with_("messages", "whitelisted_users") + f"SELECT message_id, user_id FROM messages WHERE {_SCOPE} AND user_id <> 777000 AND user_id NOT IN (SELECT user_id FROM whitelisted_users)")
def whitelist_bypass(spark, sf_dir):
    return gating.gate(relation(spark, sf_dir, "messages"), None, relation(spark, sf_dir, "whitelisted_users")).select("message_id", "user_id")


@query(D.with_(*_TEXTS) + r"SELECT message_id, preview_link FROM features WHERE has_preview AND (punctuation_only OR length(regexp_replace(clean, '\s+', '', 'g')) <= 8)")
def og_candidates(spark, sf_dir):
    return messages(spark, sf_dir).where(gating.wants_preview()).select("message_id", "preview_link")


_NOW = START + 2_000_000


@query(D.with_("user_profiles") + f"SELECT user_id FROM user_profiles WHERE bio_fetched_at IS NULL OR {_NOW} - bio_fetched_at >= 604800")
def stale_profiles(spark, sf_dir):
    return relation(spark, sf_dir, "user_profiles").where(gating.is_stale(F.lit(_NOW))).select("user_id")


@query(D.with_(*_TEXTS) + f"SELECT message_id, {D.meaningful('content_hash')} AS content, {D.meaningful('skeleton_hash')} AS skeleton FROM features")
def meaningful_fp(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", P.meaningful(F.col("content_hash")).alias("content"), P.meaningful(F.col("skeleton_hash")).alias("skeleton"))


@query(D.with_("messages", "user_reputation") + "SELECT message_id, coalesce(reputation_score, 50.0::DOUBLE) AS reputation_score, coalesce(messages_seen, 0) AS messages_seen, coalesce(messages_seen, 0) = 0 AS is_first_message FROM messages LEFT JOIN user_reputation USING (chat_id, user_id)")
def user_context(spark, sf_dir):
    return lookup.with_context(relation(spark, sf_dir, "messages"), relation(spark, sf_dir, "user_reputation")).select("message_id", "reputation_score", "messages_seen", "is_first_message")


@query(D.with_("messages", "user_profiles") + "SELECT message_id, username, CASE WHEN p.user_id IS NOT NULL THEN concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')) END AS display_name, bio FROM messages m LEFT JOIN user_profiles p USING (user_id)")
def message_profile(spark, sf_dir):
    return lookup.with_profile(relation(spark, sf_dir, "messages"), relation(spark, sf_dir, "user_profiles")).select("message_id", "username", "display_name", "bio")


@query(chain("evidence", "fingerprints") + "SELECT value, id, fingerprint_type, weight, source, n FROM fingerprints")
def fingerprint_upsert(spark, sf_dir):
    return fingerprints(taught_rows(spark, sf_dir), spark, sf_dir).select("value", "id", "fingerprint_type", "weight", "source", "n")


@query(chain("evidence", "fingerprints", "keys", "strongest") + "SELECT * FROM strongest")
def strongest_fingerprint(spark, sf_dir):
    return strongest_of(written(messages(spark, sf_dir).select(*LOOKUP), "feature-rows"), spark, sf_dir)


@query(D.with_(*_TEXTS, "repeats") + "SELECT * FROM repeats")
def repeat_senders(spark, sf_dir):
    return lookup.prior_senders(messages(spark, sf_dir), WINDOW)


@query(D.with_(*_TEXTS, "vote_sessions", "sessions", "open_repeats") + "SELECT message_id, array_to_string(session_ids, ',') AS session_ids FROM open_repeats")
def open_vote_repeat(spark, sf_dir):
    rows = messages(spark, sf_dir).select("message_id", "chat_id", "user_id", "created_at", "content_hash", "skeleton_hash", "low_shape")
    rows = written(rows, "feature-rows")
    found = lookup.open_repeats(rows, sessions_of(rows, spark, sf_dir), SETTINGS)
    return found.select("message_id", F.array_join(F.col("session_ids").cast("array<string>"), ",").alias("session_ids"))


@query(chain(*_ALL) + "SELECT message_id, action, reason, confidence, scorer FROM decided")
def rule_decision(spark, sf_dir):
    return decisions(spark, sf_dir).select("message_id", "action", "reason", "confidence", "scorer")


@query(chain(*_ALL) + "SELECT action, reason, count(*) AS n FROM decided GROUP BY ALL")
def decision_summary(spark, sf_dir):
    return decisions(spark, sf_dir).groupBy("action", "reason").agg(F.count("*").alias("n"))


@query(D.with_("messages", "user_reputation", "verdicts") + """SELECT v.message_id, CASE WHEN NOT is_spam THEN 'allow' WHEN confidence >= 0.85 AND coalesce(reputation_score, 50) < 80 THEN 'ban' WHEN confidence >= 0.70 THEN 'withdraw_vote' ELSE 'review' END AS action,
  CASE WHEN NOT is_spam THEN 'llm_not_spam' WHEN confidence >= 0.85 AND coalesce(reputation_score, 50) < 80 THEN concat('llm_spam_high_confidence', CASE WHEN coalesce(reputation_score, 50) <= 20 THEN '_low_reputation' ELSE '' END)
    WHEN confidence >= 0.70 THEN 'llm_spam' ELSE 'llm_low_confidence' END AS reason, confidence
  FROM verdicts v JOIN messages m ON m.chat_id = v.chat_id AND m.message_id = v.message_id LEFT JOIN user_reputation r ON r.chat_id = m.chat_id AND r.user_id = m.user_id WHERE status = 'ok'""")
def llm_decision(spark, sf_dir):
    rows = lookup.with_context(relation(spark, sf_dir, "messages").join(verdicts(spark, sf_dir), ["chat_id", "message_id"]), relation(spark, sf_dir, "user_reputation"))
    rows = rows.withColumn("d", rules.verdict_decision()).where("d is not null")
    return rows.select("message_id", "d.action", "d.reason", "d.confidence")


_TAKES = "scorer AND v_action IS NOT NULL AND (action IN ('allow', 'review') OR v_action IN ('withdraw_vote', 'ban'))"


@query(chain(*_ALL, "judged") + f"SELECT message_id, CASE WHEN {_TAKES} THEN v_action ELSE action END AS final_action, CASE WHEN {_TAKES} THEN v_reason ELSE reason END AS final_reason, CASE WHEN {_TAKES} THEN verdict_confidence ELSE confidence END AS final_confidence FROM judged")
def merged_decision(spark, sf_dir):
    return judged(spark, sf_dir).select("message_id", "final_action", "final_reason", "final_confidence")


@query(chain(*_ALL) + "SELECT message_id, id AS notify_user_id FROM decided, (VALUES (CAST(7 AS BIGINT)), (9)) AS t(id) WHERE action <> 'allow'")
def notify_fanout(spark, sf_dir):
    return gating.fan_out(decisions(spark, sf_dir), SETTINGS).select("message_id", "notify_user_id")


@query(D.with_(*_TEXTS, "verdicts", "said", "learnt") + "SELECT * FROM learnt")
def llm_feedback(spark, sf_dir):
    return learnt(messages(spark, sf_dir), spark, sf_dir)


@query(D.with_("messages", "reputation_events") + """, seen AS (SELECT message_id, count(*) FILTER (update_type <> 'edited_message') OVER (PARTITION BY chat_id, user_id ORDER BY created_at, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM messages WHERE user_id IS NOT NULL)
SELECT m.message_id, list_reduce(list_prepend(50.0::DOUBLE, coalesce(list(e.delta ORDER BY e.ts, e.seq) FILTER (e.seq IS NOT NULL), [])), lambda a, d: greatest(0.0::DOUBLE, least(100.0::DOUBLE, a + d))) AS reputation_score, coalesce(any_value(n), 0) AS messages_seen
FROM messages m LEFT JOIN reputation_events e ON e.chat_id = m.chat_id AND e.user_id = m.user_id AND e.ts < m.created_at LEFT JOIN seen ON seen.message_id = m.message_id GROUP BY m.message_id""")
def context_as_of(spark, sf_dir):
    return state.context_as_of(relation(spark, sf_dir, "messages"), relation(spark, sf_dir, "reputation_events"))


def timed_evidence(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence with its time: what labels and verdicts teach comes with its message, what a vote teaches when it closes."""
    learnt_ = evidence(rows, spark, sf_dir).withColumn("kind", F.lit("up")).withColumn("ts", START + F.floor(F.col("seq") / 4) * 37)
    votes = relation(spark, sf_dir, "votes")
    voted = state.vote_evidence(state.vote_outcome(votes), sessions_of(rows, spark, sf_dir)).withColumn("ts", START + F.floor(F.col("seq") / 2) * 11)
    columns = ["seq", "value", "kind", "fingerprint_type", "weight", "source", "ts"]
    # The numbers of votes stand after all others, so that those of one time are in a known order.
    return learnt_.select(*columns).unionByName(voted.withColumn("seq", F.col("seq") + VOTES_FROM).select(*columns))


#: Added to the numbers of what votes teach.
VOTES_FROM = 1 << 40
_TIMED = f"""steps AS (SELECT seq, value, true AS up, fingerprint_type, weight, source, {START} + seq // 4 * 37 AS ts FROM evidence
  UNION ALL SELECT o.closed_seq * 2 + k + {VOTES_FROM}, CASE k WHEN 0 THEN skeleton_hash ELSE content_hash END AS value, spam_votes >= 3, CASE k WHEN 0 THEN 'skeleton' ELSE 'content' END, 85.0::DOUBLE, 'vote_confirmed', {START} + o.closed_seq * 11
  FROM outcomes o JOIN sessions s ON s.id = o.session_id, (VALUES (0), (1)) AS t(k) WHERE {D.meaningful("CASE k WHEN 0 THEN skeleton_hash ELSE content_hash END")})"""


@query(chain("votes", "vote_sessions", "sessions", "outcomes", "evidence", "keys").rstrip() + f""",
{_TIMED},
lists AS (SELECT k.message_id, k.place, k.value, k.fingerprint_type AS asked, list({{'up': up, 't': s.fingerprint_type, 'x': greatest(0.0::DOUBLE, least(100.0::DOUBLE, s.weight)), 's': s.source}} ORDER BY s.ts, s.seq) AS ups
  FROM keys k JOIN features f ON f.message_id = k.message_id JOIN steps s ON s.value = k.value AND s.ts < f.created_at GROUP BY ALL),
folds AS (SELECT message_id, place, value, asked, list_reduce(list_prepend({{'w': -1.0::DOUBLE, 'n': 0, 't': '', 's': '', 'e': ups[1]}}, list_transform(ups, lambda u: {{'w': 0.0::DOUBLE, 'n': 0, 't': '', 's': '', 'e': u}})),
  lambda a, u: CASE WHEN u.e.up THEN {{'w': greatest(a.w, u.e.x), 'n': a.n, 't': u.e.t, 's': u.e.s, 'e': u.e}}
    WHEN a.w >= 0 THEN {{'w': greatest(0.0::DOUBLE, a.w - 30), 'n': a.n + 1, 't': a.t, 's': CASE WHEN a.n + 1 >= 3 THEN 'disabled_false_positive' ELSE a.s END, 'e': u.e}} ELSE a END) AS f FROM lists)
SELECT message_id, asked AS fp_type, value AS fp_value, f.w AS fp_weight, f.s AS fp_source, CAST(f.n AS BIGINT) AS false_positives FROM folds WHERE f.w >= 0 AND f.t = asked
QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY f.w DESC, place) = 1""")
def fingerprint_as_of(spark, sf_dir):
    rows = written(messages(spark, sf_dir).select(*LOOKUP), "feature-rows")
    taught = written(timed_evidence(rows, spark, sf_dir), "timed-evidence")
    known = lookup.known_values(taught.select("value").distinct())
    keys = lookup.keys_of(known_of(rows, spark, sf_dir), "message_id", lookup.phrase_fields(), "created_at", may_be=known).withColumnRenamed("created_at", "ts")
    found = state.fingerprints_as_of(keys, taught)
    return lookup.heaviest(found, fp_type="fingerprint_type", fp_value="value", fp_weight="weight", fp_source="source", false_positives="false_positives")
