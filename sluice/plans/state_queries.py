"""Folds, listings and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sluice.functions.text import number_text
from sluice.operators import reports, scoring, state
from sluice.operators.previews import previews, raw_title
from sluice.sources.bindings import START, relation
from sluice.sources.shared import written

from . import duck as D
from .decision_queries import _TEXTS, LOOKUP, SETTINGS, chain, evidence, fingerprints, in_context, messages, sessions, strongest_of, taught_rows
from .registry import query


@query(D.with_("votes") + """SELECT session_id, count(*) FILTER (vote = 'spam') AS spam_votes, count(*) FILTER (vote = 'ham') AS ham_votes FROM (
  SELECT session_id, voter_user_id, arg_max(vote, (ts, seq)) AS vote FROM votes WHERE vote IN ('spam', 'ham') GROUP BY ALL) GROUP BY session_id""")
def vote_tally(spark, sf_dir):
    return state.vote_tally(relation(spark, sf_dir, "votes"))


@query(D.with_("votes", "outcomes") + "SELECT session_id, CASE WHEN spam_votes >= 3 THEN 'confirmed_spam' ELSE 'released' END AS outcome, closed_seq, CAST(spam_votes AS BIGINT) AS spam_votes, CAST(ham_votes AS BIGINT) AS ham_votes, CASE WHEN spam_votes >= 3 THEN -35.0::DOUBLE ELSE 8.0::DOUBLE END AS reputation_delta FROM outcomes")
def vote_outcome(spark, sf_dir):
    return state.vote_outcome(relation(spark, sf_dir, "votes"))


#: Who voted what, the last to change first.
RECORDS = """records AS (SELECT session_id, voter_user_id, vote, row_number() OVER (PARTITION BY session_id ORDER BY updated DESC, created DESC) AS place FROM (
  SELECT session_id, voter_user_id, arg_max(vote, (ts, seq)) AS vote, max((ts, seq)) AS updated, min((ts, seq)) AS created FROM (
    SELECT *, lag(vote) OVER (PARTITION BY session_id, voter_user_id ORDER BY ts, seq) AS before FROM votes WHERE vote IN ('spam', 'ham')) WHERE before IS NULL OR before <> vote GROUP BY ALL))"""


@query(D.with_("votes").rstrip() + f",\n{RECORDS}\nSELECT * FROM records WHERE place <= 20")
def recent_votes(spark, sf_dir):
    return reports.vote_records(relation(spark, sf_dir, "votes")).withColumn("place", F.col("place").cast("bigint"))


@query(D.with_("messages") + "SELECT chat_id, user_id, count(*) AS messages_seen, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at FROM messages WHERE update_type <> 'edited_message' GROUP BY ALL")
def user_activity(spark, sf_dir):
    return state.user_activity(relation(spark, sf_dir, "messages"))


@query(D.with_("reputation_events") + "SELECT chat_id, user_id, list_reduce(list_prepend(50.0::DOUBLE, list(delta ORDER BY seq)), lambda a, d: greatest(0.0::DOUBLE, least(100.0::DOUBLE, a + d))) AS reputation_score FROM reputation_events GROUP BY ALL")
def reputation_fold(spark, sf_dir):
    return state.reputation(relation(spark, sf_dir, "reputation_events"))


_HITS = "hits AS (SELECT fp_value AS value, count(*) AS hits FROM strongest GROUP BY 1)"


@query(chain("evidence", "fingerprints", "keys", "strongest").rstrip() + f",\n{_HITS}\nSELECT f.value, coalesce(hits, 0) AS hits, greatest(weight, least(weight + 5 * coalesce(hits, 0), 80.0::DOUBLE)) AS weight FROM fingerprints f LEFT JOIN hits USING (value)")
def hit_weight(spark, sf_dir):
    rows = written(messages(spark, sf_dir).select(*LOOKUP), "feature-rows")
    known = written(fingerprints(rows, spark, sf_dir), "fingerprints")
    hits = strongest_of(rows, spark, sf_dir, known).groupBy(F.col("fp_value").alias("value")).agg(F.count("*").alias("hits"))
    out = known.join(hits, "value", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))
    return out.select("value", "hits", state.hit_weight(F.col("weight"), F.col("hits")).alias("weight"))


@query(chain("evidence", "fingerprints") + "SELECT value, greatest(0.0::DOUBLE, weight - 30 * (n - 1)) AS weight, n >= 3 AS disabled FROM fingerprints")
def fp_penalty(spark, sf_dir):
    known = fingerprints(taught_rows(spark, sf_dir), spark, sf_dir)
    return known.select("value", state.penalised_weight(F.col("weight"), F.col("n") - 1).alias("weight"), (F.col("n") >= 3).alias("disabled"))


def folded(steps: str) -> str:
    """The fold of ordered steps (seq, value, fingerprint_type, up, weight, source), one after another."""
    return f"""lists AS (SELECT value, list({{'up': up, 't': fingerprint_type, 'x': weight, 's': source}} ORDER BY seq) AS ups FROM {steps} GROUP BY value),
folds AS (SELECT value, list_reduce(list_prepend({{'w': -1.0::DOUBLE, 'n': 0, 't': '', 's': '', 'e': ups[1]}}, list_transform(ups, lambda u: {{'w': 0.0::DOUBLE, 'n': 0, 't': '', 's': '', 'e': u}})),
  lambda a, u: CASE WHEN u.e.up THEN {{'w': greatest(a.w, u.e.x), 'n': a.n, 't': u.e.t, 's': u.e.s, 'e': u.e}}
    WHEN a.w >= 0 THEN {{'w': greatest(0.0::DOUBLE, a.w - 30), 'n': a.n + 1, 't': a.t, 's': CASE WHEN a.n + 1 >= 3 THEN 'disabled_false_positive' ELSE a.s END, 'e': u.e}} ELSE a END) AS f FROM lists)
SELECT value, f.t AS fingerprint_type, f.w AS weight, CAST(f.n AS BIGINT) AS false_positives, f.s AS source FROM folds WHERE f.w >= 0"""


@query(D.with_(*_TEXTS, "vote_sessions", "sessions", "votes", "outcomes").rstrip() + f""",
steps AS (SELECT o.closed_seq * 2 + k AS seq, CASE k WHEN 0 THEN skeleton_hash ELSE content_hash END AS value, CASE k WHEN 0 THEN 'skeleton' ELSE 'content' END AS fingerprint_type, spam_votes >= 3 AS up, 85.0::DOUBLE AS weight, 'vote_confirmed' AS source
  FROM outcomes o JOIN sessions s ON s.id = o.session_id, (VALUES (0), (1)) AS t(k)),
telling AS (SELECT * FROM steps WHERE {D.meaningful("value")}),
{folded("telling")}""")
def vote_feedback(spark, sf_dir):
    steps = state.vote_evidence(state.vote_outcome(relation(spark, sf_dir, "votes")), sessions(spark, sf_dir))
    return state.fold_feedback(steps)


#: Ups and downs of a few values in turn, from all events: values that get many false alarms, too.
_FEEDBACK = """SELECT CAST(event_id AS BIGINT) AS seq, concat('v', CAST(event_id % 37 AS STRING)) AS value, CASE WHEN event_type IN ('error', 'purchase') THEN 'up' ELSE 'down' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'content' ELSE 'skeleton' END AS fingerprint_type,
  CAST(event_id % 100 AS DOUBLE) AS weight, concat('s', CAST(event_id % 5 AS STRING)) AS source FROM {events}"""


@query(f"WITH steps AS (SELECT *, kind = 'up' AS up FROM ({_FEEDBACK.format(events='events')})),\n{folded('steps')}")
def feedback_fold(spark, sf_dir):
    return state.fold_feedback(spark.sql(_FEEDBACK, events=relation(spark, sf_dir, "events")))


_SWEEP = START + 20_000


@query(D.with_("vote_sessions") + f"SELECT id, 'expired_released' AS status, expires_at FROM vote_sessions WHERE status = 'open' AND expires_at <= {_SWEEP} ORDER BY expires_at, id LIMIT 100")
def expired_sessions(spark, sf_dir):
    return state.expired(relation(spark, sf_dir, "vote_sessions"), _SWEEP).select("id", "status", "expires_at")


#: Messages that a verdict calls spam.
BANS = "bans AS (SELECT m.chat_id, m.user_id, m.message_id, m.created_at FROM messages m JOIN verdicts v ON v.chat_id = m.chat_id AND v.message_id = m.message_id WHERE v.status = 'ok' AND v.is_spam)"


def bans(spark, sf_dir):
    rows = relation(spark, sf_dir, "messages").join(relation(spark, sf_dir, "verdicts").where("status = 'ok' and is_spam").select("chat_id", "message_id"), ["chat_id", "message_id"])
    return rows.select("chat_id", "user_id", "message_id", "created_at")


@query(D.with_("messages", "vote_sessions", "verdicts").rstrip() + f""",
{BANS},
opened AS (SELECT m.chat_id, m.user_id, m.message_id, s.id, s.original_message_id, row_number() OVER (PARTITION BY m.message_id ORDER BY s.created_at DESC, s.id DESC) AS place
  FROM bans m LEFT JOIN vote_sessions s ON s.chat_id = m.chat_id AND s.suspect_user_id = m.user_id AND s.status = 'open')
SELECT chat_id, user_id, message_id, array_to_string(list_sort(list(id) FILTER (id IS NOT NULL)), ',') AS session_ids,
  array_to_string(list_sort(list_distinct(list_append(coalesce(list(original_message_id) FILTER (original_message_id IS NOT NULL), []), message_id))), ',') AS deleted_ids FROM opened WHERE place <= 50 GROUP BY chat_id, user_id, message_id""")
def ban_cascade(spark, sf_dir):
    found = state.ban_cascade(bans(spark, sf_dir), relation(spark, sf_dir, "vote_sessions"))
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return found.select("chat_id", "user_id", "message_id", F.when(F.size("session_ids") > 0, shown("session_ids")).alias("session_ids"), shown("deleted_ids").alias("deleted_ids"))


@query(D.with_("vote_sessions") + "SELECT suspect_user_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY suspect_user_id ORDER BY created_at DESC, id DESC) AS place FROM vote_sessions) WHERE place <= 50")
def user_sessions(spark, sf_dir):
    rows = reports.newest(relation(spark, sf_dir, "vote_sessions"), ["suspect_user_id"], [F.desc("created_at"), F.desc("id")], 50)
    return rows.select("suspect_user_id", "id", F.col("place").cast("bigint").alias("place"))


@query(D.with_("vote_sessions") + "SELECT id, CASE status WHEN 'open' THEN '投票中' WHEN 'confirmed_spam' THEN '投票结束：确认广告' WHEN 'released' THEN '投票结束：放行' ELSE concat('状态更新：', status) END AS label FROM vote_sessions")
def status_label(spark, sf_dir):
    return relation(spark, sf_dir, "vote_sessions").select("id", reports.status_label(F.col("status")).alias("label"))


@query(chain("evidence", "fingerprints") + "SELECT id, fingerprint_type, value, weight, n AS hit_count FROM fingerprints WHERE weight >= 40 ORDER BY weight DESC, hit_count DESC, id LIMIT 50")
def top_fingerprints(spark, sf_dir):
    known = fingerprints(taught_rows(spark, sf_dir), spark, sf_dir).withColumnRenamed("n", "hit_count")
    return reports.top_fingerprints(known, least=40.0).select("id", "fingerprint_type", "value", "weight", "hit_count")


@query(D.with_("whitelisted_users") + "SELECT user_id, added_at FROM whitelisted_users ORDER BY added_at DESC, user_id")
def whitelist_listing(spark, sf_dir):
    return reports.whitelist(relation(spark, sf_dir, "whitelisted_users")).select("user_id", "added_at")


@query(chain("evidence") + ", everything AS (SELECT value FROM evidence) SELECT value, count(*) AS n FROM everything WHERE " + D.meaningful("value") + " GROUP BY value")
def purge_low_entropy(spark, sf_dir):
    return reports.purge(evidence(taught_rows(spark, sf_dir), spark, sf_dir)).groupBy("value").agg(F.count("*").alias("n"))


@query(D.with_(*_TEXTS, "vote_sessions", "sessions") + f""", asked AS (SELECT {D.digest("'加群日结兼职 一天几百 t.me/abc'")} AS h)
SELECT s.id, s.status, CASE WHEN s.id % 2 = 0 THEN 'ban' END AS action, CASE WHEN s.id % 2 = 0 THEN concat('r', CAST(s.id % 7 AS VARCHAR)) END AS reason FROM sessions s, asked
WHERE s.content_hash = h OR s.skeleton_hash = h ORDER BY s.created_at DESC, s.id DESC LIMIT 50""")
def inspect_fingerprint(spark, sf_dir):
    from sluice.functions.fingerprints import digest

    found = sessions(spark, sf_dir)
    log = found.where("id % 2 = 0").select("chat_id", F.col("original_message_id").alias("message_id"), "id", F.lit("ban").alias("action"), F.concat(F.lit("r"), (F.col("id") % 7).cast("string")).alias("reason"))
    return reports.inspect(digest("加群日结兼职 一天几百 t.me/abc"), found, log)


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s\x{3000}\x{a0}]+', ' ', 'g')) AS title FROM pages")
def page_title(spark, sf_dir):
    return relation(spark, sf_dir, "pages").select("page_id", raw_title(F.col("html")).alias("title"))


#: Pages with made-up meta elements before their own head.
_META = """SELECT page_id, url, concat(CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('<meta property="og:title" content=" The &amp;  page ', CAST(page_id AS STRING), '"><META NAME="Description" CONTENT="two  words"><meta property="og:title" content="second">')
  WHEN 2 THEN '<meta name="twitter:title" content="tw"><meta property="og:description" content="d &lt; e"><meta property="og:site_name" content="site">' WHEN 3 THEN '<meta property="og:title" content="  "><meta property="og:image:alt" content="视频"/>'
  ELSE concat('<meta name="application-name" content="', repeat('app ', 400), '">') END, html) AS html FROM {pages}"""
_TITLE = r"replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s\x{3000}\x{a0}]+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"""WITH pages_ AS ({_META.format(pages='pages')}), fields AS (SELECT page_id, url, html, CASE page_id % 5 WHEN 1 THEN concat('The & page ', CAST(page_id AS VARCHAR)) WHEN 2 THEN 'tw' ELSE {_TITLE} END AS title,
  CASE page_id % 5 WHEN 1 THEN 'two words' WHEN 2 THEN 'd < e' END AS description, CASE page_id % 5 WHEN 2 THEN 'site' WHEN 4 THEN trim(repeat('app ', 400)) END AS site_name, CASE page_id % 5 WHEN 3 THEN '视频' END AS image_alt FROM pages_),
texts AS (SELECT *, left(concat_ws(' ', title, description, site_name, image_alt), 1200) AS text FROM fields)
SELECT page_id, url, url AS final_url, title, description, site_name, image_alt, text, octet_length(encode(html)) > 65536 OR length(text) >= 1200 AS truncated FROM texts""")
def og_parse(spark, sf_dir):
    return previews(spark.sql(_META, pages=relation(spark, sf_dir, "pages"))).select("page_id", "preview.*")


def _asking(spark, sf_dir):
    """What requests about all messages are made of, their texts cut; stored, as links are looked up and sent."""
    rows = scoring.cut(messages(spark, sf_dir)).select("message_id", "chat_id", "user_id", *scoring.LONGEST, "skeleton_hash", "content_hash", "mentions", "punctuation_only", "has_preview", "links", "preview_link")
    return in_context(written(rows, "feature-rows"), spark, sf_dir)


_ASKED = ("task", "raw_text", "clean_text", "skeleton", "skeleton_hash", "content_hash", "sender_reputation", "mention_count", "is_empty_or_punctuation", "has_preview_url")


@query(D.with_(*_TEXTS, "user_reputation", "user_profiles", "previews") + f"""SELECT f.message_id, 'judge_telegram_group_spam' AS task, substring(f.text, 1, 4000) AS raw_text, substring(clean, 1, 4000) AS clean_text, substring(skeleton, 1, 1000) AS skeleton, skeleton_hash, content_hash,
  CAST(coalesce(reputation_score, 50) AS VARCHAR) AS sender_reputation, CAST(mentions AS VARCHAR) AS mention_count, CAST(punctuation_only AS VARCHAR) AS is_empty_or_punctuation, CAST(has_preview AS VARCHAR) AS has_preview_url,
  array_to_string({D.domains('links')}, ' ') AS domains, CAST(len(links) AS INTEGER) AS n_links, links[1].url AS first_url, p.bio, CASE WHEN p.user_id IS NOT NULL THEN concat_ws(' ', nullif(p.first_name, ''), nullif(p.last_name, '')) END AS display_name, g.og_title AS title
  FROM features f LEFT JOIN user_reputation r ON r.chat_id = f.chat_id AND r.user_id = f.user_id LEFT JOIN user_profiles p ON p.user_id = f.user_id LEFT JOIN previews g ON g.url = f.preview_link""")
def llm_payload(spark, sf_dir):
    rows = _asking(spark, sf_dir)
    rows = rows.select("message_id", scoring.request(rows).alias("payload"))
    # Written and read again, so that the JSON itself is what is compared.
    kinds = dict.fromkeys(_ASKED, "string") | {"sender_reputation": "double"}
    asked = F.from_json("payload", "struct<" + ",".join(f"{n}:{k}" for n, k in kinds.items()) + ",link_domains:array<string>,links:array<struct<url:string>>,sender_profile:struct<bio:string,display_name:string>,og_preview:struct<title:string>>")
    rows = rows.withColumn("a", asked)
    return rows.select(
        "message_id", *((number_text(F.col(f"a.{n}")) if kinds[n] == "double" else F.col(f"a.{n}")).alias(n) for n in _ASKED), F.array_join("a.link_domains", " ").alias("domains"), F.size("a.links").alias("n_links"), F.get("a.links", F.lit(0))["url"].alias("first_url"),
        F.col("a.sender_profile.bio").alias("bio"), F.col("a.sender_profile.display_name").alias("display_name"), F.col("a.og_preview.title").alias("title"),
    )


_REPLY = """SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN '```json ' ELSE 'so: ' END, '{{"is_spam": ', CASE toxic WHEN 1 THEN 'true' ELSE 'false' END, ', "confidence": ', CAST(CAST(doc_id % 15 AS DOUBLE) / 10 AS STRING),
  ', "category": "ads", "signal_phrases": ["p', CAST(doc_id AS STRING), '", "  "]}}', CASE WHEN doc_id % 3 = 0 THEN '```' ELSE '' END) AS reply, toxic FROM {labels}"""


@query("SELECT doc_id, toxic = 1 AS is_spam, least(1.0::DOUBLE, CAST(doc_id % 15 AS DOUBLE) / 10) AS confidence, 'ads' AS category, concat('p', CAST(doc_id AS VARCHAR)) AS phrases FROM labels")
def llm_verdict(spark, sf_dir):
    rows = spark.sql(_REPLY, labels=relation(spark, sf_dir, "labels")).withColumn("v", scoring.parse_verdict(F.col("reply")))
    return rows.select("doc_id", "v.is_spam", "v.confidence", "v.category", F.array_join("v.signal_phrases", "|").alias("phrases"))


def by_profile(requests: list[str]) -> list[str | scoring.Failure | None]:
    """A scorer of its own: spam is whose profile leads to another group; a preview's title is the category; no profile, no reply."""
    out = []
    for asked in map(json.loads, requests):
        profile, preview = asked["sender_profile"], asked["og_preview"] or {}
        if profile is None:
            out.append(scoring.Failure("no profile"))
        else:
            out.append(json.dumps({"is_spam": "t.me" in (profile["bio"] or ""), "confidence": 0.9 if profile["last_name"] else 0.6, "category": preview.get("title") or "none"}))
    return out


@query(D.with_(*_TEXTS, "user_profiles", "previews") + """SELECT f.message_id, CASE WHEN p.user_id IS NULL THEN 'failed' ELSE 'ok' END AS status, CASE WHEN p.user_id IS NULL THEN 'no profile' END AS error,
  CASE WHEN p.user_id IS NOT NULL THEN coalesce(contains(p.bio, 't.me'), false) END AS is_spam, CAST(CASE WHEN p.user_id IS NULL THEN NULL WHEN p.last_name <> '' THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence,
  CASE WHEN p.user_id IS NOT NULL THEN coalesce(nullif(g.og_title, ''), 'none') END AS category
  FROM features f LEFT JOIN user_profiles p ON p.user_id = f.user_id LEFT JOIN previews g ON g.url = f.preview_link""")
def scored_by_profile(spark, sf_dir):
    rows = _asking(spark, sf_dir).withColumn("scorer", F.lit(True))
    return scoring.score(rows, by_profile).select("message_id", "status", "error", "is_spam", "confidence", "category")
