"""Rows that decisions append, callbacks on them, and what admins are told."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import effects, gating, reports, scoring, state
from sluice.operators.outbox import Outbox
from sluice.operators.previews import PreviewCache, answered_by
from sluice.sources.bindings import BOT, START, relation
from sluice.sources.shared import shared_dir, written

from . import duck as D
from .decision_queries import _ALL, _TEXTS, EVIDENCE, SETTINGS, chain, decisions, fingerprints, judged, messages, sessions
from .registry import query
from .state_queries import BANS, RECORDS, bans
from .text_queries import SIMHASHES

_NOW = START + 20_000
_MANAGES = f"(user_id IN ({', '.join(map(str, SETTINGS.admin_user_ids))}) OR EXISTS (SELECT 1 FROM members b WHERE b.chat_id = {{chat}} AND b.user_id = c.user_id AND b.status IN ('creator', 'administrator')))"
_JOINED = "array_to_string(list_sort({x}), ',')"


def _text(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), ",")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote sessions with counters at rest."""
    return relation(spark, sf_dir, "vote_sessions").withColumns({"spam_votes": F.lit(0).cast("bigint"), "ham_votes": F.lit(0).cast("bigint")})


@query(D.with_(*_TEXTS).rstrip() + SIMHASHES + f"SELECT chat_id, message_id, user_id, skeleton_hash, content_hash, s.simhash, concat('[', array_to_string(list_transform({D.domains('links')}, lambda d: concat('\"', d, '\"')), ','), ']') AS link_domains_json, created_at FROM features JOIN simhashes s USING (message_id)")
def observations(spark, sf_dir):
    return effects.observations(messages(spark, sf_dir))


@query(chain(*_ALL) + "SELECT chat_id, message_id AS original_message_id, user_id AS suspect_user_id, skeleton_hash, content_hash, 'open' AS status, 0 AS spam_votes, 0 AS ham_votes, reason, created_at, created_at + 1800 AS expires_at FROM decided WHERE action = 'withdraw_vote'")
def vote_session_rows(spark, sf_dir):
    return effects.session_rows(decisions(spark, sf_dir, "skeleton_hash", "content_hash"))


@query(chain(*_ALL) + """SELECT row_number() OVER (ORDER BY created_at, message_id) AS id, message_id, chat_id, user_id, action, reason, confidence, created_at, substring(text, 1, 500) AS text_snapshot,
  coalesce(links[1].url, '-') AS first_url, CASE WHEN action = 'withdraw_vote' THEN 'false' ELSE '-' END AS deleted FROM decided""")
def action_log(spark, sf_dir):
    deleted = F.when(F.col("action") == "withdraw_vote", False)
    rows = effects.action_rows(decisions(spark, sf_dir, "text", "links"), extra={"deleted": deleted})
    of = lambda path: F.coalesce(F.get_json_object("metadata_json", path), F.lit("-"))
    return rows.select("id", "message_id", "chat_id", "user_id", "action", "reason", "confidence", "created_at", of("$.text_snapshot").alias("text_snapshot"), of("$.links[0]").alias("first_url"), of("$.deleted").alias("deleted"))


_PARTS = "(SELECT *, split_part(data, ':', 1) AS what, split_part(data, ':', 2) AS a, split_part(data, ':', 3) AS b FROM callbacks) c"


@query(D.with_("callbacks") + "SELECT id, user_id, TRY_CAST(split_part(data, ':', 2) AS BIGINT) AS session_id, split_part(data, ':', 3) AS vote FROM callbacks WHERE regexp_full_match(data, 'vote:[0-9]+:(spam|ham)')")
def vote_callbacks(spark, sf_dir):
    return effects.vote_callbacks(relation(spark, sf_dir, "callbacks")).select("id", "user_id", "session_id", "vote")


@query(D.with_("callbacks", "members") + f"""SELECT id, user_id, chat_id, a AS verified_action, answer IS NULL AS verified, answer FROM (SELECT *, CASE WHEN chat_id IS NULL THEN '验证数据无效' WHEN a NOT IN ('status', 'allow_chat', 'deny_chat') THEN '验证操作无效'
  WHEN message_chat_id <> chat_id THEN '验证来源不匹配' WHEN NOT {_MANAGES.format(chat='c.chat_id')} THEN '只有群管理员可以确认此操作' END AS answer FROM (SELECT *, TRY_CAST(b AS BIGINT) AS chat_id FROM {_PARTS}) c WHERE what = 'admin_verify')""")
def admin_verify(spark, sf_dir):
    return effects.admin_verifications(relation(spark, sf_dir, "callbacks"), relation(spark, sf_dir, "members"), SETTINGS)


@query(D.with_("callbacks", "members") + f"""SELECT chat_id, arg_max(user_id, id) AS added_by_user_id, max(id) AS id FROM (SELECT *, TRY_CAST(b AS BIGINT) AS chat_id FROM {_PARTS}) c
  WHERE what = 'admin_verify' AND a IN ('allow_chat', 'deny_chat') AND message_chat_id = chat_id AND {_MANAGES.format(chat='c.chat_id')} GROUP BY chat_id HAVING arg_max(a, id) = 'allow_chat'""")
def verified_chats(spark, sf_dir):
    verified = effects.admin_verifications(relation(spark, sf_dir, "callbacks"), relation(spark, sf_dir, "members"), SETTINGS)
    return state.latest(effects.chat_events(verified), ["chat_id"], ["id"], "gone")


_RIGHTS = f"""rights AS (SELECT DISTINCT s.chat_id, s.suspect_user_id AS target_user_id, coalesce(b.status IS NOT NULL AND t.status IS NOT NULL AND (b.status = 'creator' OR b.can_delete_messages), false) AS can_delete,
  coalesce(b.status IS NOT NULL AND t.status IS NOT NULL AND (b.status = 'creator' OR b.can_restrict_members), false) AS can_restrict, coalesce(b.status IS NOT NULL AND t.status NOT IN ('creator', 'administrator'), false) AS target_is_restrictable,
  CASE WHEN b.status IS NULL OR t.status IS NULL THEN 'member not found' ELSE '' END AS refused
  FROM (SELECT chat_id, suspect_user_id FROM vote_sessions) s LEFT JOIN members b ON b.chat_id = s.chat_id AND b.user_id = {BOT} LEFT JOIN members t ON t.chat_id = s.chat_id AND t.user_id = s.suspect_user_id)"""


def _rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = relation(spark, sf_dir, "vote_sessions").select("chat_id", F.col("suspect_user_id").alias("target_user_id"))
    return effects.permissions(pairs, relation(spark, sf_dir, "members"), BOT)


@query(D.with_("vote_sessions", "members").rstrip() + f",\n{_RIGHTS}\nSELECT * FROM rights")
def bot_permissions(spark, sf_dir):
    return _rights(spark, sf_dir)


_ADMIN_BANS = f"""asked AS (SELECT c.id, c.user_id, s.session_id, s.chat_id, s.suspect_user_id, CASE WHEN c.session_id IS NULL THEN '操作数据无效' WHEN s.status IS NULL THEN '投票不存在' WHEN NOT {_MANAGES.format(chat='s.chat_id')} THEN '只有管理员可以跳过投票封禁'
    WHEN s.status <> 'open' THEN '投票已经结束' WHEN NOT (r.can_restrict AND r.target_is_restrictable) THEN 'Bot 没有封禁权限，或目标不可封禁' END AS fails, s.status = 'open' AND {_MANAGES.format(chat='s.chat_id')} AS might, c.session_id AS given
  FROM (SELECT *, TRY_CAST(a AS BIGINT) AS session_id FROM {_PARTS} WHERE what = 'admin_ban') c LEFT JOIN (SELECT id AS session_id, chat_id, suspect_user_id, status FROM vote_sessions) s ON s.session_id = c.session_id
  LEFT JOIN rights r ON r.chat_id = s.chat_id AND r.target_user_id = s.suspect_user_id),
firsts AS (SELECT chat_id, suspect_user_id, min(id) AS first FROM asked WHERE fails IS NULL GROUP BY ALL),
admin_bans AS (SELECT a.id, user_id, given AS session_id, a.chat_id, a.suspect_user_id, coalesce(a.id = first, false) AS banned,
  CASE WHEN a.id = first THEN '已封禁' WHEN might AND first < a.id THEN '投票已经结束' ELSE fails END AS answer FROM asked a LEFT JOIN firsts f ON f.chat_id = a.chat_id AND f.suspect_user_id = a.suspect_user_id)"""


@query(D.with_("vote_sessions", "members", "callbacks").rstrip() + f",\n{_RIGHTS},\n{_ADMIN_BANS}\nSELECT *, CASE WHEN banned THEN -35.0::DOUBLE END AS reputation_delta FROM admin_bans")
def admin_bans(spark, sf_dir):
    return effects.admin_bans(relation(spark, sf_dir, "callbacks"), relation(spark, sf_dir, "vote_sessions"), relation(spark, sf_dir, "members"), BOT, SETTINGS)


@query(D.with_("vote_sessions", "members", "callbacks", "reputation_events").rstrip() + f""",
{_RIGHTS},
{_ADMIN_BANS},
changes AS (SELECT seq * 2 AS seq, chat_id, user_id, delta FROM reputation_events UNION ALL SELECT id * 2 + 1, chat_id, suspect_user_id, -35.0::DOUBLE FROM admin_bans WHERE banned)
SELECT chat_id, user_id, list_reduce(list_prepend(50.0::DOUBLE, list(delta ORDER BY seq)), lambda a, d: greatest(0.0::DOUBLE, least(100.0::DOUBLE, a + d))) AS reputation_score FROM changes GROUP BY ALL""")
def reputation_after_bans(spark, sf_dir):
    bans = effects.admin_bans(relation(spark, sf_dir, "callbacks"), relation(spark, sf_dir, "vote_sessions"), relation(spark, sf_dir, "members"), BOT, SETTINGS)
    changes = relation(spark, sf_dir, "reputation_events").select((F.col("seq") * 2).alias("seq"), "chat_id", "user_id", "delta")
    return state.reputation(changes.unionByName(effects.ban_events(bans).withColumn("seq", F.col("seq") * 2 + 1)), SETTINGS)


@query(D.with_("vote_sessions", "votes", "members", "callbacks").rstrip() + f""",
{_RIGHTS},
{_ADMIN_BANS},
closes AS (SELECT session_id, 'admin_banned' AS status, {START} + id * 11 AS t FROM admin_bans WHERE banned
  UNION ALL SELECT id, 'expired_released', {START} + CAST(ceil((expires_at - {START}) / 60.0) * 60 AS BIGINT) FROM vote_sessions WHERE status = 'open'),
firsts_ AS (SELECT session_id, arg_min(status, (t, status)) AS status, min(t) AS t FROM closes GROUP BY session_id),
valid AS (SELECT v.* FROM votes v LEFT JOIN firsts_ f USING (session_id) WHERE vote IN ('spam', 'ham') AND (f.t IS NULL OR v.ts < f.t)),
running AS (SELECT *, sum(CAST(vote = 'spam' AS INT) - CAST(before IS NOT NULL AND before = 'spam' AS INT)) OVER w AS spam, sum(CAST(vote = 'ham' AS INT) - CAST(before IS NOT NULL AND before = 'ham' AS INT)) OVER w AS ham
  FROM (SELECT *, lag(vote) OVER (PARTITION BY session_id, voter_user_id ORDER BY ts, seq) AS before FROM valid) WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
hits AS (SELECT session_id, arg_min(spam, (ts, seq)) AS spam, arg_min(ham, (ts, seq)) AS ham, min(ts) AS t FROM running WHERE spam >= 3 OR ham >= 3 GROUP BY session_id),
ends AS (SELECT session_id, arg_max(spam, (ts, seq)) AS spam, arg_max(ham, (ts, seq)) AS ham FROM running GROUP BY session_id)
SELECT s.id AS session_id, CASE WHEN h.spam >= 3 THEN 'confirmed_spam' WHEN h.ham >= 3 THEN 'released' ELSE coalesce(f.status, 'open') END AS status, coalesce(h.t, f.t) AS closed_at,
  CAST(coalesce(h.spam, e.spam, 0) AS BIGINT) AS spam_votes, CAST(coalesce(h.ham, e.ham, 0) AS BIGINT) AS ham_votes
FROM vote_sessions s LEFT JOIN hits h ON h.session_id = s.id LEFT JOIN ends e ON e.session_id = s.id LEFT JOIN firsts_ f ON f.session_id = s.id""")
def closed_sessions(spark, sf_dir):
    every = relation(spark, sf_dir, "vote_sessions")
    banned = effects.admin_bans(relation(spark, sf_dir, "callbacks"), every, relation(spark, sf_dir, "members"), BOT, SETTINGS).where("banned")
    by_admin = banned.select("session_id", F.lit("admin_banned").alias("status"), (F.col("id") * 11 + START).alias("at"))
    by_time = every.where("status = 'open'").select(F.col("id").alias("session_id"), F.lit("expired_released").alias("status"), state.sweep_time(F.col("expires_at"), START, SETTINGS).alias("at"))
    return state.close_sessions(every, relation(spark, sf_dir, "votes"), by_admin.unionByName(by_time), SETTINGS)


@query(D.with_("vote_sessions") + f"""SELECT id AS vote_session_id, chat_id, original_message_id AS message_id, suspect_user_id AS user_id, 'vote_expired_released' AS action, 'vote_timeout_default_release' AS reason, 0.0::DOUBLE AS confidence, {_NOW} AS created_at,
  CAST(expires_at AS VARCHAR) AS expires_at, 'expired_released' AS status, coalesce(CAST(vote_message_id AS VARCHAR), '-') AS vote_message_id FROM vote_sessions WHERE status = 'open' AND expires_at <= {_NOW} ORDER BY expires_at, id LIMIT 100""")
def expiry_log(spark, sf_dir):
    rows = effects.expiry_rows(state.expired(_whole(spark, sf_dir), _NOW, SETTINGS))
    of = lambda name: F.coalesce(F.get_json_object("metadata_json", f"$.{name}"), F.lit("-")).alias(name)
    return rows.select("vote_session_id", "chat_id", "message_id", "user_id", "action", "reason", "confidence", "created_at", of("expires_at"), of("status"), of("vote_message_id"))


_RESULTS = """opened AS (SELECT chat_id, suspect_user_id AS user_id, list(id) AS ids, list_sort(list_distinct(list(original_message_id))) AS originals, list_sort(list_distinct(list(vote_message_id) FILTER (vote_message_id IS NOT NULL))) AS votes FROM (
    SELECT *, row_number() OVER (PARTITION BY chat_id, suspect_user_id ORDER BY created_at DESC, id DESC) AS place FROM vote_sessions WHERE status = 'open') WHERE place <= 50 GROUP BY ALL),
cleared AS (SELECT b.chat_id, b.user_id, b.message_id, b.created_at, coalesce(list_sort(ids), []) AS ids, list_sort(list_distinct(list_append(coalesce(originals, []), b.message_id))) AS originals, coalesce(votes, []) AS votes, coalesce(can_delete, false) AS deletes,
    coalesce(can_restrict AND target_is_restrictable, false) AS banned, refused FROM bans b LEFT JOIN opened o USING (chat_id, user_id) LEFT JOIN rights r ON r.chat_id = b.chat_id AND r.target_user_id = b.user_id),
results AS (SELECT *, CASE WHEN deletes THEN originals ELSE [] END AS gone, CASE WHEN deletes THEN votes ELSE [] END AS gone_votes, CASE WHEN NOT banned THEN coalesce(nullif(refused, ''), 'missing_restrict_permission') END AS ban_error,
    CASE WHEN NOT deletes THEN list_transform(list_concat(originals, votes), lambda m: concat(CAST(m AS VARCHAR), ' ', coalesce(nullif(refused, ''), 'missing_delete_permission'))) ELSE [] END AS errors FROM cleared)"""
_BANNING = D.with_("messages", "vote_sessions", "members", "verdicts").rstrip() + f",\n{BANS},\n{_RIGHTS},\n{_RESULTS}\n"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = effects.ban_results(bans(spark, sf_dir), relation(spark, sf_dir, "vote_sessions"), _rights(spark, sf_dir), SETTINGS)
    return found.withColumns({"reason": F.lit("llm_spam_high_confidence"), "confidence": F.lit(0.9), "created_at": (START + F.col("message_id") * 37)})


@query(_BANNING + f"""SELECT chat_id, user_id, message_id, {_JOINED.format(x='ids')} AS session_ids, {_JOINED.format(x='gone')} AS deleted_original_ids, {_JOINED.format(x='gone_votes')} AS deleted_vote_ids, array_to_string(errors, ';') AS delete_errors, deletes AS deleted,
  CAST(len(gone) + len(gone_votes) AS BIGINT) AS deleted_count, banned, ban_error FROM results""")
def ban_results(spark, sf_dir):
    errors = F.transform("delete_errors", lambda e: F.concat_ws(" ", e["message_id"].cast("string"), e["error"]))
    return _results(spark, sf_dir).select(
        "chat_id", "user_id", "message_id", _text("session_ids").alias("session_ids"), _text("deleted_original_ids").alias("deleted_original_ids"), _text("deleted_vote_ids").alias("deleted_vote_ids"),
        F.array_join(errors, ";").alias("delete_errors"), "deleted", "deleted_count", "banned", "ban_error",
    )


@query(_BANNING.rstrip() + f""",
closed AS (SELECT unnest(ids) AS id, message_id, ids, banned, len(gone) + len(gone_votes) AS n FROM results), first AS (SELECT id, arg_min((ids, banned, n), message_id) AS b FROM closed GROUP BY id)
SELECT s.id AS vote_session_id, s.chat_id, s.original_message_id AS message_id, s.suspect_user_id AS user_id, 'auto_banned_user' AS action, 'llm_spam_high_confidence' AS reason, 0.9::DOUBLE AS confidence, {_NOW} AS created_at, 'confirmed_spam' AS status,
  array_to_string(b[1], ',') AS related, CAST(b[2] AS VARCHAR) AS banned, CAST(b[3] AS VARCHAR) AS deleted_count FROM vote_sessions s JOIN first USING (id)""")
def cascade_actions(spark, sf_dir):
    rows = effects.cascade_actions(_results(spark, sf_dir), relation(spark, sf_dir, "vote_sessions"), "auto_banned_user", "confirmed_spam", _NOW)
    of = lambda path: F.get_json_object("metadata_json", path)
    related = F.regexp_replace(of("$.related_vote_session_ids"), r"[\[\]]", "")
    return rows.select(
        "vote_session_id", "chat_id", "message_id", "user_id", "action", "reason", "confidence", "created_at", of("$.status").alias("status"), related.alias("related"),
        of("$.banned").alias("banned"), of("$.deleted_count").alias("deleted_count"),
    )


@query(D.with_(*_TEXTS, "vote_sessions", "sessions", "members", "verdicts").rstrip() + f""",
{BANS},
{_RIGHTS},
{_RESULTS},
closed AS (SELECT DISTINCT unnest(ids) AS id FROM results),
hashes AS (SELECT id * 2 + k AS seq, CASE k WHEN 0 THEN skeleton_hash ELSE content_hash END AS value, CASE k WHEN 0 THEN 'skeleton' ELSE 'content' END AS kind FROM closed JOIN sessions USING (id), (VALUES (0), (1)) AS t(k))
SELECT value, arg_max(kind, seq) AS fingerprint_type, 85.0::DOUBLE AS weight, CAST(0 AS BIGINT) AS false_positives, 'vote_confirmed' AS source FROM hashes WHERE {D.meaningful('value')} GROUP BY value""")
def cascade_feedback(spark, sf_dir):
    return state.fold_feedback(effects.cascade_evidence(_results(spark, sf_dir), sessions(spark, sf_dir), SETTINGS))


_OUTCOME = """CASE WHEN verdict_status IS NULL THEN '' WHEN verdict_status = 'failed' THEN concat(chr(10), 'LLM：调用失败（2 个 provider） / ', coalesce(error, '未知错误'))
  ELSE concat(chr(10), 'LLM：', CASE WHEN is_spam THEN '广告' ELSE '正常' END, ' / ', replace(coalesce(nullif(category, ''), '-'), '<', '&lt;'), ' / ', CAST(CAST(round_even(verdict_confidence * 100, 0) AS BIGINT) AS VARCHAR), '%',
    CASE WHEN phrases <> '' THEN concat(chr(10), '信号：', replace(array_to_string(list_filter(string_split(phrases, '|'), lambda p: p <> ''), ', '), '&', '&amp;')) ELSE '' END) END"""


#: What a report shows besides the decision.
_SHOWN_OF = ("text", "links", "username", "display_name", "bio", "og_url", "og_title", "og_description")


def _told(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Decisions with what the scorers said."""
    return judged(spark, sf_dir, *more).withColumn("outcome", scoring.outcome(2))


@query(chain(*_ALL, "judged") + f"SELECT message_id, {_OUTCOME} AS section, verdict_status AS status, CASE WHEN verdict_status IS NOT NULL THEN 2 END AS provider_count, error, CASE WHEN verdict_status = 'ok' THEN verdict_confidence END AS confidence FROM judged")
def scorer_outcome(spark, sf_dir):
    rows = _told(spark, sf_dir)
    return rows.select("message_id", reports.scorer_section(F.col("outcome")).alias("section"), "outcome.status", "outcome.provider_count", "outcome.error", "outcome.confidence")


_ESC = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_DASH = "coalesce(nullif(" + _ESC + ", ''), '-')"
_SHOWN = "CAST(message_id AS VARCHAR)"
_NAME = "concat_ws(' ', nullif(first_name, ''), nullif(last_name, ''))"
_NOTIFY = f"""notes AS (SELECT j.*, p.username, {_NAME} AS display_name, g.og_title, g.og_description, g.url AS og_url, row_number() OVER (ORDER BY j.created_at, j.message_id) AS log_id
  FROM judged j LEFT JOIN user_profiles p ON p.user_id = j.user_id LEFT JOIN previews g ON g.url = j.preview_link),
told AS (SELECT message_id, action, created_at, log_id, concat('反广告处理记录', chr(10), '群组：<code>', CAST(chat_id AS VARCHAR), '</code>', chr(10), '消息：<code>', {_SHOWN}, '</code>', chr(10), '用户：<code>', coalesce(nullif(CAST(user_id AS VARCHAR), '0'), '-'), '</code>',
  CASE WHEN username IS NOT NULL THEN concat(chr(10), '用户资料：', {_ESC.format(x='display_name')}, ' @', {_DASH.format(x='username')}, chr(10), 'Bio：', {_DASH.format(x='bio')}) ELSE '' END,
  chr(10), '触发：<code>', reason, '</code>', chr(10), '处理：<b>', action, '</b> / ', CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR), '%', chr(10), '删除：', CASE WHEN action = 'withdraw_vote' THEN '否' ELSE '-' END, ' 封禁：-', chr(10),
  '日志：<code>', CAST(log_id AS VARCHAR), '</code>', chr(10), '投票会话：<code>', CASE WHEN action = 'withdraw_vote' THEN coalesce(nullif({_SHOWN}, '0'), '-') ELSE '-' END, '</code>', chr(10), '链接：', {_DASH.format(x="array_to_string(list_transform(links, lambda l: l.url), ', ')")},
  CASE WHEN og_url IS NOT NULL THEN concat(chr(10), 'OG：', {_DASH.format(x='og_title')}, ' / ', {_DASH.format(x='og_description')}) ELSE '' END, {_OUTCOME}, chr(10), '正文：', chr(10), '<blockquote>', {_ESC.format(x="coalesce(nullif(substring(text, 1, 800), ''), '(empty)')")}, '</blockquote>') AS base_text FROM notes)"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision's report, logged under ids in order of time; a vote's session is known by its message."""
    rows = effects.numbered(_told(spark, sf_dir, *_SHOWN_OF), "action_log_id", "created_at", "message_id")
    voted = F.col("action") == "withdraw_vote"
    rows = rows.withColumns({"vote_session_id": F.when(voted, F.col("message_id")), "deleted": F.when(voted, False), "banned": F.lit(None).cast("boolean")})
    return rows.withColumn("base_text", reports.notification_text())


@query(chain(*_ALL, "judged").rstrip() + f",\n{_NOTIFY}\nSELECT message_id, base_text FROM told")
def notification_text(spark, sf_dir):
    return _reports(spark, sf_dir).select("message_id", "base_text")


@query(chain(*_ALL, "judged").rstrip() + f""",
{_NOTIFY}
SELECT row_number() OVER (ORDER BY created_at, log_id, k) AS id, CASE WHEN action = 'withdraw_vote' THEN message_id END AS vote_session_id, log_id AS action_log_id, k AS notify_user_id, CAST(NULL AS BIGINT) AS message_id, base_text, created_at, created_at AS updated_at
FROM told, (VALUES (CAST(7 AS BIGINT)), (9)) AS t(k) WHERE action <> 'allow'""")
def notification_rows(spark, sf_dir):
    return effects.notification_rows(written(_reports(spark, sf_dir).select("action", "vote_session_id", "action_log_id", "base_text", "created_at"), "reports"), SETTINGS)


_NOTES = """SELECT CAST(event_id AS BIGINT) AS id, CAST(floor(event_id / 20) AS BIGINT) AS vote_session_id, CAST(user_id AS BIGINT) AS notify_user_id, CAST(event_id + 7000000 AS BIGINT) AS message_id, concat('report ', props) AS base_text FROM {events}"""


@query(D.with_("vote_sessions") + f"SELECT vote_session_id AS session_id, row_number() OVER (PARTITION BY vote_session_id ORDER BY id) AS place, id, notify_user_id, message_id, base_text FROM ({_NOTES.format(events='events')}) WHERE vote_session_id IN (SELECT id FROM vote_sessions)")
def session_notifications(spark, sf_dir):
    found = reports.notifications_of(relation(spark, sf_dir, "vote_sessions"), spark.sql(_NOTES, events=relation(spark, sf_dir, "events")))
    return found.withColumn("place", F.col("place").cast("bigint"))


_LABEL = "CASE status WHEN 'open' THEN '投票中' WHEN 'confirmed_spam' THEN '投票结束：确认广告' WHEN 'released' THEN '投票结束：放行' ELSE concat('状态更新：', status) END"


@query(D.with_("vote_sessions", "votes").rstrip() + f""",
{RECORDS},
lines AS (SELECT session_id, string_agg(concat('- ', CAST(voter_user_id AS VARCHAR), ': ', CASE vote WHEN 'spam' THEN '广告' ELSE '放行' END), chr(10) ORDER BY place) AS lines FROM records WHERE place <= 10 GROUP BY session_id),
sums AS (SELECT session_id, count(*) FILTER (vote = 'spam') AS spam, count(*) FILTER (vote = 'ham') AS ham FROM records GROUP BY session_id)
SELECT s.id AS session_id, concat({_LABEL}, chr(10), '状态：', status, chr(10), '投票：广告 ', CAST(coalesce(spam, 0) AS VARCHAR), ' / 放行 ', CAST(coalesce(ham, 0) AS VARCHAR), CASE WHEN lines IS NULL THEN concat(chr(10), '投票记录：暂无') ELSE concat(chr(10), '投票记录：', chr(10), lines) END) AS status_text
FROM vote_sessions s LEFT JOIN lines l ON l.session_id = s.id LEFT JOIN sums u ON u.session_id = s.id""")
def vote_status(spark, sf_dir):
    votes = relation(spark, sf_dir, "votes")
    tally = state.vote_tally(votes).withColumnRenamed("session_id", "id")
    rows = relation(spark, sf_dir, "vote_sessions").join(tally, "id", "left").fillna(0, ["spam_votes", "ham_votes"])
    return reports.vote_status(rows, votes)


@query(_BANNING.rstrip() + f""",
expired AS (SELECT * FROM vote_sessions WHERE status = 'open' AND expires_at <= {_NOW} ORDER BY expires_at, id LIMIT 100),
summaries AS (SELECT chat_id, message_id, user_id, created_at, concat('反广告处理完成', chr(10), '用户：<code>', CAST(user_id AS VARCHAR), '</code>', chr(10), '处理：', CASE WHEN banned THEN '已封禁' ELSE '封禁失败' END, chr(10), '原因：<code>llm_spam_high_confidence</code>', chr(10),
  '已清理：广告消息 ', CAST(len(gone) AS VARCHAR), ' 条，投票消息 ', CAST(len(gone_votes) AS VARCHAR), ' 条', CASE WHEN ban_error IS NOT NULL THEN concat(chr(10), '错误：<code>', ban_error, '</code>') ELSE '' END) AS text FROM results)
SELECT DISTINCT 'delete' AS kind, chat_id, unnest(list_concat(gone, gone_votes)) AS message_id, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS VARCHAR) AS text, created_at AS due_at FROM results
UNION ALL SELECT 'ban', chat_id, NULL, user_id, NULL, created_at FROM results WHERE banned
UNION ALL SELECT 'summary', chat_id, message_id, user_id, text, created_at FROM summaries
UNION ALL SELECT 'delete_summary', chat_id, message_id, user_id, NULL, created_at + 120 FROM summaries
UNION ALL SELECT 'edit_vote', chat_id, vote_message_id, NULL, concat('投票超时：默认放行并标记。', chr(10), '广告 0 / 放行 0'), {_NOW} FROM expired WHERE vote_message_id IS NOT NULL
UNION ALL SELECT 'notify', notify_user_id, NULL, notify_user_id, base_text, {_NOW} FROM ({_NOTES.format(events='events')})""")
def chat_effects(spark, sf_dir):
    notes = spark.sql(_NOTES, events=relation(spark, sf_dir, "events")).withColumn("created_at", F.lit(_NOW))
    return effects.effects(_results(spark, sf_dir), state.expired(_whole(spark, sf_dir), _NOW, SETTINGS), notes, settings=SETTINGS)


@query(D.with_("messages") + "SELECT message_id, sender_chat_id IS NOT NULL AND sender_chat_id = chat_id AND chat_type IN ('group', 'supergroup') AS value FROM messages")
def anonymous_admin(spark, sf_dir):
    return relation(spark, sf_dir, "messages").select("message_id", effects.is_anonymous_admin().alias("value"))


@query("WITH chats AS (SELECT CAST(n_nationkey AS BIGINT) AS chat_id, n_regionkey <> 1 AS allowed FROM nation) SELECT chat_id, concat('群组：<code>', CAST(chat_id AS VARCHAR), '</code>', chr(10), '允许使用：', CASE WHEN allowed THEN '是' ELSE '否' END, chr(10), '需要 allow：是') AS status FROM chats")
def group_status(spark, sf_dir):
    allowed = relation(spark, sf_dir, "allowed_chats").withColumn("allowed", F.lit(True))
    rows = relation(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("chat_id")).join(allowed, "chat_id", "left")
    return rows.select("chat_id", effects.group_status(F.coalesce("allowed", F.lit(False)), SETTINGS).alias("status"))


@query(D.with_("callbacks") + "SELECT id, TRY_CAST(trim(split_part(data, ':', 3)) AS BIGINT) AS chat_id FROM callbacks")
def chat_ids(spark, sf_dir):
    return relation(spark, sf_dir, "callbacks").select("id", effects.parse_chat_id(F.get(F.split("data", ":"), F.lit(2))).alias("chat_id"))


@query(D.with_("user_profiles") + "SELECT user_id, arg_max(username, seq) AS username, arg_max(bio, seq) FILTER (bio IS NOT NULL) AS bio FROM (SELECT user_id % 10 AS user_id, user_id AS seq, username, bio FROM user_profiles) GROUP BY 1")
def profile_upsert(spark, sf_dir):
    rows = relation(spark, sf_dir, "user_profiles").select((F.col("user_id") % 10).alias("user_id"), F.col("user_id").alias("seq"), "username", "bio")
    return state.latest_known(rows, "user_id", "seq", ["username", "bio"])


#: Answers about bios, from orders: of a customer's orders the last one's comment, or none.
_ASKED = "SELECT CAST(o_custkey AS BIGINT) AS user_id, CAST(o_orderkey AS BIGINT) AS seq, CASE WHEN o_orderkey % 3 <> 0 THEN concat('bio ', CAST(o_orderkey AS STRING)) END AS bio FROM {orders}"
_STALE_AT = START + 2_000_000


@query(D.with_("user_profiles") + f"""SELECT p.user_id, CASE WHEN stale AND a.user_id IS NOT NULL THEN a.bio ELSE p.bio END AS bio, CASE WHEN stale THEN {_STALE_AT} ELSE bio_fetched_at END AS bio_fetched_at
  FROM (SELECT *, bio_fetched_at IS NULL OR {_STALE_AT} - bio_fetched_at >= 604800 AS stale FROM user_profiles) p LEFT JOIN (SELECT user_id, max((seq, bio))[2] AS bio FROM ({_ASKED.format(orders='orders')}) GROUP BY 1) a USING (user_id)""")
def bio_refresh(spark, sf_dir):
    answers = state.latest(spark.sql(_ASKED, orders=relation(spark, sf_dir, "orders")), ["user_id"], ["seq"]).select("user_id", "bio")
    return state.refresh_bios(relation(spark, sf_dir, "user_profiles"), answers, _STALE_AT, SETTINGS).select("user_id", "bio", "bio_fetched_at")


@query(D.with_("user_profiles") + f"SELECT p.user_id, CASE WHEN a.user_id IS NOT NULL THEN a.bio ELSE p.bio END AS bio FROM user_profiles p LEFT JOIN (SELECT user_id, max((seq, bio))[2] AS bio FROM ({_ASKED.format(orders='orders')}) GROUP BY 1) a USING (user_id)")
def bio_update(spark, sf_dir):
    changes = spark.sql(_ASKED, orders=relation(spark, sf_dir, "orders"))
    return state.set_value(relation(spark, sf_dir, "user_profiles"), changes, "user_id", "bio").select("user_id", "bio")


@query(D.with_("vote_sessions", "callbacks") + "SELECT s.id, coalesce(c.vote_message_id, s.vote_message_id) AS vote_message_id FROM vote_sessions s LEFT JOIN (SELECT CAST(floor(id / 20) AS BIGINT) AS id, max(id) + 9000000 AS vote_message_id FROM callbacks GROUP BY 1) c USING (id)")
def vote_message_ids(spark, sf_dir):
    changes = relation(spark, sf_dir, "callbacks").select(F.floor(F.col("id") / 20).alias("id"), (F.col("id") + 9000000).alias("vote_message_id"), F.col("id").alias("seq"))
    return state.set_value(relation(spark, sf_dir, "vote_sessions"), changes, "id", "vote_message_id").select("id", "vote_message_id")


@query(D.with_("callbacks") + f"SELECT n.id, coalesce(t.updated_at, {START}) AS updated_at FROM ({_NOTES.format(events='events')}) n LEFT JOIN (SELECT CAST(floor(id / 3) AS BIGINT) AS id, {START} + max(id) AS updated_at FROM callbacks GROUP BY 1) t USING (id)")
def notification_touch(spark, sf_dir):
    notes = spark.sql(_NOTES, events=relation(spark, sf_dir, "events")).withColumn("updated_at", F.lit(START))
    changes = relation(spark, sf_dir, "callbacks").select(F.floor(F.col("id") / 3).alias("id"), (F.col("id") + START).alias("updated_at"), F.col("id").alias("seq"))
    return state.set_value(notes, changes, "id", "updated_at").select("id", "updated_at")


_GONE = "SELECT content_hash AS value FROM features UNION ALL SELECT 'nothing'"


@query(chain("evidence", "fingerprints") + f"SELECT value, id FROM fingerprints WHERE value NOT IN (SELECT value FROM ({_GONE}))")
def fingerprint_delete(spark, sf_dir):
    rows = written(messages(spark, sf_dir).select(*EVIDENCE), "feature-rows")
    return state.delete_rows(fingerprints(rows, spark, sf_dir), rows.select(F.col("content_hash").alias("value")), "value").select("value", "id")


@query(chain("evidence", "fingerprints") + f"SELECT d.value, count(f.value) AS n FROM (SELECT DISTINCT value FROM ({_GONE})) d LEFT JOIN fingerprints f USING (value) GROUP BY 1")
def fingerprint_delete_counts(spark, sf_dir):
    rows = written(messages(spark, sf_dir).select(*EVIDENCE), "feature-rows")
    deletes = rows.select(F.col("content_hash").alias("value")).unionByName(spark.createDataFrame([("nothing",)], "value string"))
    return state.deleted_counts(fingerprints(rows, spark, sf_dir), deletes, "value")


#: Service messages about users that joined, in one list or the other.
_JOINS = """SELECT CAST(o_orderkey AS BIGINT) AS message_id, CAST(o_custkey AS BIGINT) AS user_id, CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_custkey AS STRING), ',', CAST(o_orderkey AS STRING), ',', CAST(o_custkey AS STRING)) ELSE '' END AS members,
  CASE o_orderkey % 4 WHEN 1 THEN concat('x,', CAST(o_orderkey AS STRING), ',12') WHEN 0 THEN '99' ELSE '' END AS users FROM {orders}"""


@query(f"""WITH joins AS ({_JOINS.format(orders='orders')}) SELECT DISTINCT message_id, CAST(unnest(CASE WHEN members <> '' THEN string_split(members, ',') WHEN users <> '' THEN list_filter(string_split(users, ','), lambda u: u <> 'x') ELSE [CAST(user_id AS VARCHAR)] END) AS BIGINT) AS user_id FROM joins""")
def join_senders(spark, sf_dir):
    rows = spark.sql(_JOINS, orders=relation(spark, sf_dir, "orders"))
    lists = rows.withColumns({"new_chat_members": F.when(F.col("members") != "", F.split("members", ",").cast("array<bigint>")), "action_users": F.when(F.col("users") != "", F.split("users", ","))})
    return gating.senders(lists).select("message_id", "user_id")


#: Two scorers' responses to each label's message: one that fails in several ways, and a second.
_REPLIES = """SELECT CAST(doc_id AS BIGINT) AS message_id, place, CASE WHEN place = 1 AND doc_id % 4 = 0 THEN NULL WHEN place = 1 AND doc_id % 4 = 1 THEN 'no json' WHEN doc_id % 9 = 5 THEN ''
  ELSE concat('{{"is_spam": ', CASE WHEN (toxic + place) % 2 = 1 THEN 'true' ELSE 'false' END, ', "confidence": 0.', CAST(place AS STRING), '}}') END AS reply, CASE WHEN place = 1 AND doc_id % 4 = 0 THEN 'timeout' END AS error FROM {labels} CROSS JOIN (SELECT 1 AS place UNION ALL SELECT 2) AS p"""


@query("""WITH good AS (SELECT CAST(doc_id AS BIGINT) AS message_id, CASE WHEN doc_id % 9 = 5 THEN 0 WHEN doc_id % 4 IN (0, 1) THEN 2 ELSE 1 END AS place, toxic FROM labels)
SELECT message_id, CASE WHEN place = 0 THEN 'failed' ELSE 'ok' END AS status, CAST(2 AS BIGINT) AS provider_count, CASE WHEN place = 0 THEN 'empty content' END AS error, CASE WHEN place > 0 THEN (toxic + place) % 2 = 1 END AS is_spam, CASE WHEN place > 0 THEN CAST(place AS DOUBLE) / 10 END AS confidence FROM good""")
def provider_order(spark, sf_dir):
    return scoring.first_verdicts(spark.sql(_REPLIES, labels=relation(spark, sf_dir, "labels"))).select("message_id", "status", "provider_count", "error", "is_spam", "confidence")


_RESPONSES = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('{{"choices": [{{"message": {{"content": "c', CAST(doc_id AS STRING), '"}}}}, {{"text": "second"}}]}}') WHEN 1 THEN '{{"choices": [{{"text": "plain", "message": {{"content": null}}}}]}}' WHEN 2 THEN '{{"choices": []}}'
  WHEN 3 THEN '{{"choices": [{{"message": {{"content": 5}}}}]}}' ELSE 'broken' END AS response FROM {documents}"""


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('c', CAST(doc_id AS VARCHAR)) WHEN 1 THEN 'plain' END AS content FROM documents")
def reply_content(spark, sf_dir):
    rows = spark.sql(_RESPONSES, documents=relation(spark, sf_dir, "documents"))
    return rows.select("doc_id", scoring.reply_content(F.col("response")).alias("content"))


@query("SELECT user_id, event_id FROM (SELECT CAST(user_id AS BIGINT) AS user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) WHERE t <> 'error'")
def chat_allowlist_fold(spark, sf_dir):
    events = relation(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("user_id"), "event_id", (F.col("event_type") == "error").alias("gone"))
    return state.latest(events, ["user_id"], ["event_id"], "gone")


#: Votes as effects that are put into an outbox in two appends, the earlier half first.
_OUT = """SELECT 'vote' AS kind, session_id, voter_user_id, seq, ts FROM votes"""


@query(D.with_("votes") + f"""SELECT seq, row_number() OVER (ORDER BY seq % 2, ts, seq) AS id, {D.digest("concat('vote', chr(31), CAST(session_id AS VARCHAR), chr(31), CAST(voter_user_id AS VARCHAR), chr(31), CAST(seq AS VARCHAR))")} AS effect_key, seq % 3 <> 0 AS delivered FROM ({_OUT})""")
def outbox_effects(spark, sf_dir):
    rows = relation(spark, sf_dir, "votes").select(F.lit("vote").alias("kind"), "session_id", "voter_user_id", "seq", "ts")
    box = Outbox(spark, f"{shared_dir(spark)}/sluice/{spark.sparkContext.applicationId}/outbox-{uuid.uuid4().hex}", ("kind", "session_id", "voter_user_id", "seq"))
    for k in (0, 1):
        box.append(rows.where(F.col("seq") % 2 == k), k, "ts", "seq")
    sent = box.pending(2).where(F.col("seq") % 3 != 0).select("effect_key")
    box.deliver(sent, 0)
    left = box.pending(2, 1).select("effect_key", F.lit(False).alias("delivered"))
    return box.rows(2).join(left, "effect_key", "left").select("seq", "id", "effect_key", F.coalesce("delivered", F.lit(True)).alias("delivered"))


_FIRST = r"(SELECT url, arg_min(html, page_id) AS html FROM pages GROUP BY url)"
_SAID = r"replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s\x{3000}\x{a0}]+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"""SELECT url, {_SAID} AS title, 'ok' AS status, CASE WHEN CAST(length(url) AS BIGINT) % 2 = 0 THEN 1000 ELSE 2000 END AS fetched_at FROM {_FIRST}
  UNION ALL SELECT concat(url, '/gone'), NULL, 'failed', CASE WHEN (length(url) + 5) % 2 = 0 THEN 5000 ELSE 2000 END FROM {_FIRST}""")
def preview_cache(spark, sf_dir):
    """Three runs: half of the links at 1000, all at 2000, and all at 5000, when only those of the first run that failed are due again."""
    pages = relation(spark, sf_dir, "pages").groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    links = pages.select("url").unionByName(pages.select(F.concat("url", F.lit("/gone")).alias("url")))
    cache = PreviewCache(spark, f"{shared_dir(spark)}/sluice/{spark.sparkContext.applicationId}/previews-{uuid.uuid4().hex}", retry_seconds=3500)
    cache.create()
    answers = lambda due: answered_by(due, pages)
    cache.refresh(links.where(F.length("url") % 2 == 0), answers, 0, 1000)
    cache.refresh(links, answers, 1, 2000)
    cache.refresh(links, answers, 2, 5000)
    return cache.before(3).select("url", "preview.title", "status", F.col("fetched_at").cast("int").alias("fetched_at"))
