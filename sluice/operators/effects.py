"""What a decision leaves behind: observations, actions, sessions, notifications and calls on the chat, as rows to append.

Nothing is sent from here: `effects` rows say what a sender is to do, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.functions import links as L
from sluice.settings import DEFAULT, Settings
from sluice.sources.shared import written

from . import reports, state

# Actions that an admin can confirm by callback, and the answers to callbacks.
VERIFY_ACTIONS = ("status", "allow_chat", "deny_chat")
ANSWERS = {
    "broken_vote": "投票数据无效", "broken_verify": "验证数据无效", "unknown_verify": "验证操作无效", "wrong_chat": "验证来源不匹配", "no_manager": "只有群管理员可以确认此操作",
    "broken_ban": "操作数据无效", "no_session": "投票不存在", "no_admin": "只有管理员可以跳过投票封禁", "ended": "投票已经结束", "no_suspect": "没有可封禁的用户",
    "no_right": "Bot 没有封禁权限，或目标不可封禁", "banned": "已封禁",
}
MANAGERS = ("creator", "administrator")


def numbered(rows: DataFrame, name: str, time: str, tie: str, first: int = 1) -> DataFrame:
    """`rows` with consecutive numbers by (time, tie) as `name`.

    Rows are dealt by ranges and sorted there, so no time is too busy for a
    task; a row's number is its place in its range after the sizes of the
    ranges before, and one size for each range is all that meets in one task.
    """
    dealt = rows.repartitionByRange(time, tie).sortWithinPartitions(time, tie).withColumn("_at", F.monotonically_increasing_id())
    # Stored, as ranges must be the same for the sizes and for the rows.
    placed = written(dealt, "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    out = placed.withColumn("_part", part).join(begins, "_part")
    return out.withColumn(name, (F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1) + first).cast("bigint")).drop("_part", "_at", "_begin")


def observations(features: DataFrame) -> DataFrame:
    """Rows of message_observations; a repeated or edited message is observed again."""
    domains = F.to_json(L.link_domains(F.col("links")))
    return features.select("chat_id", "message_id", "user_id", "skeleton_hash", "content_hash", P.simhash_of(F.col("clean")).alias("simhash"), domains.alias("link_domains_json"), "created_at")


def overlaid(under: dict[str, Column], over: dict[str, Column]) -> Column:
    """A JSON object with the fields of both; of one name, that of `over`."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in (under | over).items())))


def snapshot() -> dict[str, Column]:
    """What the log keeps of a message: the text's first 500 characters and its urls."""
    return {"text_snapshot": F.substring("text", 1, 500), "links": F.transform("links", lambda x: x["url"])}


def action_rows(decided: DataFrame, metadata: dict[str, Column] | None = None, extra: dict[str, Column] | None = None, first: int = 1) -> DataFrame:
    """Rows of action_log with ids: one for each decision, with its metadata overlaid by `extra`."""
    found = overlaid(metadata if metadata is not None else snapshot(), extra or {})
    rows = decided.select("chat_id", "message_id", "user_id", "action", "reason", "confidence", found.alias("metadata_json"), "created_at")
    return numbered(rows, "id", "created_at", "message_id", first)


def session_rows(decided: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows of vote_sessions for the messages put to a vote; the message itself stays."""
    rows = decided.where("action = 'withdraw_vote'")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "chat_id", F.col("message_id").alias("original_message_id"), F.col("user_id").alias("suspect_user_id"), "skeleton_hash", "content_hash", F.lit("open").alias("status"),
        zero.alias("spam_votes"), zero.alias("ham_votes"), "reason", "created_at", (F.col("created_at") + settings.vote_timeout_seconds).alias("expires_at"),
    )


def session_action_rows(sessions: DataFrame, action: str, reason: str, at: int | Column, confidence: float | Column = 0.0, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows of action_log about sessions: a snapshot of their counters, overlaid by `extra`. A session that is not there has none."""
    fields = {"vote_session_id": F.col("id"), **{c: F.col(c) for c in ("vote_message_id", "spam_votes", "ham_votes", "status") if c in sessions.columns}}
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    return sessions.select(
        F.col("id").alias("vote_session_id"), "chat_id", F.col("original_message_id").alias("message_id"), F.col("suspect_user_id").alias("user_id"), value(action).alias("action"),
        value(reason).alias("reason"), value(confidence).cast("double").alias("confidence"), overlaid(fields, extra or {}).alias("metadata_json"), value(at).cast("bigint").alias("created_at"),
    )


def expiry_rows(expired: DataFrame) -> DataFrame:
    """Rows of action_log about sessions that a sweep released; reputation and fingerprints stay as they are."""
    return session_action_rows(expired, "vote_expired_released", "vote_timeout_default_release", F.col("closed_at"), extra={"expires_at": F.col("expires_at")})


def vote_callbacks(callbacks: DataFrame) -> DataFrame:
    """session_id and vote of callbacks `vote:<id>:<spam or ham>`; others are dropped."""
    parts = F.split("data", ":", 3)
    rows = callbacks.withColumn("session_id", F.get(parts, F.lit(1)).try_cast("bigint")).withColumn("vote", F.get(parts, F.lit(2)))
    return rows.where((F.get(parts, F.lit(0)) == "vote") & F.col("session_id").isNotNull() & F.col("vote").isin("spam", "ham")).drop("data")


def managers(members: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(chat_id, user_id) of the chats' own admins."""
    return members.where(F.col("status").isin(*MANAGERS)).select("chat_id", "user_id").distinct()


def _managing(rows: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """Adds manages: whether user_id is an admin of chat_id, or of all chats."""
    own = managers(members, settings).withColumn("manages", F.lit(True))
    everywhere = F.col("user_id").isin(*settings.admin_user_ids) if settings.admin_user_ids else F.lit(False)
    return rows.join(own, ["chat_id", "user_id"], "left").withColumn("manages", F.coalesce("manages", F.lit(False)) | everywhere)


def permissions(pairs: DataFrame, members: DataFrame, bot_id: int) -> DataFrame:
    """chat_id, target_user_id, can_delete, can_restrict, target_is_restrictable, refused of (chat_id, target_user_id).

    The bot may what its membership says, a creator everything; creators and
    admins can't be restricted.  Where the bot's or the target's membership is
    unknown, nothing is allowed, and `refused` says why.
    """
    bot = members.where(F.col("user_id") == bot_id).select("chat_id", F.struct(
        ((F.col("status") == "creator") | F.coalesce("can_delete_messages", F.lit(False))).alias("can_delete"),
        ((F.col("status") == "creator") | F.coalesce("can_restrict_members", F.lit(False))).alias("can_restrict")).alias("bot"))
    target = members.select("chat_id", F.col("user_id").alias("target_user_id"), F.col("status").alias("target_status"))
    rows = pairs.select("chat_id", "target_user_id").distinct().join(bot, "chat_id", "left").join(target, ["chat_id", "target_user_id"], "left")
    known = F.col("bot").isNotNull() & (F.col("target_user_id").isNull() | F.col("target_status").isNotNull())
    of = lambda c: F.when(known, c).otherwise(F.lit(False))
    free = F.col("target_user_id").isNull() | ~F.col("target_status").isin(*MANAGERS)
    return rows.select(
        "chat_id", "target_user_id", of(F.col("bot.can_delete")).alias("can_delete"), of(F.col("bot.can_restrict")).alias("can_restrict"), of(free).alias("target_is_restrictable"),
        F.when(~known, F.lit("member not found")).otherwise(F.lit("")).alias("refused"),
    )


def admin_verifications(callbacks: DataFrame, members: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Callbacks `admin_verify:<action>:<chat>` with verified, chat_id, verified_action and answer (null if verified).

    Wants id, user_id, data and message_chat_id, the chat whose button was
    pressed (null: unknown).  The data must have a chat, an action that exists
    and the same chat as the message, and the user must manage it.
    """
    parts = F.split("data", ":", 3)
    rows = callbacks.where(F.startswith("data", F.lit("admin_verify:")))
    rows = rows.withColumn("verified_action", F.get(parts, F.lit(1))).withColumn("chat_id", F.get(parts, F.lit(2)).try_cast("bigint"))
    rows = _managing(rows, members, settings)
    answer = (
        F.when(F.col("chat_id").isNull(), ANSWERS["broken_verify"]).when(~F.col("verified_action").isin(*VERIFY_ACTIONS), ANSWERS["unknown_verify"])
        .when(F.col("message_chat_id") != F.col("chat_id"), ANSWERS["wrong_chat"]).when(~F.col("manages"), ANSWERS["no_manager"])
    )
    rows = rows.withColumn("answer", answer).withColumn("verified", F.col("answer").isNull())
    return rows.select("id", "user_id", "chat_id", "verified_action", "verified", "answer")


def chat_events(verified: DataFrame) -> DataFrame:
    """Events for `state.latest` on allowed_chats from confirmed callbacks: chat_id, added_by_user_id, id, gone."""
    rows = verified.where(F.col("verified") & F.col("verified_action").isin("allow_chat", "deny_chat"))
    return rows.select("chat_id", F.col("user_id").alias("added_by_user_id"), "id", (F.col("verified_action") == "deny_chat").alias("gone"))


def admin_bans(callbacks: DataFrame, sessions: DataFrame, members: DataFrame, bot_id: int, settings: Settings = DEFAULT) -> DataFrame:
    """Callbacks `admin_ban:<session>` with session_id, chat_id, suspect_user_id, banned and answer.

    The first that may and can ends all of the suspect's open votes in the
    chat, so later ones find them ended.  Wants id (its order), user_id, data.
    reputation_delta is what a ban takes from the suspect, null without one.
    """
    found = sessions.select(F.col("id").alias("session_id"), "chat_id", "suspect_user_id", "status")
    rows = callbacks.where(F.startswith("data", F.lit("admin_ban:"))).withColumn("session_id", F.expr("substring(data, 11)").try_cast("bigint")).join(found, "session_id", "left")
    fails = (
        F.when(F.col("session_id").isNull(), ANSWERS["broken_ban"]).when(F.col("status").isNull(), ANSWERS["no_session"]).when(~F.col("manages"), ANSWERS["no_admin"])
        .when(F.col("status") != "open", ANSWERS["ended"]).when(F.col("suspect_user_id").isNull(), ANSWERS["no_suspect"])
    )
    # Callbacks on no session, or on one without a suspect, have no key to meet by, and only need to be answered.
    about = rows.where("suspect_user_id IS NOT NULL")
    nobody = _managing(rows.where("chat_id IS NOT NULL AND suspect_user_id IS NULL"), members, settings).withColumn("fails", fails)
    nowhere = rows.where("chat_id IS NULL AND suspect_user_id IS NULL").withColumn("manages", F.lit(False)).withColumn("fails", fails)
    allowed = permissions(about.select("chat_id", F.col("suspect_user_id").alias("target_user_id")), members, bot_id)
    able = allowed.where(F.col("can_restrict") & F.col("target_is_restrictable")).select("chat_id", F.col("target_user_id").alias("suspect_user_id"), F.lit(True).alias("able"))
    about = _managing(about, members, settings).join(able, ["chat_id", "suspect_user_id"], "left")
    about = about.withColumn("fails", F.coalesce(fails, F.when(F.col("able").isNull(), ANSWERS["no_right"])))
    # The first is an aggregate, partial before its shuffle, however often one suspect is asked about.
    first = about.where("fails IS NULL").groupBy("chat_id", "suspect_user_id").agg(F.min("id").alias("first"))
    about = about.join(first, ["chat_id", "suspect_user_id"], "left").withColumn("banned", F.coalesce(F.col("id") == F.col("first"), F.lit(False)))
    late = F.when(F.col("manages") & (F.col("status") == "open") & (F.col("first") < F.col("id")), ANSWERS["ended"])
    answered = about.withColumn("answer", F.coalesce(F.when(F.col("banned"), ANSWERS["banned"]), late, "fails"))
    others = nobody.unionByName(nowhere).withColumn("banned", F.lit(False)).withColumn("answer", F.col("fails"))
    columns = ["id", "user_id", "session_id", "chat_id", "suspect_user_id", "banned", "answer"]
    every = answered.select(*columns).unionByName(others.select(*columns))
    return every.withColumn("reputation_delta", F.when(F.col("banned"), -settings.spam_penalty))


def ban_events(bans: DataFrame) -> DataFrame:
    """Events for `state.reputation` from `admin_bans`: (seq, chat_id, user_id, delta) of each suspect that was banned, in the callbacks' order."""
    return bans.where("banned").select(F.col("id").alias("seq"), "chat_id", F.col("suspect_user_id").alias("user_id"), F.col("reputation_delta").alias("delta"))


def ban_results(bans: DataFrame, sessions: DataFrame, allowed: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Of every ban (chat_id, user_id, message_id: null where an admin or a vote bans) what comes of it, as far as `allowed` (`permissions`) goes:

    session_ids closed, deleted_original_ids, deleted_vote_ids, delete_errors
    (message_id and error of what can't be deleted), deleted (the message
    itself), deleted_count, banned and ban_error.
    """
    extra = sessions.columns
    votes = F.col("vote_message_id") if "vote_message_id" in extra else F.lit(None).cast("bigint")
    opened = sessions.where("status = 'open' and suspect_user_id is not null").withColumn("vote_message_id", votes)
    newest = Window.partitionBy("chat_id", "suspect_user_id").orderBy(F.desc("created_at"), F.desc("id"))
    known = opened.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= settings.max_sessions).groupBy("chat_id", F.col("suspect_user_id").alias("user_id")).agg(
        F.array_sort(F.collect_list("id")).alias("session_ids"), F.collect_set("original_message_id").alias("originals"), F.array_sort(F.collect_set("vote_message_id")).alias("votes"))
    may = allowed.withColumnRenamed("target_user_id", "user_id")
    rows = bans.select("chat_id", "user_id", "message_id").join(known, ["chat_id", "user_id"], "left").join(may, ["chat_id", "user_id"], "left")
    none = F.array().cast("array<bigint>")
    originals = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("originals", none), F.array("message_id")))))
    deletes, bans_ = F.coalesce("can_delete", F.lit(False)), F.coalesce(F.col("can_restrict") & F.col("target_is_restrictable"), F.lit(False)) & F.col("user_id").isNotNull()
    why = lambda default: F.coalesce(F.nullif("refused", F.lit("")), F.lit(default))
    rows = rows.withColumns({"originals": originals, "votes": F.coalesce("votes", none), "session_ids": F.coalesce("session_ids", none)})
    errors = F.transform(F.concat("originals", "votes"), lambda m: F.struct(m.alias("message_id"), why("missing_delete_permission").alias("error")))
    gone = lambda c: F.when(deletes, F.col(c)).otherwise(none)
    return rows.select(
        "chat_id", "user_id", "message_id", "session_ids", gone("originals").alias("deleted_original_ids"), gone("votes").alias("deleted_vote_ids"),
        F.when(~deletes, errors).otherwise(F.slice(errors, 1, 0)).alias("delete_errors"), (deletes & F.col("message_id").isNotNull()).alias("deleted"),
        F.when(deletes, F.size("originals") + F.size("votes")).otherwise(0).cast("bigint").alias("deleted_count"), bans_.alias("banned"),
        F.when(~bans_, why("missing_restrict_permission")).alias("ban_error"),
    )


def cascade_actions(results: DataFrame, sessions: DataFrame, action: str, status: str, at: int | Column) -> DataFrame:
    """Rows of action_log for each session that bans close: its snapshot after closing, overlaid by what came of the ban.

    `results` are `ban_results` with reason and confidence; of several bans
    that close a session, the one with the least message counts.
    """
    first = F.min_by(F.struct("reason", "confidence", "banned", "deleted_count", "session_ids"), F.coalesce("message_id", F.lit(-1).cast("bigint"))).alias("ban")
    closed = results.select("*", F.explode("session_ids").alias("id")).groupBy("id").agg(first)
    rows = sessions.join(closed, "id").withColumn("status", F.lit(status))
    extra = {"related_vote_session_ids": F.col("ban.session_ids"), "banned": F.col("ban.banned"), "deleted_count": F.col("ban.deleted_count")}
    return session_action_rows(rows, action, F.col("ban.reason"), at, F.col("ban.confidence"), extra)


def cascade_evidence(results: DataFrame, sessions: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Evidence for `state.fold_feedback` from the sessions that bans close: both hashes of each, skeletons first, as a confirmed vote gives."""
    closed = results.select(F.explode("session_ids").alias("session_id")).distinct()
    outcomes = closed.select("session_id", F.lit("confirmed_spam").alias("outcome"), F.col("session_id").alias("closed_seq"))
    return state.vote_evidence(outcomes, sessions, settings)


def notification_rows(reported: DataFrame, settings: Settings = DEFAULT, first: int = 1) -> DataFrame:
    """Rows of admin_notifications with ids: for each report that is no allow and each admin.

    Wants action, vote_session_id, action_log_id, base_text and created_at.
    message_id, which a sender knows once it has sent, is null.
    """
    from .gating import fan_out

    rows = fan_out(reported, settings).select("vote_session_id", "action_log_id", "notify_user_id", F.lit(None).cast("bigint").alias("message_id"), "base_text", "created_at", F.col("created_at").alias("updated_at"))
    return numbered(rows.withColumn("_tie", F.struct("action_log_id", "notify_user_id")), "id", "created_at", "_tie", first).drop("_tie")


def effects(results: DataFrame, expired: DataFrame, notifications: DataFrame, at: Column | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """What a sender is to do, a row for each call: kind, chat_id, message_id, user_id, text, due_at.

    From `ban_results` with created_at: delete messages, ban users, post a
    summary, and delete that later.  From expired sessions: edit the vote's
    message.  From notifications: send them.
    """
    none = F.lit(None)
    columns = lambda kind, chat, message, user, text, due: [F.lit(kind).alias("kind"), chat.cast("bigint").alias("chat_id"), message.cast("bigint").alias("message_id"), user.cast("bigint").alias("user_id"), text.cast("string").alias("text"), due.cast("bigint").alias("due_at")]
    chat, user, now = F.col("chat_id"), F.col("user_id"), F.col("created_at")
    gone = results.select("chat_id", "created_at", F.explode(F.array_distinct(F.concat("deleted_original_ids", "deleted_vote_ids"))).alias("m"))
    parts = [
        gone.select(*columns("delete", chat, F.col("m"), none, none, now)).distinct(),
        results.where("banned").select(*columns("ban", chat, none, user, none, now)),
        results.select(*columns("summary", chat, F.col("message_id"), user, reports.ban_summary(), now)),
        results.select(*columns("delete_summary", chat, F.col("message_id"), user, none, now + settings.summary_seconds)),
        expired.where("vote_message_id is not null").select(*columns("edit_vote", chat, F.col("vote_message_id"), none, reports.expired_text(), F.col("closed_at"))),
        notifications.select(*columns("notify", F.col("notify_user_id"), none, F.col("notify_user_id"), F.col("base_text"), now)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def is_anonymous_admin() -> Column:
    """A message in a group in the group's own name."""
    return F.coalesce(F.col("sender_chat_id") == F.col("chat_id"), F.lit(False)) & F.col("chat_type").isin("group", "supergroup")


def parse_chat_id(text: Column) -> Column:
    """A chat's number from a command's words; null if it is none."""
    return F.trim(text).try_cast("bigint")


def group_status(allowed: Column, settings: Settings = DEFAULT) -> Column:
    """What the status command says of a chat."""
    # The lines' beginnings.
    return F.concat(F.lit("群组：<code>"), F.col("chat_id").cast("string"), F.lit("</code>\n允许使用："), reports.yes_no(allowed), F.lit("\n需要 allow："), reports.yes_no(F.lit(settings.require_allowed_chat)))
