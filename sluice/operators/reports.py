"""Admin listings, links and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import fingerprints as P

# What each session status is called.
STATUS_LABELS = {
    "open": "投票中",
    "confirmed_spam": "投票结束：确认广告",
    "released": "投票结束：放行",
    "expired_released": "投票超时：默认放行",
    "admin_banned": "管理员已跳过投票并封禁",
}
OTHER_STATUS = "状态更新："


def message_link(chat: Column, message: Column) -> Column:
    """A message of a supergroup as a link, of another chat as its number."""
    text, number = chat.cast("string"), message.cast("string")
    link = F.concat(F.lit('<a href="https://t.me/c/'), F.substring(text, 5, 30), F.lit("/"), number, F.lit('">'), number, F.lit("</a>"))
    return F.when(text.startswith("-100"), link).otherwise(F.concat(F.lit("<code>"), number, F.lit("</code>")))


def status_label(status: Column) -> Column:
    """What a status is called; an unknown one is named after a prefix."""
    pairs = [F.lit(x) for kv in STATUS_LABELS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[status], F.concat(F.lit(OTHER_STATUS), status))


def escape_html(text: Column) -> Column:
    """With &, < and > as character references."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def percent(share: Column) -> Column:
    """A share as whole hundredths, halves to the even one."""
    return F.concat(F.bround(share * 100).cast("bigint").cast("string"), F.lit("%"))


def yes_no(value: Column) -> Column:
    return F.when(value, "是").when(~value, "否").otherwise("-")


def vote_records(votes: DataFrame, limit: int = 20) -> DataFrame:
    """session_id, voter_user_id, vote, place: who voted what, the last to change first, up to the limit.

    A vote that says the same again changes nothing.
    """
    rows = votes.where(F.col("vote").isin("spam", "ham"))
    before = F.lag("vote").over(Window.partitionBy("session_id", "voter_user_id").orderBy("ts", "seq"))
    rows = rows.withColumn("before", before).where("before is null or before <> vote")
    at = F.struct("ts", "seq")
    last = rows.groupBy("session_id", "voter_user_id").agg(F.max_by("vote", at).alias("vote"), F.max(at).alias("updated"), F.min(at).alias("created"))
    return newest(last, ["session_id"], [F.desc("updated"), F.desc("created")], limit).select("session_id", "voter_user_id", "vote", "place")


# The words of vote states, reports and summaries.
def vote_status(sessions: DataFrame, votes: DataFrame, shown: int = 10) -> DataFrame:
    """session_id, status_text of sessions (id, status, spam_votes, ham_votes): label, status, tally and the newest votes."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "voter_user_id", "vote"))), lambda r: F.concat(
        F.lit("- "), r["voter_user_id"].cast("string"), F.lit(": "), F.when(r["vote"] == "spam", "广告").otherwise("放行")))
    records = vote_records(votes).where(F.col("place") <= shown).groupBy("session_id").agg(F.array_join(lines, "\n").alias("records"))
    rows = sessions.withColumn("session_id", F.col("id")).join(records, "session_id", "left")
    text = F.concat(
        status_label(F.col("status")), F.lit("\n状态："), F.col("status"), F.lit("\n投票：广告 "), F.col("spam_votes").cast("string"), F.lit(" / 放行 "), F.col("ham_votes").cast("string"),
        F.when(F.col("records").isNull(), "\n投票记录：暂无").otherwise(F.concat(F.lit("\n投票记录：\n"), F.col("records"))),
    )
    return rows.select("session_id", text.alias("status_text"))


def scorer_section(outcome: Column) -> Column:
    """What a report says of the scorers' outcome (status, provider_count, error, is_spam, confidence, category, signal_phrases); empty for null."""
    phrases = F.when(F.size(outcome["signal_phrases"]) > 0, F.concat(F.lit("\n信号："), escape_html(F.array_join(F.slice(outcome["signal_phrases"], 1, 8), ", ")))).otherwise("")
    failed = F.concat(F.lit("\nLLM：调用失败（"), outcome["provider_count"].cast("string"), F.lit(" 个 provider） / "), escape_html(F.coalesce(F.nullif(outcome["error"], F.lit("")), F.lit("未知错误"))))
    verdict = F.when(F.coalesce(outcome["is_spam"], F.lit(False)), "广告").otherwise("正常")
    category = escape_html(F.coalesce(F.nullif(outcome["category"], F.lit("")), F.lit("-")))
    ok = F.concat(F.lit("\nLLM："), verdict, F.lit(" / "), category, F.lit(" / "), percent(F.coalesce(outcome["confidence"], F.lit(0.0))), phrases)
    status = outcome["status"]
    return F.coalesce(F.when(status == "disabled", "\nLLM：未配置").when(status == "failed", failed).when(status == "ok", ok), F.lit(""))


def notification_text() -> Column:
    """An action's report for admins.

    Wants the decided feature row with profile and preview (`lookup`), outcome
    (null if no scorer was asked), deleted, banned, action_log_id and
    vote_session_id, each null where there is none.
    """
    text = lambda c: c.cast("string")
    or_dash = lambda c: F.coalesce(F.nullif(escape_html(text(c)), F.lit("")), F.lit("-"))
    code = lambda c: F.concat(F.lit("<code>"), F.coalesce(F.nullif(text(c), F.lit("0")), F.lit("-")), F.lit("</code>"))
    known = F.col("username").isNotNull() | F.col("display_name").isNotNull() | F.col("bio").isNotNull()
    profile = F.when(known, F.concat(
        F.lit("\n用户资料："), escape_html(F.coalesce("display_name", F.lit(""))), F.lit(" @"), or_dash(F.col("username")), F.lit("\nBio："), or_dash(F.col("bio")))).otherwise("")
    preview = F.when(F.col("og_url").isNotNull(), F.concat(F.lit("\nOG："), or_dash(F.col("og_title")), F.lit(" / "), or_dash(F.col("og_description")))).otherwise("")
    urls = F.array_join(F.transform("links", lambda x: x["url"]), ", ")
    return F.concat(
        F.lit("反广告处理记录\n群组：<code>"), text(F.col("chat_id")), F.lit("</code>\n消息："), message_link(F.col("chat_id"), F.col("message_id")), F.lit("\n用户："), code(F.col("user_id")), profile,
        F.lit("\n触发：<code>"), escape_html(F.col("reason")), F.lit("</code>\n处理：<b>"), F.col("action"), F.lit("</b> / "), percent(F.col("confidence")),
        F.lit("\n删除："), yes_no(F.col("deleted")), F.lit(" 封禁："), yes_no(F.col("banned")), F.lit("\n日志："), code(F.col("action_log_id")), F.lit("\n投票会话："), code(F.col("vote_session_id")),
        F.lit("\n链接："), or_dash(urls), preview, scorer_section(F.col("outcome")), F.lit("\n正文：\n<blockquote>"),
        escape_html(F.coalesce(F.nullif(F.substring("text", 1, 800), F.lit("")), F.lit("(empty)"))), F.lit("</blockquote>"),
    )


def live_text(base: Column, status: Column) -> Column:
    """A report with its vote's state below."""
    return F.concat(base, F.lit("\n\n实时状态：\n"), escape_html(status))


def vote_prompt(reason: Column, confidence: Column) -> Column:
    """What a chat is asked about a message."""
    return F.concat(F.lit("疑似广告，请根据被回复的原消息投票确认。\n原因：<code>"), escape_html(reason), F.lit("</code>\n置信度："), percent(confidence))


def expired_text() -> Column:
    """What becomes of the question when nobody decided."""
    return F.concat(F.lit("投票超时：默认放行并标记。\n广告 "), F.col("spam_votes").cast("string"), F.lit(" / 放行 "), F.col("ham_votes").cast("string"))


def ban_summary() -> Column:
    """What a chat is told of a ban (`effects.ban_results` with reason)."""
    user = F.coalesce(F.concat(F.lit("<code>"), F.col("user_id").cast("string"), F.lit("</code>")), F.lit("-"))
    return F.concat(
        F.lit("反广告处理完成\n用户："), user, F.lit("\n处理："), F.when(F.col("banned"), "已封禁").otherwise("封禁失败"), F.lit("\n原因：<code>"), escape_html(F.col("reason")),
        F.lit("</code>\n已清理：广告消息 "), F.size("deleted_original_ids").cast("string"), F.lit(" 条，投票消息 "), F.size("deleted_vote_ids").cast("string"), F.lit(" 条"),
        F.coalesce(F.concat(F.lit("\n错误：<code>"), escape_html(F.col("ban_error")), F.lit("</code>")), F.lit("")),
    )


def notifications_of(sessions: DataFrame, notifications: DataFrame) -> DataFrame:
    """notifications of each session in the order of their ids: session_id, place, id, notify_user_id, message_id, base_text."""
    rows = notifications.join(sessions.select(F.col("id").alias("vote_session_id")), "vote_session_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("vote_session_id").orderBy("id"))
    return rows.select(F.col("vote_session_id").alias("session_id"), place.alias("place"), "id", "notify_user_id", "message_id", "base_text")


def top_fingerprints(fingerprints: DataFrame, kind: str | None = None, least: float = 0.0, limit: int = 50) -> DataFrame:
    """The heaviest, then most hit, then oldest fingerprints."""
    rows = fingerprints.where(F.col("weight") >= least)
    rows = rows.where(F.col("fingerprint_type") == kind) if kind else rows
    return rows.orderBy(F.desc("weight"), F.desc("hit_count"), "id").limit(limit)


def whitelist(users: DataFrame) -> DataFrame:
    """The users whose messages are not moderated, the last added first; a range sort, without a limit."""
    return users.orderBy(F.desc("added_at"), "user_id")


def newest(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """Adds place: 1, 2, ... within each key in the order given, up to the limit."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def inspect(fingerprint: str, sessions: DataFrame, actions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest sessions about a hash, each with the first action on its message: id, status, action, reason."""
    found = sessions.where((F.col("content_hash") == fingerprint) | (F.col("skeleton_hash") == fingerprint)).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    first = actions.groupBy("chat_id", F.col("message_id").alias("original_message_id")).agg(F.min_by(F.struct("action", "reason"), "id").alias("a"))
    return found.join(first, ["chat_id", "original_message_id"], "left").select("id", "status", "a.action", "a.reason")


def purge(fingerprints: DataFrame) -> DataFrame:
    """Without fingerprints of empty or empty-shaped texts."""
    return fingerprints.where(~F.col("value").isin(*P.SENTINELS))
