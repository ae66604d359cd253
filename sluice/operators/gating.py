"""Which updates are moderated at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.settings import DEFAULT, Settings

#: Fixed value: the account in whose name a channel's posts are forwarded.
SERVICE_ACCOUNT = 777000


def in_scope(self_bot_id: int = 0) -> Column:
    """A group's message by someone else than this bot, no automatic forward of another chat, no command."""
    forwarded = F.col("is_automatic_forward") & (F.col("sender_chat_id").isNull() | (F.col("sender_chat_id") != F.col("chat_id")))
    return (
        F.col("chat_type").isin("group", "supergroup") & ~((F.col("update_type") != "edited_message") & F.coalesce(forwarded, F.lit(False)))
        & F.col("user_id").isNotNull() & (F.col("user_id") != self_bot_id) & ~F.coalesce(F.trim("text").startswith("/"), F.lit(False))
    )


def gate(messages: DataFrame, allowed_chats: DataFrame | None = None, whitelist: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Rows in scope, of allowed chats, not by whitelisted users."""
    rows = messages.where(in_scope(settings.self_bot_id)).where(~F.col("user_id").isin(SERVICE_ACCOUNT, *settings.whitelist_user_ids))
    if settings.require_allowed_chat and allowed_chats is not None:
        listed = F.col("chat_id").isin(*settings.allowed_chat_ids) if settings.allowed_chat_ids else F.lit(False)
        rows = rows.where(listed).unionByName(rows.where(~listed).join(allowed_chats.select("chat_id"), "chat_id", "left_semi"))
    if whitelist is not None:
        rows = rows.join(whitelist.select("user_id"), "user_id", "left_anti")
    return rows


def senders(messages: DataFrame) -> DataFrame:
    """One row for each user that joined, in place of one for the service message, with its text; others as they are.

    Who joined stands in new_chat_members or, where that is empty, as text in
    action_users; what is no number there is passed over.
    """
    none = F.array().cast("array<bigint>")
    joined = F.coalesce("new_chat_members", none)
    if "action_users" in messages.columns:
        named = F.transform(F.coalesce("action_users", F.array().cast("array<string>")), lambda u: u.try_cast("bigint"))
        joined = F.when(F.size(joined) > 0, joined).otherwise(named)
    joined = F.array_distinct(F.array_compact(joined))
    users = F.when(F.size(joined) > 0, joined).otherwise(F.array("user_id"))
    return messages.withColumn("user_id", F.explode(users))


def wants_preview(settings: Settings = DEFAULT) -> Column:
    """Whether a message's preview is worth fetching: the text itself says next to nothing."""
    compact = F.length(F.regexp_replace("clean", r"\s+", ""))
    return F.lit(settings.preview_enabled) & F.col("has_preview") & (F.col("punctuation_only") | (compact <= settings.preview_short_text))


def is_stale(now: Column, settings: Settings = DEFAULT) -> Column:
    """Whether a profile's bio was never fetched, or too long ago."""
    return F.col("bio_fetched_at").isNull() | (now - F.col("bio_fetched_at") >= settings.bio_ttl_seconds)


def fan_out(actions: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """A row for each action to report and each admin to tell."""
    ids = settings.audience
    return actions.where("action <> 'allow'").withColumn("notify_user_id", F.explode(F.array(*map(F.lit, ids)).cast("array<bigint>")))
