"""The ordered cascade of local rules, and what an outside verdict makes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.functions import links as L
from sluice.functions import text as T
from sluice.settings import DEFAULT, Settings

ACTIONS = ("allow", "review", "withdraw_vote", "ban")


def _decision(action: str, reason: Column | str, confidence: Column | float, scorer: bool) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    confidence = F.lit(float(confidence)) if isinstance(confidence, float | int) else confidence
    return F.struct(F.lit(action).alias("action"), reason.alias("reason"), confidence.alias("confidence"), F.lit(scorer).alias("scorer"))


def decide(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds action, reason, confidence and scorer (whether to ask for an outside verdict).

    Wants the feature row with reputation_score, fp_type, fp_value, fp_weight,
    bio, og_text (all of a preview's texts), session_ids and prior_senders;
    all but the features may be null.  The first rule that holds decides.
    """
    s = settings
    trusted = F.col("reputation_score") >= s.high_reputation
    low = F.when(F.col("reputation_score") <= s.low_reputation, "_low_reputation").otherwise("")
    weight = F.when(~F.col("fp_value").isin(*P.SENTINELS), F.col("fp_weight"))
    shape = (F.col("skeleton_hash") != P.EMPTY_HASH) & ~P.low_shape(rows)
    has_links = F.size("links") > 0
    share = weight / 100
    found = (
        F.when(~trusted & (F.size(F.coalesce("session_ids", F.array().cast("array<bigint>"))) > 0), _decision("ban", "repeated_open_vote_message_same_user", 0.97, False))
        .when(has_links & ~trusted & shape & (F.coalesce("prior_senders", F.lit(0)) + 1 >= s.repeat_min_senders), _decision("ban", "repeated_skeleton_across_senders", 0.97, False))
        .when((weight >= s.ban_weight) & (F.col("fp_type") == "content") & ~trusted, _decision("ban", F.concat(F.lit("known_high_weight_fingerprint"), low), 0.95, False))
        .when(L.is_spam_bio(F.col("bio")), _decision("ban", "spam_profile_bio", 0.96, False))
        .when((F.col("clean") != "") & F.col("carrier") & F.col("strong"), _decision("ban", "hard_spam_message", 0.96, False))
        .when(F.col("has_preview") & F.coalesce(L.has_strong_token(T.normalize(F.col("og_text"))), F.lit(False)), _decision("ban", "hard_spam_link_preview", 0.96, False))
        .when(weight >= s.ban_weight, _decision("withdraw_vote", "known_high_weight_fingerprint_generalized", F.least(F.lit(0.90), share), True))
        .when(weight >= s.review_weight, _decision("withdraw_vote", "known_fingerprint", F.least(F.lit(0.90), share), True))
        .when(weight.isNotNull(), _decision("review", "weak_fingerprint_needs_llm", F.least(F.lit(0.55), share), True))
        .when(F.col("punctuation_only") & F.col("has_preview"), _decision("withdraw_vote", "empty_or_punctuation_with_link_preview", s.punctuation_confidence, True))
        .when(has_links, _decision("review", "link_message_needs_llm", 0.45, True))
        .otherwise(_decision("review", "unmatched_message_needs_llm", 0.0, True))
    )
    return rows.withColumn("_found", found).select("*", "_found.*").drop("_found")


def verdict_decision(settings: Settings = DEFAULT) -> Column:
    """(action, reason, confidence) from is_spam, confidence and reputation_score of a verdict; null without one."""
    s = settings
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("verdict_confidence")))
    low = F.when(F.col("reputation_score") <= s.low_reputation, "_low_reputation").otherwise("")
    of = lambda action, reason: F.struct(F.lit(action).alias("action"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), c.alias("confidence"))
    return F.when(F.col("is_spam").isNotNull() & (F.col("status") == "ok"), F.when(~F.col("is_spam"), of("allow", "llm_not_spam"))
        .when((c >= s.scorer_ban) & (F.col("reputation_score") < s.high_reputation), of("ban", F.concat(F.lit("llm_spam_high_confidence"), low)))
        .when(c >= s.scorer_review, of("withdraw_vote", "llm_spam")).otherwise(of("review", "llm_low_confidence")))


def merge(decided: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds final_action, final_reason and final_confidence: the verdict's where the local one is allow or review, or
    where the verdict asks for a vote or a ban; else the local one.  Verdicts count only where they were asked for."""
    verdict = F.when(F.col("scorer"), verdict_decision(settings))
    rows = decided.withColumn("_v", verdict)
    takes = F.col("_v").isNotNull() & (F.col("action").isin("allow", "review") | F.col("_v.action").isin("withdraw_vote", "ban"))
    for c in ("action", "reason", "confidence"):
        rows = rows.withColumn(f"final_{c}", F.when(takes, F.col(f"_v.{c}")).otherwise(F.col(c)))
    return rows.drop("_v")
