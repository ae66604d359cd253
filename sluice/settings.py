"""Thresholds that decide results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Production defaults; `from_mapping` reads them by their own names or those in `NAMES`."""

    require_allowed_chat: bool = True
    allowed_chat_ids: tuple[int, ...] = ()
    whitelist_user_ids: tuple[int, ...] = ()
    whitelist_domains: tuple[str, ...] = ()
    admin_user_ids: tuple[int, ...] = ()
    notify_user_ids: tuple[int, ...] = ()
    self_bot_id: int = 0
    vote_min_confirmations: int = 3
    vote_timeout_seconds: int = 1800
    sweep_interval_seconds: int = 60
    high_reputation: float = 80.0
    low_reputation: float = 20.0
    default_reputation: float = 50.0
    spam_penalty: float = 35.0
    ham_reward: float = 8.0
    repeat_window_seconds: int = 300
    repeat_min_senders: int = 3
    review_weight: float = 40.0
    ban_weight: float = 85.0
    scorer_weight: float = 50.0
    vote_weight: float = 85.0
    false_positive_penalty: float = 30.0
    hit_increment: float = 5.0
    hit_cap: float = 80.0
    scorer_review: float = 0.70
    scorer_ban: float = 0.85
    scorer_urls: tuple[str, ...] = ()
    scorer_keys: tuple[str, ...] = ()
    scorer_models: tuple[str, ...] = ()
    scorer_timeout_seconds: float = 8.0
    scorer_temperature: float = 0.0
    scorer_max_tokens: int = 600
    punctuation_confidence: float = 0.82
    preview_enabled: bool = True
    preview_short_text: int = 8
    preview_timeout_seconds: float = 3.0
    preview_max_bytes: int = 65_536
    preview_max_text: int = 1200
    preview_max_redirects: int = 3
    bio_enabled: bool = True
    bio_ttl_seconds: int = 604_800
    max_phrases: int = 256
    max_sessions: int = 50
    expire_batch: int = 100
    summary_seconds: int = 120

    @property
    def audience(self) -> tuple[int, ...]:
        """Who is told of actions: those named for it, else all admins."""
        return self.notify_user_ids or self.admin_user_ids

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> Settings:
        """Booleans are 1, true, yes or on; lists are separated by commas, names of domains in lower case; an empty value
        is none; unknown names are ignored."""
        got: dict[str, object] = {}
        for field in fields(cls):
            names = (field.name, field.name.upper(), *NAMES.get(field.name, ()))
            raw = next((values[n] for n in names if values.get(n)), None)
            if raw is None:
                continue
            raw = raw.strip()
            default, kind = getattr(cls, field.name), str(field.type)
            if isinstance(default, bool):
                got[field.name] = raw.lower() in ("1", "true", "yes", "on")
            elif isinstance(default, tuple):
                parts = [x.strip() for x in raw.split(",") if x.strip()]
                got[field.name] = tuple(map(int, parts)) if "int" in kind else tuple(p.lower() if "domains" in field.name else p for p in parts)
            else:
                got[field.name] = type(default)(raw)
        return cls(**got)


#: What the settings are called in an environment, where that is not their own name in capitals.
NAMES = {
    "whitelist_user_ids": ("WHITELISTED_USER_IDS",), "notify_user_ids": ("ADMIN_NOTIFY_USER_IDS",), "sweep_interval_seconds": ("VOTE_SWEEP_INTERVAL_SECONDS",),
    "high_reputation": ("HIGH_REPUTATION_THRESHOLD",), "low_reputation": ("REPUTATION_BAN_THRESHOLD",), "spam_penalty": ("SPAM_REPUTATION_PENALTY",), "ham_reward": ("HAM_REPUTATION_REWARD",),
    "repeat_min_senders": ("REPEAT_MIN_DISTINCT_SENDERS",), "review_weight": ("FINGERPRINT_REVIEW_WEIGHT",), "ban_weight": ("FINGERPRINT_BAN_WEIGHT",),
    "scorer_weight": ("LLM_FINGERPRINT_INITIAL_WEIGHT",), "vote_weight": ("VOTE_CONFIRMED_FINGERPRINT_WEIGHT",), "false_positive_penalty": ("FINGERPRINT_FALSE_POSITIVE_PENALTY",),
    "hit_increment": ("FINGERPRINT_HIT_WEIGHT_INCREMENT",), "hit_cap": ("FINGERPRINT_HIT_WEIGHT_CAP",), "scorer_review": ("LLM_REVIEW_THRESHOLD",), "scorer_ban": ("LLM_BAN_THRESHOLD",),
    "scorer_urls": ("NEWAPI_BASE_URLS", "NEWAPI_BASE_URL"), "scorer_keys": ("NEWAPI_API_KEYS", "NEWAPI_API_KEY"), "scorer_models": ("NEWAPI_MODELS", "NEWAPI_MODEL"),
    "scorer_timeout_seconds": ("NEWAPI_TIMEOUT_SECONDS",), "scorer_temperature": ("NEWAPI_TEMPERATURE",), "scorer_max_tokens": ("NEWAPI_MAX_TOKENS",),
    "punctuation_confidence": ("PREVIEW_PUNCTUATION_CONFIDENCE",), "preview_enabled": ("OG_FETCH_ENABLED",), "preview_short_text": ("OG_SHORT_TEXT_MAX_CHARS",),
    "preview_timeout_seconds": ("OG_FETCH_TIMEOUT_SECONDS",), "preview_max_bytes": ("OG_FETCH_MAX_BYTES",), "preview_max_text": ("OG_FETCH_MAX_TEXT_CHARS",),
    "preview_max_redirects": ("OG_FETCH_MAX_REDIRECTS",), "bio_enabled": ("PROFILE_BIO_FETCH_ENABLED",), "bio_ttl_seconds": ("PROFILE_BIO_CACHE_TTL_SECONDS",),
}


def read_env(text: str, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """The names and values of an env file; what `environment` has already stays as it is.

    A line is NAME=value, with quotes around the value or without; empty lines,
    comments and lines without = are passed over.
    """
    out = dict(environment or {})
    for line in map(str.strip, text.splitlines()):
        name, found, value = line.partition("=")
        if found and not line.startswith("#"):
            out.setdefault(name.strip(), value.strip().strip('"').strip("'"))
    return out


DEFAULT = Settings()
