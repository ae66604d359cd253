"""Outside verdicts: requests, parsing, and what is learnt from them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.functions import links as L
from sluice.functions import text as T
from sluice.operators.lookup import PREVIEW_FIELDS, PROFILE_FIELDS
from sluice.settings import DEFAULT, Settings

VERDICT = "is_spam boolean, confidence double, category string, skeleton_hash string, signal_phrases array<string>"


def parse_verdict(reply: Column) -> Column:
    """A reply's verdict; null if it is not a JSON object with a boolean is_spam and a number as confidence.

    Code fences around the object, and text before and after it, are ignored.
    Confidence is clamped to 0..1; at most ten phrases of 80 characters stay.
    """
    bare = F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*|\s*```$", "")
    whole = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    v = F.try_parse_json(whole)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    spam, c = F.try_variant_get(v, "$.is_spam", "boolean"), F.try_variant_get(v, "$.confidence", "double")
    named = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(v, path, "string"))
    said = F.coalesce(F.try_variant_get(v, "$.signal_phrases", "array<string>"), F.array().cast("array<string>"))
    phrases = F.slice(F.transform(F.filter(said, lambda p: F.trim(p) != ""), lambda p: F.substring(p, 1, 80)), 1, 10)
    good = (kind("$.is_spam") == "BOOLEAN") & (kind("$.confidence").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"))
    return F.when(good, F.struct(
        spam.alias("is_spam"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).alias("confidence"),
        named("$.category").alias("category"), named("$.skeleton_hash").alias("skeleton_hash"), phrases.alias("signal_phrases"),
    ))


#: Fixed value: what a scorer is asked to do.
TASK = "judge_telegram_group_spam"


#: Characters of a row's texts that a request has.
LONGEST = {"text": 4000, "clean": 4000, "skeleton": 1000}


def cut(rows: DataFrame) -> DataFrame:
    """Feature rows with their texts cut to what a request has of them, so that no more is moved."""
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in LONGEST.items()})


def payload(profile: Column | None = None, preview: Column | None = None) -> Column:
    """The request about a message, as JSON, its long parts cut. profile, preview: structs, null where unknown."""
    none = F.lit(None).cast("string")
    fields = {
        "task": F.lit(TASK), "raw_text": F.substring("text", 1, LONGEST["text"]), "clean_text": F.substring("clean", 1, LONGEST["clean"]), "skeleton": F.substring("skeleton", 1, LONGEST["skeleton"]),
        "skeleton_hash": F.col("skeleton_hash"), "content_hash": F.col("content_hash"), "sender_reputation": F.col("reputation_score"), "mention_count": F.col("mentions"),
        "is_empty_or_punctuation": F.col("punctuation_only"), "has_preview_url": F.col("has_preview"), "link_domains": L.link_domains(F.col("links")),
        "links": F.transform("links", lambda x: F.struct(x["source"].alias("source"), x["domain"].alias("domain"), F.substring(x["url"], 1, 500).alias("url"))),
        "sender_profile": none if profile is None else profile, "og_preview": none if preview is None else preview,
    }
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def known_profile() -> Column:
    """The sender's profile of rows that `lookup.with_profile` made; null where none is known."""
    return F.when(F.col("username").isNotNull(), F.struct("user_id", *PROFILE_FIELDS))


def known_preview() -> Column:
    """The link's preview of rows that `lookup.with_preview` made; null where none is known."""
    return F.when(F.col("og_url").isNotNull(), F.struct(F.col("og_url").alias("url"), *(F.col(f"og_{f}").alias(f) for f in PREVIEW_FIELDS)))


def request(rows: DataFrame) -> Column:
    """The request about a row, with the profile and the preview where the rows have their columns."""
    has = set(rows.columns)
    profile = known_profile() if {"user_id", *PROFILE_FIELDS} <= has else None
    preview = known_preview() if {"og_url", *(f"og_{f}" for f in PREVIEW_FIELDS)} <= has else None
    return payload(profile, preview)


def reply_content(response: Column) -> Column:
    """The reply in a scorer's response: the first choice's message, else its text; null if neither is a text."""
    v = F.try_parse_json(response)
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    return F.coalesce(text("$.choices[0].message.content"), text("$.choices[0].text"))


@dataclass(frozen=True)
class Provider:
    """Where a scorer is, and what it is asked for."""

    base_url: str
    api_key: str
    model: str


#: Fixed value: the model asked for where none is named.
DEFAULT_MODEL = "gpt-5.4"


def base_url(url: str) -> str:
    """A scorer's root, which ends in /v1: of a host, of that root, or of the full path of its completions."""
    url = url.rstrip("/")
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]", url):
        return url
    url = url.removesuffix("/chat/completions")
    return url if url.endswith("/v1") else f"{url}/v1"


def providers(settings: Settings = DEFAULT) -> tuple[Provider, ...]:
    """The scorers in the order they are asked. A single url, key or model serves all; a place that lacks one is left out."""
    lists = (settings.scorer_urls, settings.scorer_keys, settings.scorer_models or (DEFAULT_MODEL,))
    if not all(lists):
        return ()
    places = range(max(map(len, lists)))
    found = ([x[0] if len(x) == 1 else x[i] if i < len(x) else None for x in lists] for i in places)
    return tuple(Provider(base_url(url), key, model) for url, key, model in found if url and key and model)


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def fault(reply: str | None) -> str | None:
    """Why a reply is no verdict; null if it is one. `parse_verdict` reads the same replies."""
    if not reply:
        return "empty content"
    bare = re.sub(r"(?i)^```(?:json)?\s*|\s*```$", "", reply.strip()) if reply.strip().startswith("```") else reply.strip()
    for text in (bare, (re.search(r"(?s)\{.*\}", bare) or [""])[0]):
        try:
            said = json.loads(text, parse_constant=_no_number)
        except ValueError:
            continue
        if not isinstance(said, dict):
            return "parse_error: not an object"
        if not isinstance(said.get("is_spam"), bool):
            return "parse_error: is_spam must be boolean"
        c = said.get("confidence")
        return None if isinstance(c, int | float) and not isinstance(c, bool) else "parse_error: confidence must be numeric"
    return "parse_error: no JSON"


@dataclass(frozen=True)
class Failure:
    """Why a scorer has no reply to a request."""

    reason: str


#: Takes requests, gives a reply, a failure or none for each; an exception fails them all.
Scorer = Callable[[list[str]], Sequence[str | Failure | None]]


def score(rows: DataFrame, scorers: Scorer | Sequence[Scorer], key: str = "message_id") -> DataFrame:
    """key, status, provider_count, error and the verdict on each row that asks for one.

    Scorers are asked in order, a batch at a time, each for what those before
    it gave no verdict on; the last error tells why a row has none.  The filter
    comes before them, so rows decided locally cost nothing.  Without scorers
    the status is disabled.  Requests have the sender's profile and the link's
    preview where `rows` went through `lookup.with_profile` and `with_preview`.
    """
    scorers = [scorers] if callable(scorers) else list(scorers)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            requests = batch.column(1).to_pylist()
            replies: list[str | None] = [None] * len(requests)
            errors: list[str | None] = [None] * len(requests)
            left = list(range(len(requests)))
            for ask in scorers:
                try:
                    got = ask([requests[i] for i in left]) if left else []
                    faults = [r.reason if isinstance(r, Failure) else fault(r) for r in got]
                except Exception as e:  # noqa: BLE001  a scorer's failure is a result
                    got, faults = [None] * len(left), [f"{type(e).__name__}: {e}"] * len(left)
                for i, reply, why in zip(left, got, faults, strict=True):
                    replies[i], errors[i] = (reply, None) if why is None else (None, why)
                left = [i for i in left if replies[i] is None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=["key", "reply", "error"])

    asked = rows.where("scorer").select(F.col(key).alias("key"), request(rows).alias("request"))
    out = asked.mapInArrow(run, f"key {kind}, reply string, error string").withColumn("v", parse_verdict(F.col("reply")))
    status = F.lit("disabled") if not scorers else F.when(F.col("v").isNull(), "failed").otherwise("ok")
    return out.select(F.col("key").alias(key), status.alias("status"), F.lit(len(scorers)).alias("provider_count"), "error", "v.*")


def first_verdicts(replies: DataFrame, key: str = "message_id") -> DataFrame:
    """key, status, provider_count, error and verdict from stored replies (key, place, reply, error): the first place with a
    verdict counts; without one, the last place's error."""
    rows = replies.withColumn("v", parse_verdict(F.col("reply")))
    why = F.coalesce("error", F.when(F.coalesce("reply", F.lit("")) == "", "empty content").otherwise("parse_error"))
    found = rows.groupBy(key).agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("place"))).alias("v"), F.max_by(F.when(F.col("v").isNull(), why), "place").alias("why"), F.count("*").alias("provider_count"))
    return found.select(key, F.when(F.col("v").isNull(), "failed").otherwise("ok").alias("status"), "provider_count", F.when(F.col("v").isNull(), F.col("why")).alias("error"), "v.*")


def outcome(provider_count: Column | int = 1) -> Column:
    """What a decision notes of the scorers: status, provider_count, error, and the verdict where there is one; null where none was asked."""
    ok = F.col("status") == "ok"
    of = lambda c: F.when(ok, F.col(c))
    count = provider_count if isinstance(provider_count, Column) else F.lit(provider_count)
    return F.when(F.col("status").isNotNull(), F.struct(
        F.col("status").alias("status"), count.cast("bigint").alias("provider_count"), F.col("error").alias("error"), of("is_spam").alias("is_spam"),
        of("verdict_confidence").alias("confidence"), of("category").alias("category"), of("signal_phrases").alias("signal_phrases"),
    ))


def spam_evidence(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """message_id, fingerprint_type, value, weight, source to learn from verdicts of spam at the review threshold or above:
    the message's skeleton and the verdict's phrases, each if it says something."""
    sure = (F.col("status") == "ok") & F.col("is_spam") & (F.col("verdict_confidence") >= settings.scorer_review)
    none = F.lit(None).cast("string")
    shape = F.when(~P.low_shape(rows), F.struct(F.col("skeleton_hash").alias("hash"), none.alias("phrase")))
    said = F.transform(F.coalesce("signal_phrases", F.array().cast("array<string>")), lambda p: F.struct(none.alias("hash"), p.alias("phrase")))
    each = rows.where(sure).select("message_id", F.explode(F.array_compact(F.concat(F.array(shape), said))).alias("e")).select("message_id", "e.*")
    each = each.withColumn("clean", T.normalize(F.col("phrase")))
    of_phrase = F.when(~T.is_low_entropy_text(F.col("clean")), P.stable_hash(F.concat(F.lit("phrase:"), "clean")))
    each = each.withColumn("value", F.coalesce("hash", of_phrase)).where(P.meaningful(F.col("value")))
    kind = F.when(F.col("hash").isNotNull(), "skeleton").otherwise("phrase")
    source = F.when(F.col("hash").isNotNull(), "llm_spam").otherwise("llm_spam_phrase")
    return each.select("message_id", kind.alias("fingerprint_type"), "value", F.lit(settings.scorer_weight).alias("weight"), source.alias("source"))
