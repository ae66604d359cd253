"""Cheaper passes over texts against the patterns that say what they mean."""

import functools
import operator
import random

from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.functions import text as T

PIECES = [
    "http://", "https://", "www.", "HTTP://", "a@b.co", "x.y+z@q-r.example", "@abc", "@ab", "@", "_", "ab", "É", "ß", "ſ", "ı", "K", "中文", "𝒜", "𐐀", "😀", "☂", "퟿",
    "1", "٣", "²", "①", "⓪", "½", " ", "  ", "\t", "\n", "\u0085", " ", " ", "　", "\x1c", "\x1f", "\x00", ".", "-", "(", ")", "<url>", "<w>", "wh", "ww",
]


def test_passes_match_what_the_plain_patterns_match(spark):
    g = random.Random(11)
    texts = ["".join(g.choice(PIECES) for _ in range(g.randrange(14))) for _ in range(6000)]
    x = F.lower("x")
    pairs = {
        "space": (F.trim(F.regexp_replace("x", f"{T.SPACE}+", " ")), T.squeeze(F.col("x"))),
        "digits": (F.regexp_replace("x", T.DIGITS, ""), T.strip_digits(F.col("x"))),
        "mentions": (F.regexp_count("x", F.lit(P.MENTION)).cast("int"), T.mention_count(F.col("x"))),
    }
    for name, plain, low in (("url", P.URL, P._LOW_URL), ("email", P.EMAIL, P._LOW_EMAIL), ("mention", P.MENTION, P._LOW_MENTION), ("words", P.WORDS, P._LOW_WORDS)):
        pairs[name] = F.regexp_replace(x, plain, "#"), F.regexp_replace(x, low, "#")
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    out = rows.select(*(F.sum((~a.eqNullSafe(b)).cast("int")).alias(n) for n, (a, b) in pairs.items()), *(F.sum((a.cast("string") != F.col("x")).cast("int")).alias(f"{n}_acts") for n, (a, b) in pairs.items())).first().asDict()
    assert {n: out[n] for n in pairs} == dict.fromkeys(pairs, 0)
    assert all(out[f"{n}_acts"] > 100 for n in pairs)


def test_passes_that_begin_with_a_search_match_the_plain_ones(spark, monkeypatch):
    """Most texts are told by a search or by their beginning; a short beginning cuts tokens and letters in all places."""
    from sluice.functions import links as L

    monkeypatch.setattr(T, "HEAD", 5)
    g = random.Random(12)
    more = [*PIECES, "WWW.x", "Www.y", "wWw.z", "HtTps://q", "Bot", "abcbot", "T.me/", "t.ME/x", "/", "<mention>", "<ur", "l>", "Ⓐ", "Σ", "ΑΣ"]
    texts = ["".join(g.choice(more) for _ in range(g.randrange(14))) for _ in range(6000)] + ["", None]
    x, low = F.col("x"), F.lower("x")
    none, links = F.array().cast("array<string>"), F.array_join(F.transform(L.extract_links(x), lambda u: u["url"]), " ")
    urls = F.array_join(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("x", F.lit(f"({P.URL})"), F.lit(1)), L.canonical_url), lambda u: u != "")), " ")
    tested = functools.reduce(operator.or_, (F.contains(low, F.lit(n)) for n in L.CARRIER_LINKS))
    for_none = lambda mentions, preview: L.has_carrier(x, none, mentions, preview)
    plain = x.rlike(L.CARRIER_NAME) | (F.contains(low, F.lit("bot")) & x.rlike(L.BOT_NAME)) | tested
    low_text = ~x.rlike("(?s)(?:[一-鿿][^一-鿿]*){3}|(?:[a-zA-Z0-9][^a-zA-Z0-9]*){4}")
    shape = x.isin(*P.LOW_ENTROPY_SKELETONS) | (F.length(F.regexp_replace("x", r"<\w+>|[^\p{L}\p{N}]+", "")) < 3)
    pairs = {
        "links": (urls, links), "carrier": (plain, for_none(F.lit(0), F.lit(False))), "told": (plain | F.lit(True), for_none(F.lit(1), F.lit(False))),
        "unknown": (plain | F.lit(None).cast("boolean"), for_none(F.lit(0), F.lit(None).cast("boolean"))), "punctuation": (~x.rlike(r"[\p{L}\p{N}]"), T.is_punctuation_only(x)),
        "low text": (low_text, T.is_low_entropy_text(x)), "low shape": (shape, P.is_low_entropy_skeleton(x)),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    out = rows.select(*(F.sum((~a.eqNullSafe(b)).cast("int")).alias(n) for n, (a, b) in pairs.items()), F.count_if(shape).alias("low"), F.count_if(plain).alias("led"), F.count_if(urls != "").alias("linked")).first().asDict()
    assert {n: out[n] for n in pairs} == dict.fromkeys(pairs, 0) and 500 < out["low"] < 5500 and 500 < out["led"] < 5500 and out["linked"] > 500


def test_texts_are_lowered_for_carriers_only(spark):
    """What tells of a link is searched for as it stands, and no text is lowered where a link or a mention tells."""
    from sluice.functions import links as L

    rows = spark.createDataFrame([("a",)], "x string").select(L.extract_links(F.col("x")).alias("links"))
    assert "lower(x" not in rows._jdf.queryExecution().optimizedPlan().toString()
