"""Text, fingerprint and link functions over the derived messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.functions import links as L
from sluice.functions import phrases as R
from sluice.functions import text as T
from sluice.operators.features import features, spread
from sluice.sources.bindings import relation

from . import duck as D
from .registry import query


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(relation(spark, sf_dir, "messages"), "message_id")


def _one(spark: SparkSession, sf_dir: str, value: object) -> DataFrame:
    return _messages(spark, sf_dir).select("message_id", value.alias("value"))


def _sql(value: str, *names: str) -> str:
    return D.with_(*(names or ("messages",))) + f"SELECT message_id, {value} AS value FROM {(names or ('messages',))[-1]}"


@query(_sql(D.bare("text")))
def zero_width_strip(spark, sf_dir):
    return _one(spark, sf_dir, T.strip_zero_width(F.col("text")))


@query(_sql(D.normalize("text")))
def text_normalize(spark, sf_dir):
    return _one(spark, sf_dir, T.normalize(F.col("text")))


@query(_sql(D.punctuation_only("clean"), "messages", "texts"))
def punctuation_only(spark, sf_dir):
    return _one(spark, sf_dir, T.is_punctuation_only(T.normalize(F.col("text"))))


@query(_sql(f"CAST({D.mentions('text')} AS INTEGER)"))
def mention_count(spark, sf_dir):
    return _one(spark, sf_dir, T.mention_count(F.col("text")))


@query(_sql(D.digest("clean"), "messages", "texts"))
def content_hash(spark, sf_dir):
    return _one(spark, sf_dir, P.content_hash(F.col("text")))


@query(_sql("skeleton", "messages", "texts"))
def skeleton(spark, sf_dir):
    return _one(spark, sf_dir, P.skeleton(F.col("text")))


@query(_sql(D.digest("skeleton"), "messages", "texts"))
def skeleton_hash(spark, sf_dir):
    return _one(spark, sf_dir, P.skeleton_hash(F.col("text")))


@query(_sql(D.low_skeleton("skeleton"), "messages", "texts"))
def low_entropy_skeleton(spark, sf_dir):
    return features(_messages(spark, sf_dir)).select("message_id", P.is_low_entropy_skeleton(F.col("skeleton")).alias("value"))


@query(_sql(D.low_text("clean"), "messages", "texts"))
def low_entropy_text(spark, sf_dir):
    return features(_messages(spark, sf_dir)).select("message_id", T.is_low_entropy_text(F.col("clean")).alias("value"))


_COMPACT = r"regexp_replace(clean, '\s+', '', 'g')"


@query(_sql(f"CAST(CASE WHEN length({_COMPACT}) = 0 THEN 0 ELSE greatest(1, length({_COMPACT}) - 2) END AS INTEGER)", "messages", "texts"))
def trigram_count(spark, sf_dir):
    return _one(spark, sf_dir, F.size(P.trigrams(T.normalize(F.col("text")))))


#: Relation `simhashes` (message_id, simhash) from `texts`.
SIMHASHES = f""", compact AS (SELECT message_id, {_COMPACT} AS c FROM texts),
grams AS (SELECT message_id, CASE WHEN length(c) = 0 THEN [] WHEN length(c) <= 3 THEN [c] ELSE list_transform(range(1, length(c) - 1), lambda i: substring(c, i, 3)) END AS grams FROM compact),
hashes AS (SELECT message_id, CAST('0x' || right(sha256(gram), 16) AS UBIGINT) AS h FROM (SELECT message_id, unnest(grams) AS gram FROM grams)),
bits AS (SELECT message_id, b, sum(CASE WHEN (h >> CAST(b AS UBIGINT)) & CAST(1 AS UBIGINT) = 1 THEN 1 ELSE -1 END) AS votes FROM hashes, range(64) AS r(b) GROUP BY ALL),
found AS (SELECT message_id, sum(CASE WHEN votes > 0 THEN CAST(1 AS HUGEINT) << CAST(b AS INTEGER) ELSE 0 END) AS v FROM bits GROUP BY message_id),
simhashes AS (SELECT m.message_id, CAST(coalesce(v, 0) AS VARCHAR) AS simhash FROM texts m LEFT JOIN found USING (message_id))
"""


@query(D.with_("messages", "texts").rstrip() + SIMHASHES + "SELECT * FROM simhashes")
def simhash(spark, sf_dir):
    return P.simhash(_messages(spark, sf_dir), "message_id", "text")


_SHOWN = "array_to_string(list_transform({x}, lambda l: concat(l.source, '|', l.url, '|', coalesce(l.domain, ''))), ' ')"


@query(_sql(_SHOWN.format(x="links"), "messages", "texts"))
def link_extract(spark, sf_dir):
    shown = F.transform("links", lambda x: F.concat_ws("|", x["source"], x["url"], F.coalesce(x["domain"], F.lit(""))))
    return features(_messages(spark, sf_dir)).select("message_id", F.array_join(shown, " ").alias("value"))


@query(_sql(f"array_to_string({D.domains('links')}, ' ')", "messages", "texts"))
def link_domains(spark, sf_dir):
    return features(_messages(spark, sf_dir)).select("message_id", F.array_join(L.link_domains(F.col("links")), " ").alias("value"))


#: Documents as texts or captions, with a link behind a word of either.
_CAPTIONS = """SELECT CAST(doc_id AS BIGINT) AS message_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('https://t.example/ ', text) END AS text, concat('see https://C', CAST(doc_id % 9 AS STRING), '.example/x. ', text) AS caption,
  CASE doc_id % 4 WHEN 0 THEN 'https://E1.example/' WHEN 1 THEN 'https://t.example/' WHEN 2 THEN '' END AS linked, CASE WHEN doc_id % 5 <> 4 THEN concat('www.ce', CAST(doc_id % 5 AS STRING), '.example!') END AS caption_linked,
  CASE WHEN doc_id % 7 = 3 THEN 'https://E1.example' END AS preview_url FROM {documents}"""
_TEXT = "coalesce(nullif(text, ''), nullif(caption, ''), '')"


@query(f"WITH sent AS (SELECT *, {_TEXT} AS said, coalesce(linked, caption_linked) AS entity FROM ({_CAPTIONS.format(documents='documents')})) SELECT message_id, length(said) AS n, " + _SHOWN.format(x=D.links("said", "preview_url", "entity")) + " AS links FROM sent")
def caption_links(spark, sf_dir):
    rows = spark.sql(_CAPTIONS, documents=relation(spark, sf_dir, "documents"))
    entity = lambda c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit("text_link").alias("type"), F.col(c).alias("url")))).otherwise(F.array().cast("array<struct<type:string,url:string>>"))
    found = features(rows.withColumns({"entities": entity("linked"), "caption_entities": entity("caption_linked")}))
    shown = F.transform("links", lambda x: F.concat_ws("|", x["source"], x["url"], F.coalesce(x["domain"], F.lit(""))))
    return found.select("message_id", F.char_length("text").cast("bigint").alias("n"), F.array_join(shown, " ").alias("links"))


_URLS = """SELECT page_id, CASE page_id % 12 WHEN 6 THEN concat('HTTP://[::1]/', CAST(page_id AS STRING)) WHEN 7 THEN concat('http://', CAST(page_id % 256 AS STRING), '.', CAST(page_id % 200 AS STRING), '.3.4/x;y?z#f') WHEN 8 THEN concat('https://:@Name', CAST(page_id AS STRING), '.example:?q')
  WHEN 9 THEN 'http://sub.LOCALHOST:80' WHEN 10 THEN concat('https://a:b@h', CAST(page_id AS STRING), '.example/') WHEN 11 THEN concat('  www.Www.B', CAST(page_id AS STRING), '.example./y。') WHEN 0 THEN url WHEN 1 THEN concat('  ', url, '。，)') WHEN 2 THEN concat('www.', substring(url, 9)) WHEN 3 THEN concat('http://u:p@WWW.A', CAST(page_id AS STRING), '.Example.:8080/x')
  WHEN 4 THEN concat('https://h', CAST(page_id AS STRING), '.example:443?q=a|b') ELSE concat('ftp://x_', CAST(page_id AS STRING), '.example/') END AS url FROM {pages}"""


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_URLS, pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _url_sql(value: str) -> str:
    return f"WITH urls AS ({_URLS.format(pages='pages')}) SELECT page_id, {value} AS value FROM urls"


@query(_url_sql(D.canonical("url")))
def url_canonical(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", L.canonical_url(F.col("url")).alias("value"))


@query(_url_sql(D.domain("url")))
def url_domain(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", L.url_domain(F.col("url")).alias("value"))


_ALLOWED = ("example.net", "h4.example")


@query(_url_sql("coalesce(" + " OR ".join(f"{D.domain('url')} = '{a}' OR ends_with({D.domain('url')}, '.{a}')" for a in _ALLOWED) + ", false)"))
def domain_whitelist(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", L.is_whitelisted(L.url_domain(F.col("url")), _ALLOWED).alias("value"))


_WHERE = "regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)"
_SERVER = f"regexp_extract({_WHERE}, '([^@]*)$', 1)"
_PORT = f"regexp_extract({_SERVER}, '^(\\[[^\\]]*\\]|[^:]*)(:(.*))?$', 3)"
_HOST = f"lower(trim(regexp_extract({_SERVER}, '^(\\[[^\\]]*\\]|[^:]*)', 1), '[]'))"
_FORM = f"(regexp_matches(url, '(?i)^https?://') AND {_HOST} <> '' AND regexp_extract({_WHERE}, '^(.*)@', 1) IN ('', ':') AND {_PORT} IN ('', '0', '80', '443'))"
_OCTETS = f"CASE WHEN regexp_full_match({_HOST}, '[0-9]+(\\.[0-9]+){{3}}') THEN list_transform(string_split({_HOST}, '.'), lambda x: CAST(x AS INTEGER)) END"
#: Literal addresses that are not public, of those that the bound urls have: private, own, shared, multicast and reserved ones.
_INNER = f"""({_HOST} = '::1' OR coalesce(o[1] IN (0, 10, 127) OR o[1] >= 224 OR (o[1] = 100 AND o[2] BETWEEN 64 AND 127) OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31)
  OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 198 AND o[2] IN (18, 19)), false))"""


@query(f"WITH urls AS ({_URLS.format(pages='pages')}), o AS (SELECT *, {_OCTETS} AS o FROM urls) SELECT page_id, {_FORM} AND {_HOST} <> 'localhost' AND NOT ends_with({_HOST}, '.localhost') AND NOT {_INNER} AS value FROM o")
def url_guard(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", L.url_guard(F.col("url")).alias("value"))


_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*[^?#]*(\\?[^#]*)', 1)"


@query(_url_sql(f"CASE WHEN {_FORM} THEN concat_ws(' ', concat(lower(regexp_extract(url, '^([A-Za-z]+)', 1)), '://', {_WHERE}, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END, {_QUERY}), {_HOST}, CASE WHEN {_PORT} IN ('80', '443') THEN {_PORT} WHEN regexp_matches(url, '(?i)^https') THEN '443' ELSE '80' END) END"))
def url_endpoint(spark, sf_dir):
    at = L.endpoint(F.col("url"))
    return _urls(spark, sf_dir).select("page_id", F.when(at.isNotNull(), F.concat_ws(" ", at["url"], at["host"], at["port"].cast("string"))).alias("value"))


@query(_sql("carrier", "messages", "texts", "features"))
def message_carrier(spark, sf_dir):
    return features(_messages(spark, sf_dir)).select("message_id", F.col("carrier").alias("value"))


@query(_sql("clean <> '' AND carrier AND strong", "messages", "texts", "features"))
def hard_spam_text(spark, sf_dir):
    return features(_messages(spark, sf_dir)).select("message_id", ((F.col("clean") != "") & F.col("carrier") & F.col("strong")).alias("value"))


@query(D.with_("user_profiles") + f"SELECT user_id, {D.spam_bio('bio')} AS value FROM user_profiles")
def spam_bio(spark, sf_dir):
    return relation(spark, sf_dir, "user_profiles").select("user_id", L.is_spam_bio(F.col("bio")).alias("value"))


@query(_sql("CASE WHEN clean <> '' THEN " + D.digest("concat('phrase:', clean)") + " END", "messages", "texts"))
def phrase_hash(spark, sf_dir):
    return _one(spark, sf_dir, R.phrase_hash(F.col("text")))


_RUNS = r"regexp_extract_all(clean, '[\x{4e00}-\x{9fff}]{3,}|[a-z_]{4,}')"
_GRAMS = (
    "list_transform(range(3, least(12, length(r)) + 1), lambda s: list_transform(range(1, length(r) - s + 2), lambda i: substring(r, i, s)))"
)


def phrases_of(fields: str) -> str:
    """Relation `phrases` (message_id, phrase, n) from rows (message_id, f, clean): the distinct ones in order of their first
    place, as a window finds it, since DuckDB's list_distinct does not keep the order."""
    return rf""", fields AS ({fields}),
runs AS (SELECT message_id, f, clean, generate_subscripts({_RUNS}, 1) AS place, unnest({_RUNS}) AS r FROM fields WHERE clean <> ''),
parts AS (
  SELECT message_id, f, 0 AS place, 0 AS inner_place, clean AS phrase FROM fields WHERE clean <> ''
  UNION ALL SELECT message_id, f, place, 0, r FROM runs
  UNION ALL SELECT message_id, f, place, unnest(range(1, CAST(len(flatten(g)) AS BIGINT) + 1)), unnest(flatten(g))
    FROM (SELECT message_id, f, place, {_GRAMS} AS g FROM runs WHERE regexp_full_match(r, '[\x{{4e00}}-\x{{9fff}}]+'))),
firsts AS (SELECT message_id, phrase, min((f, place, inner_place)) AS pos FROM parts GROUP BY ALL),
phrases AS (SELECT message_id, phrase, row_number() OVER (PARTITION BY message_id ORDER BY pos) AS n FROM firsts QUALIFY n <= 256)"""


#: Of the message's text alone.
PHRASES = phrases_of("SELECT message_id, 0 AS f, clean FROM texts")


@query(D.with_("messages", "texts") + PHRASES + """, joined AS (SELECT message_id, count(*) AS n, md5(string_agg(phrase, '|' ORDER BY n)) AS digest FROM phrases GROUP BY message_id)
SELECT m.message_id, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(digest, md5('')) AS digest FROM messages m LEFT JOIN joined USING (message_id)""")
def phrase_candidates(spark, sf_dir):
    rows = features(_messages(spark, sf_dir)).select("message_id", R.candidates(F.col("clean")).alias("p"))
    return rows.select("message_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|").cast("binary")).alias("digest"))


_FEATURES = "message_id, content_hash, skeleton_hash, punctuation_only, has_preview, carrier, strong"


@query(D.with_("messages", "texts", "features") + f"SELECT {_FEATURES}, CAST(mentions AS INTEGER) AS mentions, CAST(len(links) AS INTEGER) AS link_count FROM features")
def message_features(spark, sf_dir):
    return features(_messages(spark, sf_dir)).select(*_FEATURES.split(", "), "mentions", F.size("links").alias("link_count"))


_CHAT = "CASE WHEN message_id % 2 = 0 THEN chat_id - 1000000000000 - 5 ELSE -chat_id END"
_MESSAGE = "CAST(message_id AS VARCHAR)"


@query(_sql(f"CASE WHEN starts_with(CAST({_CHAT} AS VARCHAR), '-100') THEN concat('<a href=\"https://t.me/c/', substring(CAST({_CHAT} AS VARCHAR), 5), '/', {_MESSAGE}, '\">', {_MESSAGE}, '</a>') ELSE concat('<code>', {_MESSAGE}, '</code>') END"))
def message_link(spark, sf_dir):
    from sluice.operators.reports import message_link as link

    chat = F.when(F.col("message_id") % 2 == 0, F.col("chat_id") - 1000000000000 - 5).otherwise(-F.col("chat_id"))
    return _one(spark, sf_dir, link(chat, F.col("message_id")))
