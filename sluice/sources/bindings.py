"""Moderation inputs derived from the provided tables.

Each relation is one SELECT that Spark and DuckDB read alike, so that queries
and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
START = 1704067200
#: The bot's own account.
BOT = 999999999

#: Every document is a message with its whole text; made-up parts stand before or after it.
_WHOLE = """CASE doc_id % 12
    WHEN 0 THEN concat(text, ' 看这里 https://promo', CAST(doc_id % 7 AS STRING), '.example/a。')
    WHEN 1 THEN concat(text, ' @promo_bot 拿码收钱来 ', CAST(doc_id AS STRING))
    WHEN 2 THEN concat('日赚过万 点击领取教程 ', CAST(doc_id % 3 AS STRING), ' ', text)
    WHEN 3 THEN concat(text, ' (www.Site', CAST(doc_id % 5 AS STRING), '.example/p?q=1). mail a.b@c.example!')
    WHEN 4 THEN concat('赚​钱 123 🚀 ', text)
    WHEN 5 THEN concat('ＦＲＥＥ　ｍｏｎｅｙ！ ', text)
    WHEN 6 THEN concat('加群日结兼职 一天几百 t.me/abc ', text)
    WHEN 7 THEN concat('!!! ... 123 ', text)
    WHEN 8 THEN concat('今天天气真不错 大家觉得呢 https://a', CAST(doc_id % 2 AS STRING), '.example/x ', text)
    WHEN 9 THEN concat('https://www.example.com/article ', text)
    ELSE text END"""
_SHORT = """CASE doc_id % 12
    WHEN 6 THEN '加群日结兼职 一天几百 t.me/abc'
    WHEN 7 THEN '!!! ... 123'
    WHEN 8 THEN concat('今天天气真不错 大家觉得呢 https://a', CAST(doc_id % 2 AS STRING), '.example/x')
    ELSE CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'https://www.example.com/article' END END"""
#: Added to the ids of short messages; a multiple of all moduli on ids that choose a message's kind.
SHORT_IDS = 1_200_000_000
#: A message of each document and, besides them, short messages that recur word for word.
_SENT = f"""(SELECT CAST(doc_id AS BIGINT) AS doc_id, {_WHOLE} AS text FROM {{documents}}
  UNION ALL SELECT CAST(doc_id AS BIGINT) + {SHORT_IDS}, {_SHORT} FROM {{documents}} WHERE doc_id % 12 IN (6, 7, 8, 9)) AS sent"""

#: One busy sender, 97 regular ones, and others whose number grows with the documents.
_CHAT = "CAST(CASE WHEN doc_id % 24 = 6 THEN 4 ELSE doc_id % 20 END AS BIGINT)"
_WHO = f"""{_CHAT} AS chat_id,
  CAST(CASE WHEN doc_id % 24 = 6 THEN 5 WHEN doc_id % 2 = 0 THEN doc_id % 97 ELSE doc_id % {SHORT_IDS} END AS BIGINT)"""

RELATIONS = {
    "messages": f"""SELECT CAST(doc_id AS BIGINT) AS message_id, {_WHO} AS user_id,
  CAST({START} + doc_id * 37 AS BIGINT) AS created_at, text,
  CASE doc_id % 12 WHEN 0 THEN concat('https://promo', CAST(doc_id % 7 AS STRING), '.example/a') WHEN 11 THEN ''
    WHEN 7 THEN concat('https://WWW.Spam', CAST(doc_id % {SHORT_IDS} AS STRING), '.example/x.') WHEN 10 THEN concat('https://WWW.Spam', CAST(doc_id % {SHORT_IDS} AS STRING), '.example/x.') END AS preview_url,
  CASE WHEN doc_id % 11 = 3 THEN 'edited_message' ELSE 'message' END AS update_type,
  CASE WHEN doc_id % 9 = 4 THEN 'private' WHEN doc_id % 9 = 5 THEN 'group' ELSE 'supergroup' END AS chat_type,
  doc_id % 13 = 5 AS is_automatic_forward, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 20 AS BIGINT) WHEN doc_id % 3 = 1 THEN CAST(-77 AS BIGINT) END AS sender_chat_id
  FROM {_SENT}""",
    # Every customer in its own name, and as one of the regular senders, of whom the last customer counts.
    "user_reputation": """SELECT chat_id, user_id, greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), (max_by(c_acctbal, c_custkey) + 1000) / 110)) AS reputation_score, CAST(max(c_custkey) % 5 AS BIGINT) AS messages_seen
  FROM (SELECT CAST(c_custkey % 20 AS BIGINT) AS chat_id, CAST(c_custkey AS BIGINT) AS user_id, c_acctbal, c_custkey FROM {customer}
    UNION ALL SELECT CAST(c_custkey % 20 AS BIGINT), CAST(c_custkey % 97 AS BIGINT), c_acctbal, c_custkey FROM {customer} WHERE c_custkey >= 97) AS known GROUP BY chat_id, user_id""",
    "user_profiles": f"""SELECT CAST(c_custkey AS BIGINT) AS user_id, concat('user', CAST(c_custkey AS STRING)) AS username, c_name AS first_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS last_name,
  CASE c_custkey % 7 WHEN 1 THEN '点击进群了解 https://t.me/+abc 做单教程' WHEN 2 THEN '轻松日入过万： @someone' WHEN 3 THEN '私聊 频道 https://t.me/x' WHEN 4 THEN '兼职' END AS bio,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST({START} + c_custkey * 20000 AS BIGINT) END AS bio_fetched_at
  FROM {{customer}}""",
    "votes": f"""SELECT CAST(floor(event_id / 20) AS BIGINT) AS session_id, CAST(user_id AS BIGINT) AS voter_user_id,
  CASE event_type WHEN 'error' THEN 'spam' WHEN 'purchase' THEN 'spam' WHEN 'click' THEN 'ham' WHEN 'view' THEN 'ham' ELSE 'other' END AS vote,
  CAST(event_id AS BIGINT) AS seq, CAST({START} + event_id * 11 AS BIGINT) AS ts FROM {{events}}""",
    "vote_sessions": f"""SELECT CAST(doc_id AS BIGINT) AS id, {_WHO} AS suspect_user_id, CAST(doc_id AS BIGINT) AS original_message_id,
  CASE doc_id % 5 WHEN 0 THEN 'confirmed_spam' WHEN 1 THEN 'released' ELSE 'open' END AS status,
  CAST({START} + doc_id * 37 AS BIGINT) AS created_at, CAST({START} + doc_id * 37 + 1800 AS BIGINT) AS expires_at,
  CASE WHEN doc_id % 7 <> 3 THEN CAST(doc_id AS BIGINT) + 5000000000 END AS vote_message_id FROM {_SENT}""",
    "verdicts": f"""SELECT {_CHAT} AS chat_id, CAST(doc_id AS BIGINT) AS message_id, CASE WHEN doc_id % 10 = 9 THEN 'failed' ELSE 'ok' END AS status,
  toxic = 1 OR doc_id % 6 = 2 AS is_spam, CAST(60 + doc_id % 40 AS DOUBLE) / 100 AS confidence, CASE WHEN doc_id % 10 = 9 THEN 'timeout' END AS error, CASE doc_id % 5 WHEN 0 THEN 'ads' WHEN 1 THEN 'a<b' WHEN 2 THEN '' ELSE 'scam' END AS category,
  CASE doc_id % 4 WHEN 0 THEN '轻松日入过万|可以' WHEN 1 THEN 'Click here|OK' WHEN 2 THEN '' ELSE concat('Words of Phrase ', CAST(doc_id AS STRING), '|video & more') END AS phrases FROM {{labels}}""",
    # Senders and voters in the chats they are seen in, and the bot in all.
    "members": f"""SELECT chat_id, user_id, min(status) AS status, max(deletes) = 1 AS can_delete_messages, max(restricts) = 1 AS can_restrict_members FROM (
    SELECT chat_id, user_id, CASE user_id % 50 WHEN 7 THEN 'administrator' WHEN 8 THEN 'creator' ELSE 'member' END AS status, 0 AS deletes, 0 AS restricts FROM (SELECT {_WHO} AS user_id FROM {_SENT}) AS senders
    UNION ALL SELECT CAST(floor(event_id / 20) % 20 AS BIGINT), CAST(user_id AS BIGINT), CASE WHEN user_id % 4 = 0 THEN 'administrator' ELSE 'member' END, 0, 0 FROM {{events}}
    UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST({BOT} AS BIGINT), CASE n_nationkey % 5 WHEN 0 THEN 'creator' WHEN 1 THEN 'member' ELSE 'administrator' END, CAST(n_nationkey % 3 AS INT), CAST(n_nationkey % 2 AS INT) FROM {{nation}}) AS seen
  GROUP BY chat_id, user_id""",
    "callbacks": """SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS user_id, CAST(event_id % 19 AS BIGINT) AS message_chat_id,
  CASE event_type WHEN 'click' THEN concat('vote:', CAST(CAST(floor(event_id / 20) AS BIGINT) AS STRING), ':spam') WHEN 'view' THEN concat('vote:', CAST(CAST(floor(event_id / 20) AS BIGINT) AS STRING), ':ham')
    WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'vote:x:spam' ELSE concat('admin_ban:', CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(event_id AS STRING) END) END
    WHEN 'signup' THEN concat('admin_verify:', CASE event_id % 4 WHEN 0 THEN 'allow_chat' WHEN 1 THEN 'deny_chat' WHEN 2 THEN 'status' ELSE 'drop' END, ':', CASE WHEN event_id % 11 = 0 THEN '?' WHEN event_id % 5 = 0 THEN '3' ELSE CAST(event_id % 19 AS STRING) END)
    ELSE concat('admin_ban:', CAST(CAST(floor(event_id / 20) AS BIGINT) AS STRING)) END AS data FROM {events}""",
    "previews": """SELECT concat('https://WWW.Spam', CAST(page_id AS STRING), '.example/x') AS url, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS og_title,
  CASE page_id % 3 WHEN 1 THEN '推特 成人版 视频' ELSE 'weather news' END AS og_description, concat(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), ' ', CASE page_id % 3 WHEN 1 THEN '推特 成人版 视频' ELSE 'weather news' END) AS og_text FROM {pages}""",
    "allowed_chats": "SELECT CAST(n_nationkey AS BIGINT) AS chat_id FROM {nation} WHERE n_regionkey <> 1",
    "whitelisted_users": "SELECT CAST(s_suppkey AS BIGINT) AS user_id, CAST(s_nationkey AS BIGINT) AS added_at FROM {supplier} WHERE s_acctbal < 3000",
    "reputation_events": f"""SELECT CAST(event_id AS BIGINT) AS seq, CAST(event_id % 20 AS BIGINT) AS chat_id, CAST(user_id AS BIGINT) AS user_id,
  CASE WHEN event_type = 'error' THEN CAST(-35 AS DOUBLE) ELSE CAST(8 AS DOUBLE) END AS delta, CAST({START} + event_id * 11 AS BIGINT) AS ts FROM {{events}} WHERE event_type <> 'view'""",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of `RELATIONS`, or a provided table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = RELATIONS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)
