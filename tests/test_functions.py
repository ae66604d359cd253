"""Single cases of text functions, rules, folds and streams."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.functions import links as L
from sluice.functions import phrases as R
from sluice.functions import text as T
from sluice.operators import gating, rules, scoring, state
from sluice.operators.features import features
from sluice.operators.previews import Response, charset, fetch, fetched, is_html, parse_preview
from sluice.settings import Settings, read_env
from sluice.sources.bindings import relation
from sluice.streaming import folds

SF = "/root/testdata/sf0.001"


def one(spark, value, text, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(value(F.col("x")).alias("v")).first().v


@pytest.mark.parametrize("text, clean", [("赚​钱 123 🚀", "赚钱"), ("ＦＲＥＥ　１２", "free"), ("", ""), ("①½ﬁ", "1⁄2fi".replace("1", "").replace("2", "")), ("  A\tB\n", "a b")])
def test_normalize(spark, text, clean):
    assert one(spark, T.normalize, text) == clean


def test_nfkc_agrees_with_the_library_on_every_safe_character(spark):
    chars = [chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2030), *range(0x3000, 0x3012), *range(0xFF00, 0xFFF0)] if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(c,) for c in chars], "x string").select("x", T.nfkc(F.col("x")).alias("v")).collect()
    assert [r.x for r in got if r.v != unicodedata.normalize("NFKC", r.x)] == []


def test_skeleton_folds_carriers_and_words(spark):
    a, b = (one(spark, P.skeleton, f"buy now https://promo-{x}.example for {n}% off") for x, n in (("a", 50), ("b", 90)))
    assert a == b and "<url>" in a and "<w>" in a
    assert one(spark, P.skeleton, "https://example.com/article") == "<url>"
    assert one(spark, P.skeleton, "不清楚") == "不清楚"
    assert one(spark, P.skeleton, "été x@y.example @name_1") == "é <w> é <email> <mention>"
    assert one(spark, P.skeleton, "a<url>b <u1rl><URL> << <w> @abc @def ſad 日本x!!") == "<w> <url> <w> <url> < <w> > <mention> ſad 日本 <w> ! !"


def test_links_keep_the_first_of_equal_urls(spark):
    df = spark.createDataFrame([("看这里 https://example.com/a。 https://example.com/a", "https://www.Spam.example/x.")], "t string, p string")
    got = df.select(L.extract_links(F.col("t"), F.col("p")).alias("v")).first().v
    assert [(x.url, x.source, x.domain) for x in got] == [("https://example.com/a", "text", "example.com"), ("https://www.Spam.example/x", "preview", "spam.example")]
    assert one(spark, L.extract_links, "看https://example.com/a") == []


def test_phrases(spark):
    assert one(spark, R.candidates, "日赚过万 click here") == ["日赚过万 click here", "日赚过万", "日赚过", "赚过万", "click", "here"]
    assert len(one(spark, R.candidates, "".join(chr(0x4E00 + i) for i in range(2000)))) == 256
    assert one(spark, lambda x: R.lookup_hashes(F.array(x)), "可以") == []


@pytest.mark.parametrize("url, ok", [("https://a.example/x", True), ("http://a.example:80", True), ("file:///etc/passwd", False), ("http://localhost/", False), ("https://u@a.example", False), ("https://a.example:8080/", False)])
def test_url_guard(spark, url, ok):
    assert one(spark, L.url_guard, url) is ok


def test_addresses(spark):
    df = spark.createDataFrame([("127.0.0.1",), ("8.8.8.8",), ("[::1]",), ("name",)], "x string")
    assert [r.v for r in df.select(L.is_global_address("x").alias("v")).collect()] == [False, True, False, None]


def decide(spark, text="", preview=None, reputation=50.0, fp=None, bio=None, og=None, **more):
    fp = fp or (None, None, None)
    row = (1, text, preview, reputation, *fp, bio, og, more.get("sessions"), more.get("prior"))
    schema = "message_id long, text string, preview_url string, reputation_score double, fp_type string, fp_value string, fp_weight double, bio string, og_text string, session_ids array<long>, prior_senders long"
    r = rules.decide(features(spark.createDataFrame([row], schema))).first()
    return r.action, r.reason


@pytest.mark.parametrize(
    "given, expected",
    [
        ({"text": "...", "preview": "https://x.example"}, ("withdraw_vote", "empty_or_punctuation_with_link_preview")),
        ({"text": "hello https://spam.example/a"}, ("review", "link_message_needs_llm")),
        ({"text": "hello everyone"}, ("review", "unmatched_message_needs_llm")),
        ({"text": "hello", "reputation": 10.0, "fp": ("content", "x", 90.0)}, ("ban", "known_high_weight_fingerprint_low_reputation")),
        ({"text": "hello", "reputation": 90.0, "fp": ("content", "x", 90.0)}, ("withdraw_vote", "known_high_weight_fingerprint_generalized")),
        ({"text": "hello", "fp": ("skeleton", "x", 90.0)}, ("withdraw_vote", "known_high_weight_fingerprint_generalized")),
        ({"text": "hello", "fp": ("phrase", "x", 45.0)}, ("withdraw_vote", "known_fingerprint")),
        ({"text": "hello", "fp": ("phrase", "x", 30.0)}, ("review", "weak_fingerprint_needs_llm")),
        ({"text": "", "fp": ("content", P.EMPTY_HASH, 95.0)}, ("review", "unmatched_message_needs_llm")),
        ({"text": "签到", "bio": "https://t.me/+x 做单"}, ("ban", "spam_profile_bio")),
        ({"text": "@daishx1bot 拿码收钱来", "fp": ("skeleton", "x", 45.0)}, ("ban", "hard_spam_message")),
        ({"text": "@qunji2bot 加群一个20"}, ("review", "unmatched_message_needs_llm")),
        ({"text": "!", "preview": "https://x.example", "og": "CRTV成人版"}, ("ban", "hard_spam_link_preview")),
        ({"text": "今天天气真不错 https://a.example", "prior": 2}, ("ban", "repeated_skeleton_across_senders")),
        ({"text": "今天天气真不错 https://a.example", "prior": 1}, ("review", "link_message_needs_llm")),
        ({"text": "hello", "sessions": [4]}, ("ban", "repeated_open_vote_message_same_user")),
        ({"text": "hello", "sessions": [4], "reputation": 80.0}, ("review", "unmatched_message_needs_llm")),
    ],
)
def test_rules(spark, given, expected):
    assert decide(spark, **given) == expected


def test_gate_and_joins(spark):
    schema = "chat_id long, user_id long, text string, chat_type string, update_type string, is_automatic_forward boolean, sender_chat_id long"
    rows = [(1, 5, "hi", "group", "message", False, None), (1, 5, "/go", "group", "message", False, None), (1, 5, "hi", "private", "message", False, None), (1, 5, "hi", "group", "message", True, 9), (1, 5, "hi", "group", "edited_message", True, 9), (1, None, "hi", "group", "message", False, None)]
    assert spark.createDataFrame(rows, schema).where(gating.in_scope()).count() == 2
    joined = spark.createDataFrame([(3, [7, 8, 7]), (3, [])], "user_id long, new_chat_members array<long>")
    assert sorted(r.user_id for r in gating.senders(joined).collect()) == [3, 7, 8]


def test_folds(spark):
    votes = spark.createDataFrame([(1, 100, "spam", 1, 1), (1, 100, "ham", 2, 2), (1, 100, "ham", 3, 3), (1, 101, "x", 4, 4)], "session_id long, voter_user_id long, vote string, ts long, seq long")
    assert [tuple(r) for r in state.running_votes(votes).select("spam", "ham").collect()] == [(1, 0), (0, 1), (0, 1)]
    assert one(spark, lambda w: state.hit_weight(w, F.lit(21)), 50.0, "double") == 80.0
    assert one(spark, lambda w: state.hit_weight(w, F.lit(1)), 85.0, "double") == 85.0
    deltas = spark.createDataFrame([(i, 1, 1, d) for i, d in enumerate((60.0, -35.0, -90.0, 8.0))], "seq long, chat_id long, user_id long, delta double")
    assert state.reputation(deltas.orderBy(F.rand())).first().reputation_score == 8.0
    ups = spark.createDataFrame([(1, "v", "up", 85.0), (2, "v", "down", 0.0), (0, "v", "down", 0.0)], "seq long, value string, kind string, weight double").selectExpr("*", "'content' AS fingerprint_type", "'vote' AS source")
    assert tuple(state.fold_feedback(ups).first()) == ("v", "content", 55.0, 1, "vote")


def test_replies(spark):
    read = lambda x: one(spark, scoring.parse_verdict, x)
    assert read('```json\n{"is_spam": true, "confidence": 1.4, "signal_phrases": ["a", " "]}\n```').asDict() == {"is_spam": True, "confidence": 1.0, "category": None, "skeleton_hash": None, "signal_phrases": ["a"]}
    assert read('{"is_spam": "true", "confidence": 1}') is None and read("[]") is None and read("no") is None and read('{"is_spam": true, "confidence": true}') is None


def test_scorer_sees_only_what_asks_for_it(spark):
    import json

    df = features(spark.createDataFrame([(1, "hello https://spam.example/a", None, 50.0, True), (2, "x", None, 50.0, False)], "message_id long, text string, preview_url string, reputation_score double, scorer boolean"))
    asked = json.loads(df.where("message_id = 1").select(scoring.payload().alias("p")).first().p)
    assert len(asked) == 14 and asked["link_domains"] == ["spam.example"] and asked["sender_profile"] is None
    rows = scoring.score(df, lambda requests: ['{"is_spam": true, "confidence": 0.9}' if json.loads(r)["raw_text"].startswith("hello") else None for r in requests]).collect()
    assert [(r.message_id, r.status, r.is_spam, r.confidence) for r in rows] == [(1, "ok", True, 0.9)]


def test_previews(spark):
    got = parse_preview('<title>t</title><meta property="og:title" content="CRTV成人版"><meta name="description" content=" a  b ">')
    assert got["title"] == "CRTV成人版" and got["description"] == "a b" and got["text"] == "CRTV成人版 a b" and got["site_name"] is None and not got["truncated"]
    assert parse_preview("")["text"] == ""
    assert one(spark, is_html, "image/png") is False and one(spark, is_html, "") is True
    assert one(spark, charset, "text/html; charset=GBK") == "GBK" and one(spark, charset, "text/html") == "utf-8"


def test_settings():
    s = Settings.from_mapping({"VOTE_MIN_CONFIRMATIONS": "2", "require_allowed_chat": "no", "admin_user_ids": "1, 2", "other": "x"})
    assert s.vote_min_confirmations == 2 and not s.require_allowed_chat and s.admin_user_ids == (1, 2)


def stream(spark, df, path, name, make, mode):
    df.repartition(3).write.mode("overwrite").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(path)
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}-state").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_streams_agree_with_batch(spark, rocks, tmp_path):
    pytest.importorskip("google.protobuf")
    votes = relation(spark, SF, "votes")
    cols = ["session_id", "outcome", "closed_seq", "spam_votes", "ham_votes"]
    got = stream(spark, votes, str(tmp_path / "votes"), "outcomes", folds.vote_outcomes, "append")
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, state.vote_outcome(votes).select(cols).collect()))


def test_repeat_senders_on_a_stream(spark, rocks, tmp_path):
    pytest.importorskip("google.protobuf")
    from sluice.operators.lookup import prior_senders

    rows = [(f"s{i % 3}", i, i % 7, 1000 + 40 * i) for i in range(120)]
    df = spark.createDataFrame(rows, "skeleton_hash string, message_id long, user_id long, created_at long")
    got = stream(spark, df, str(tmp_path / "messages"), "repeats", folds.repeat_senders, "append")
    expected = sorted(map(tuple, prior_senders(df, 300).collect()))
    assert sorted(map(tuple, got.select("message_id", "prior_senders").collect())) == expected
    plain = [(m, len({u2 for s2, m2, u2, t2 in rows if s2 == s and m2 < m and t2 >= t - 300 and u2 != u})) for s, m, u, t in rows]
    assert expected == plain


def test_reputation_on_a_stream(spark, rocks, tmp_path):
    pytest.importorskip("google.protobuf")
    events = relation(spark, SF, "reputation_events")
    got = stream(spark, events, str(tmp_path / "events"), "scores", folds.reputation, "update")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state.reputation(events).collect()))


def test_ties_and_repeated_rows_do_not_count_twice(spark):
    from sluice.operators.lookup import prior_senders

    df = spark.createDataFrame([("s", 1, 5, 100), ("s", 2, 5, 100), ("s", 3, 6, 100), ("s", 3, 6, 100), ("s", 4, None, 100)], "skeleton_hash string, message_id long, user_id long, created_at long")
    got = {r.message_id: r.prior_senders for r in prior_senders(df, 300).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2}


def test_every_document_is_sent_whole(spark):
    documents = relation(spark, SF, "documents").withColumnRenamed("doc_id", "message_id").withColumnRenamed("text", "whole")
    sent = documents.join(relation(spark, SF, "messages"), "message_id", "left")
    assert sent.count() == documents.count() and sent.where("text is null or not contains(text, whole)").count() == 0


def test_phrases_of_profile_and_preview_are_looked_up(spark, monkeypatch):
    from sluice.plans import QUERIES
    from sluice.plans import decision_queries as Q

    def known(rows, *_):
        phrases = spark.createDataFrame([(1, "轻松日入过万"), (2, "成人版")], "id long, p string")
        return phrases.select("id", F.lit("phrase").alias("fingerprint_type"), R.phrase_hash(F.col("p")).alias("value"), (F.lit(95.0) + F.col("id")).alias("weight"))

    # The message's own phrases come first, so only short messages leave room for others within the limit.
    messages = Q.messages(spark, SF).where("length(text) < 100").select("message_id", "user_id", "preview_link")
    bios = relation(spark, SF, "user_profiles").where("bio like '%轻松日入过万%'").select("user_id")
    of_profile = {r.message_id for r in messages.join(bios, "user_id").collect()}
    previews = relation(spark, SF, "previews").where("og_description like '%成人版%'").select(F.col("url").alias("preview_link"))
    of_preview = {r.message_id for r in messages.join(previews, "preview_link").collect()}
    monkeypatch.setattr(Q, "fingerprints", known)
    rows = QUERIES["strongest_fingerprint"](spark, SF).join(messages, "message_id").collect()
    found = {r.message_id: r.fp_id for r in rows}
    assert of_profile and of_preview
    assert found == {m: 2 if m in of_preview else 1 for m in of_profile | of_preview}


def test_phrases_of_a_long_repetitive_run(spark):
    run = "哈" * 260 + "".join(chr(0x4E00 + i) for i in range(100))
    grams = [run[i : i + size] for size in range(3, 13) for i in range(len(run) - size + 1)]
    assert one(spark, R.candidates, run) == list(dict.fromkeys([run, *grams]))[:256]


def test_relations_take_every_row(spark):
    customers, messages = relation(spark, SF, "customer"), relation(spark, SF, "messages")
    ids = {r.c_custkey for r in customers.collect()}
    for name in ("user_profiles", "user_reputation"):
        rows = relation(spark, SF, name)
        key = ["user_id"] if name == "user_profiles" else ["chat_id", "user_id"]
        assert ids <= {r.user_id for r in rows.collect()} and rows.count() == rows.select(*key).distinct().count()
    assert relation(spark, SF, "vote_sessions").count() == messages.count()
    assert messages.select("user_id").distinct().count() > 97


def test_fetches_are_guarded():
    pages = {"https://a.example/x": Response(302, headers={"location": "/y?q#f"}), "https://a.example/y?q": Response(200, b"<title>y</title>" + b" " * 70_000, {"content-type": "text/html; charset=utf-8"}), "https://a.example/": Response(200, b"png", {"content-type": "image/png"}), "https://a.example/in": Response(301, headers={"location": "http://127.0.0.1/"}), "https://a.example/loop": Response(307, headers={"location": "/loop"}), "https://a.example/no": Response(404)}
    names = {"a.example": ["8.8.8.8"], "mixed.example": ["8.8.8.8", "10.0.0.1"]}
    asked = []

    def fetcher(url, address):
        asked.append((url, address))
        return pages[url]

    got = lambda url: fetch(url, fetcher, lambda host, port: names[host])
    found = got("https://a.example/x")
    assert (found["url"], found["final_url"], found["title"], found["truncated"]) == ("https://a.example/x", "https://a.example/y?q", "y", True)
    assert got("https://a.example#f")["text"] == "" and asked[-1] == ("https://a.example/", "8.8.8.8")
    assert got("https://a.example/in") is None and got("https://a.example/no") is None and got("https://mixed.example/") is None and got("https://b.example/") is None
    before = len(asked)
    assert got("https://a.example/loop") is None and len(asked) == before + 4
    for url in ("ftp://a.example/", "https://u@a.example/", "https://a.example:8080/", "https:///x", "http://[::1]/", "http://224.0.0.1/", "x"):
        assert got(url) is None
    assert len(asked) == before + 4


def test_fetches_of_a_table(spark):
    rows = spark.createDataFrame([(1, "https://a.example/x"), (2, "https://a.example/x"), (3, None), (4, "http://10.0.0.1/")], "message_id long, preview_link string")
    got = fetched(rows, lambda url, address: Response(200, f"<title>{url} {address}</title>".encode()), lambda host, port: ["9.9.9.9"]).collect()
    assert sorted((r.url, r.preview and r.preview.title) for r in got) == [("http://10.0.0.1/", None), ("https://a.example/x", "https://a.example/x 9.9.9.9")]


def test_scorers_are_asked_in_order(spark):
    def down(requests):
        raise TimeoutError("after 8.0s")

    some = lambda requests: ['{"is_spam": false, "confidence": 0.2}' if '"raw_text":"a' in r else "no" for r in requests]
    last = lambda requests: ['{"is_spam": true, "confidence": 0.9}' if '"raw_text":"b' in r else "" for r in requests]
    df = features(spark.createDataFrame([(i, t, None, 50.0, True) for i, t in enumerate("abc")], "message_id long, text string, preview_url string, reputation_score double, scorer boolean"))
    ask = lambda *scorers: {r.message_id: (r.status, r.provider_count, r.is_spam, r.error) for r in scoring.score(df, scorers).collect()}
    assert ask(down, some, last) == {0: ("ok", 3, False, None), 1: ("ok", 3, True, None), 2: ("failed", 3, None, "empty content")}
    assert ask(down)[0] == ("failed", 1, None, "TimeoutError: after 8.0s") and ask()[0][:2] == ("disabled", 0)


@pytest.mark.parametrize("reply", ['{"is_spam": true, "confidence": 1}', "```JSON\n{\"is_spam\": false, \"confidence\": 0.5}\n```", 'so {"is_spam": true, "confidence": 2} it is', "[]", "", '{"is_spam": 1, "confidence": 1}', '{"is_spam": true, "confidence": "1"}', '{"is_spam": true, "confidence": true}', "{", "5"])
def test_both_readers_of_replies_agree(spark, reply):
    assert (one(spark, scoring.parse_verdict, reply) is None) == (scoring.fault(reply) is not None)


def test_providers():
    of = lambda **x: [(p.base_url, p.api_key, p.model) for p in scoring.providers(Settings.from_mapping(x))]
    assert of(NEWAPI_BASE_URLS="https://a.example, https://b.example/v1/chat/completions", NEWAPI_API_KEY="k", NEWAPI_MODELS="m,n") == [("https://a.example/v1", "k", "m"), ("https://b.example/v1", "k", "n")]
    assert of(NEWAPI_BASE_URL="a,b,c", NEWAPI_API_KEYS="k,l") == [("a", "k", "gpt-5.4"), ("b", "l", "gpt-5.4")] and of(NEWAPI_BASE_URL="a") == []


def test_env_files():
    got = read_env("# c\nA=1\n B = \"x=y\" \nnothing\nC='z'\nA=2\n", {"C": "kept"})
    assert got == {"A": "1", "B": "x=y", "C": "kept"}
    s = Settings.from_mapping({"WHITELIST_DOMAINS": "A.example, b.EXAMPLE", "ADMIN_USER_IDS": "4", "VOTE_MIN_CONFIRMATIONS": "", "OG_FETCH_ENABLED": "off", "REPUTATION_BAN_THRESHOLD": "15"})
    assert s.whitelist_domains == ("a.example", "b.example") and s.audience == (4,) and s.vote_min_confirmations == 3 and not s.preview_enabled and s.low_reputation == 15.0


def test_previews_count_only_if_the_text_lacks_their_link(spark):
    rows = [(1, "see https://a.example/x.", "https://a.example/x"), (2, "see", "https://a.example/x"), (3, "see", ""), (4, "see", None)]
    got = {r.message_id: (r.has_preview, r.preview_link, r.carrier) for r in features(spark.createDataFrame(rows, "message_id long, text string, preview_url string")).collect()}
    assert got == {1: (False, None, True), 2: (True, "https://a.example/x", True), 3: (False, None, False), 4: (False, None, False)}


@pytest.mark.parametrize("url, host", [("www.a.example/x", "a.example"), ("  https://b.example/y。", "b.example"), ("http://[::1]/x", "::1"), ("https://u@p@c.example:80", "c.example"), ("t.me/x", None), ("HTTPS://WWW.D.Example.", "d.example")])
def test_url_domain(spark, url, host):
    assert one(spark, L.url_domain, url) == host


def test_composed_folds_equal_ordered_ones(spark, monkeypatch):
    import random

    monkeypatch.setattr("sluice.operators.folding.BITS", 3)
    g = random.Random(5)
    events = [(i, 1, g.randrange(3), g.choice([8.0, -35.0, 60.0])) for i in range(200)]
    steps = [(i, f"v{g.randrange(4)}", g.choice(["up", "down", "down"]), g.choice(["content", "phrase"]), float(g.randrange(120)), f"s{i}") for i in range(200)]
    score, folds = {}, {}
    for _, c, u, d in events:
        score[c, u] = max(0.0, min(100.0, score.get((c, u), 50.0) + d))
    for _, v, kind, t, w, s in steps:
        if kind == "up":
            old = folds.get(v, (None, 0.0, 0, None))
            folds[v] = (t, max(old[1], min(100.0, w)), old[2], s)
        elif v in folds:
            t0, w0, n, s0 = folds[v]
            folds[v] = (t0, max(0.0, w0 - 30), n + 1, "disabled_false_positive" if n + 1 >= 3 else s0)
    got = state.reputation(spark.createDataFrame(events, "seq long, chat_id long, user_id long, delta double").repartition(5)).collect()
    assert {(r.chat_id, r.user_id): r.reputation_score for r in got} == score
    got = state.fold_feedback(spark.createDataFrame(steps, "seq long, value string, kind string, fingerprint_type string, weight double, source string").repartition(5)).collect()
    assert {r.value: (r.fingerprint_type, r.weight, r.false_positives, r.source) for r in got} == folds


@pytest.mark.parametrize("seed", range(4))
def test_prior_senders_equal_a_plain_count(spark, seed):
    import random

    from sluice.operators.lookup import prior_senders

    g = random.Random(seed)
    rows = [(f"s{g.randrange(2)}", i, g.choice([None, 1, 2, 3, 4]), g.randrange(0, 1500)) for i in range(150)]
    df = spark.createDataFrame(rows, "skeleton_hash string, message_id long, user_id long, created_at long")
    plain = [(m, len({u2 for s2, m2, u2, t2 in rows if s2 == s and (t2, m2) < (t, m) and t2 >= t - 100 and u2 is not None and u2 != u})) for s, m, u, t in rows]
    assert sorted(map(tuple, prior_senders(df, 100).collect())) == sorted(plain)


def test_consecutive_numbers(spark):
    from sluice.operators.effects import numbered

    rows = [(i, (i * 7919) % 50_000) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "k long, at long"), "id", "at", "k", first=10).collect()
    assert {r.k: r.id for r in got} == {k: 10 + i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_tables_go_when_they_are_dropped(spark, tmp_path):
    from sluice.sources.shared import Scratch, written

    scratch = Scratch(spark)
    df = scratch.written(spark.range(10), "x")
    kept = written(df, "y")
    assert df.count() == 10
    scratch.drop()
    assert kept.count() == 10
    with pytest.raises(Exception):
        spark.read.parquet(scratch.path).count()


def test_requests_have_profile_and_preview(spark):
    from sluice.plans import QUERIES

    asked = {r.message_id: r for r in QUERIES["llm_payload"](spark, SF).collect()}
    users = {r.user_id: r.bio for r in relation(spark, SF, "user_profiles").collect()}
    known = {r.url: r.og_title for r in relation(spark, SF, "previews").collect()}
    rows = relation(spark, SF, "messages").collect()
    for m in rows:
        r = asked[m.message_id]
        assert r.bio == users.get(m.user_id) and r.title == known.get((m.preview_url or "").rstrip("."))
    assert any(r.title for r in asked.values())


def batches(spark, parts, path, schema):
    """A stream of the parts, one micro-batch each."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def run_stream(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    return df.sparkSession.table(name).collect()


def test_sessions_end_on_a_stream_as_in_batch(spark, rocks, tmp_path):
    pytest.importorskip("google.protobuf")
    import random

    from sluice.streaming.sources import timed

    g = random.Random(3)
    schema = "session_id long, kind string, what string, voter_user_id long, expires_at long, ts long, seq long"
    opens = [(s, "open", None, None, 1000 + 50 * s + 1800, 1000 + 50 * s, s) for s in range(20)]
    votes = [(g.randrange(20), "vote", g.choice(["spam", "ham", "other"]), g.randrange(6), None, g.randrange(1960, 4200), 100 + i) for i in range(240)]
    closes = [(s, "close", "admin_banned", None, None, 2500 + s, 500 + s) for s in range(0, 20, 6)]
    rows = sorted([*votes, *closes], key=lambda r: (r[5], r[6]))
    parts = [opens, rows[:80], rows[80:160], rows[160:], [(99, "vote", "spam", 1, None, 50_000, 900)], [(99, "vote", "ham", 1, None, 60_000, 901)]]
    settings = Settings()
    got = run_stream(folds.session_ends(timed(batches(spark, parts, str(tmp_path / "in"), schema)), 0, settings), "session_ends", str(tmp_path / "state"))
    sessions = spark.createDataFrame([(r[0], r[4]) for r in opens], "id long, expires_at long")
    ends = sessions.select(F.col("id").alias("session_id"), F.lit("expired_released").alias("status"), state.sweep_time(F.col("expires_at"), 0, settings).alias("at"))
    admin = spark.createDataFrame([(c[0], c[2], c[5]) for c in closes], "session_id long, status string, at long")
    cast = spark.createDataFrame([(v[0], v[3], v[2], v[6], v[5]) for v in votes], "session_id long, voter_user_id long, vote string, seq long, ts long")
    expected = state.close_sessions(sessions, cast, ends.unionByName(admin), settings).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))
    assert {r.status for r in got} == {"confirmed_spam", "released", "expired_released", "admin_banned"}


def test_delayed_deletes_come_when_due(spark, rocks, tmp_path):
    pytest.importorskip("google.protobuf")
    from sluice.streaming.sources import timed

    schema = "chat_id long, message_id long, due_at long, ts long"
    parts = [[(1, 5, 220, 100), (1, 6, 9000, 100)], [(2, 7, 100_000, 5000)], [(2, 8, 100_000, 5001)]]
    got = run_stream(folds.delayed_deletes(timed(batches(spark, parts, str(tmp_path / "in"), schema))), "deletes", str(tmp_path / "state"))
    assert [tuple(r) for r in got] == [("delete", 1, 5, 220)]


def test_bios_are_asked_once(spark, rocks, tmp_path):
    pytest.importorskip("google.protobuf")
    import time

    parts = [[(1, 1), (1, 2), (2, 3)], [(1, 4), (3, 5)]]
    df = folds.bios_to_ask(batches(spark, parts, str(tmp_path / "in"), "user_id long, message_id long"))
    q = df.writeStream.format("memory").queryName("bios").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    end = time.time() + 60  # a query in processing time never runs out of work
    while spark.table("bios").count() < 5 and time.time() < end:
        time.sleep(1)
    q.stop()
    assert sorted((r.message_id, r.ask) for r in spark.table("bios").collect()) == [(1, True), (2, False), (3, True), (4, False), (5, True)]


def test_late_rows_are_kept_apart(spark, tmp_path):
    from sluice.streaming.sources import split_late

    parts = [[(1, 1000)], [(2, 5000), (3, 450)], [(4, 4500), (5, 4300)]]
    stream = batches(spark, parts, str(tmp_path / "in"), "k long, ts long")
    split_late(stream, str(tmp_path / "good"), str(tmp_path / "late"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 2, 3, 4]
    assert [r.k for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [5]


def test_observations_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    from sluice.operators.effects import observations
    from sluice.schemas import TABLES
    from sluice.streaming.sources import message_stream, observe

    rows = relation(spark, SF, "messages").selectExpr("chat_id", "message_id", "user_id", "chat_type", "text", "CAST(NULL AS STRING) AS caption", "CAST(NULL AS ARRAY<STRUCT<type: STRING, url: STRING>>) AS entities", "CAST(NULL AS ARRAY<STRUCT<type: STRING, url: STRING>>) AS caption_entities", "preview_url", "sender_chat_id", "is_automatic_forward", "CAST(NULL AS ARRAY<BIGINT>) AS new_chat_members", "update_type", "created_at")
    assert [f.name for f in rows.schema] == [f.name for f in spark.createDataFrame([], TABLES["messages"]).schema]
    rows.write.parquet(str(tmp_path / "in"))
    observe(message_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = observations(features(rows))
    assert got.count() == rows.count() and got.select(expected.columns).exceptAll(expected).count() == 0
    assert message_stream(spark, str(tmp_path / "in"), edits=False).isStreaming


def test_layouts_are_ddl(spark):
    from sluice.schemas import TABLES

    for ddl in TABLES.values():
        assert spark.createDataFrame([], ddl).columns == [c.split()[0] for c in ddl.replace("STRUCT<type: STRING, url: STRING>", "S").split(", ")]
