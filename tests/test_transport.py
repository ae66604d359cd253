"""Scorers over HTTP, against a server of our own."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sluice.operators import lookup, scoring, transport
from sluice.operators.features import features
from sluice.settings import Settings

SPAM = '{"is_spam": true, "confidence": 0.9, "category": "ads", "signal_phrases": ["x"]}'


class Server(ThreadingHTTPServer):
    daemon_threads = True

    def __init__(self, answer):
        self.answer, self.seen, self.busy, self.most, self.lock = answer, [], 0, 0, threading.Lock()
        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_port}"


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):  # noqa: N802
        server = self.server
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with server.lock:
            server.seen.append((self.path, self.headers["Authorization"], asked))
            server.busy += 1
            server.most = max(server.most, server.busy)
        try:
            status, reply = server.answer(asked)
            self.send_response(status)
            self.end_headers()
            for piece in [reply] if isinstance(reply, bytes) else reply:
                self.wfile.write(piece)
                self.wfile.flush()
        except OSError:
            pass
        finally:
            with server.lock:
                server.busy -= 1

    def log_message(self, *args):
        pass


def completion(text):
    return json.dumps({"choices": [{"message": {"role": "assistant", "content": text}}]}).encode()


def slow_bytes():
    for _ in range(50):
        time.sleep(0.1)
        yield b" "


@pytest.fixture
def serve():
    servers = []

    def start(answer):
        servers.append(Server(answer))
        return servers[-1]

    yield start
    for s in servers:
        s.shutdown()
        s.server_close()


@pytest.fixture(scope="module")
def rows(spark):
    sent = [(k, 1, k, f"message {k}", None, "message", 1000 + k) for k in range(12)]
    df = features(spark.createDataFrame(sent, "message_id long, chat_id long, user_id long, text string, preview_url string, update_type string, created_at long").coalesce(1))
    profiles = spark.createDataFrame([(3, "promo_agent", "成人", "客服", "看片加群")], "user_id long, username string, first_name string, last_name string, bio string")
    previews = spark.createDataFrame([], "url string, og_title string")
    known = lookup.with_preview(lookup.with_profile(df, profiles), previews)
    return known.withColumns({"reputation_score": F.lit(50.0), "scorer": F.col("message_id") < 10})


def named(*servers, **more):
    return Settings(scorer_urls=tuple(s if isinstance(s, str) else s.url for s in servers), scorer_keys=tuple(f"key-{k}" for k in range(len(servers))), scorer_models=tuple(f"model-{k}" for k in range(len(servers))), **more)


def outcomes(rows, settings, at_once=4):
    return {r.message_id: r for r in scoring.score(rows, transport.scorers(settings, at_once)).collect()}


def test_request_has_prompt_model_key_and_profile(rows, serve):
    server = serve(lambda asked: (200, completion(SPAM)))
    got = outcomes(rows, named(server, scorer_temperature=0.5, scorer_max_tokens=77))
    assert set(got) == set(range(10)) and all(r.status == "ok" and r.is_spam and r.category == "ads" and r.error is None for r in got.values())
    assert len(server.seen) == 10
    for path, key, asked in server.seen:
        assert path == "/v1/chat/completions" and key == "Bearer key-0" and asked["model"] == "model-0" and asked["temperature"] == 0.5 and asked["max_tokens"] == 77
        assert asked["response_format"] == {"type": "json_object"} and [m["role"] for m in asked["messages"]] == ["system", "user"] and asked["messages"][0]["content"] == transport.PROMPT
    sent = {json.loads(a["messages"][1]["content"])["raw_text"]: json.loads(a["messages"][1]["content"]) for _, _, a in server.seen}
    assert sent["message 3"]["sender_profile"] == {"user_id": 3, "username": "promo_agent", "display_name": "成人 客服", "first_name": "成人", "last_name": "客服", "bio": "看片加群"} and sent["message 4"]["sender_profile"] is None


def test_next_provider_is_asked_for_what_the_first_fails(rows, serve):
    number = lambda asked: int(json.loads(asked["messages"][1]["content"])["raw_text"].split()[1])
    replies = {0: (500, b"no"), 1: (200, completion("")), 2: (200, completion("no json")), 3: (200, b"<html>"), 4: (200, completion('{"is_spam": "yes", "confidence": 1}')), 5: (200, completion('{"is_spam": true, "confidence": NaN}'))}
    first = serve(lambda asked: replies.get(number(asked), (200, completion(SPAM))))
    second = serve(lambda asked: (200, json.dumps({"choices": [{"text": '{"is_spam": false, "confidence": 0.2}'}]}).encode()))
    got = outcomes(rows, named(first, second))
    assert all(r.status == "ok" and r.provider_count == 2 and r.error is None for r in got.values())
    assert {k for k, r in got.items() if not r.is_spam} == set(range(6)) == {number(a) for _, _, a in second.seen}
    assert {k for _, k, _ in second.seen} == {"Bearer key-1"}
    # Without the second, the first one's reasons stay.
    got = outcomes(rows, named(first))
    why = {k: r.error for k, r in got.items()}
    assert why[0].startswith("api_error after") and why[0].endswith("status 500") and why[1] == "empty content" and why[2].startswith("parse_error") and why[3].startswith("api_error") and why[4].startswith("parse_error") and why[5].startswith("parse_error")
    assert all(r.status == ("failed" if k < 6 else "ok") and (r.error is None) == (k >= 6) for k, r in got.items())


def test_all_providers_fail(rows, serve):
    dead = serve(lambda asked: (200, b""))
    dead.shutdown()
    dead.server_close()
    got = outcomes(rows, named("http://127.0.0.1:9", dead))
    assert all(r.status == "failed" and r.provider_count == 2 and r.is_spam is None and "connection_error after" in r.error for r in got.values())


def test_time_limit_holds_for_slow_answers_and_slow_bytes(rows, serve):
    def answer(asked):
        if "message 1" in asked["messages"][1]["content"]:
            return 200, slow_bytes()
        time.sleep(2)
        return 200, completion(SPAM)

    start = time.monotonic()
    got = outcomes(rows.where("message_id < 4"), named(serve(answer), scorer_timeout_seconds=0.5))
    assert time.monotonic() - start < 15
    assert all(r.status == "failed" and r.error.startswith("timeout after 0.") and "limit 0.5s" in r.error for r in got.values())


def test_so_many_at_once_and_no_more(rows, serve):
    def answer(asked):
        time.sleep(0.2)
        return 200, completion(SPAM)

    server = serve(answer)
    assert all(r.status == "ok" for r in outcomes(rows, named(server), at_once=5).values())
    assert 2 <= server.most <= 5


def test_no_provider_is_disabled(rows):
    assert {r.status for r in scoring.score(rows, transport.scorers(Settings())).collect()} == {"disabled"}
