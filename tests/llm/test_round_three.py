"""Spelling forms, repaired conversations and token files against plain versions, with odd rows."""

import collections
import functools
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from sluice.llm import conversations, media, pages, spelling, tokenfiles, urls
from sluice.llm.common import Scratch
from sluice.llm.packing import vocabulary
from sluice.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"


def near(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def plain_counts(rows, damage):
    n = collections.Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def plain_forms(n):
    partners = collections.defaultdict(list)
    for w in n:
        for v in n:
            if abs(len(w) - len(v)) < 2 and near(w, v):
                partners[w].append(v)
    form = {}
    for w, some in partners.items():
        best = min(some, key=lambda v: (-n[v], v))
        if n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(partners[w]), n.get(form.get(w))) for w in n}


def forms(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_spelling_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert forms(QUERIES["op11_spelling_forms"](spark, SF)) == plain_forms(plain_counts(docs, 199))


def test_spelling_of_odd_rows(spark):
    """Null keys and texts, repeated rows, letters beyond ASCII, other scripts between letters, long words, chains of forms."""
    long = "ab" * 3000
    texts = ["banana " * 150 + "bananas " * 30 + "bananna " * 29 + "bananass " * 6, None, "", "Ünïcode日ünicode ünicodÉ×÷ " * 5, (long + " ") * 25 + (long[:50] + long[51:] + " ") * 5 + (long[:-1] + "z ") * 5, "aaaaaa " * 5 + "aaaaaaa " * 25, "x1yz "]
    rows = [(k, t, 1, "clash") for k, t in zip([1, 2, 3, None, 5, 5, None], texts, strict=True)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, word string")
    for damage in (None, 3, 199):
        n = plain_counts([r[:2] for r in rows], damage)
        counted = spelling.counted_words(docs, damage=damage)
        assert {r.word: r.n for r in counted.collect()} == n
        assert forms(spelling.spelling_forms(counted)) == plain_forms(n)
    empty = spelling.spelling_forms(spelling.counted_words(docs.limit(0)))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_near_words_of_many_alike(spark):
    """A group of words that all differ in one place, and a word with all its insertions."""
    letters = "abcdefghijklmnopqrstuvwxyzàéÿ"
    words = {f"alpha{c}beta" for c in letters} | {"alphabeta"} | {"alphabeta"[:i] + c + "alphabeta"[i:] for i in range(10) for c in letters}
    n = {w: 5 + 7 * k for k, w in enumerate(sorted(words))}
    counted = spark.createDataFrame([(w, c, 0) for w, c in n.items()], "word string, n long, id int")
    assert forms(spelling.spelling_forms(counted)) == plain_forms(n)


def test_equal_keys_of_different_strings_are_no_candidates_in_the_end(spark, monkeypatch):
    """Were all letters' values one, every word of a length would share its keys; strings decide."""
    n = {w: 5 + 40 * k for k, w in enumerate(["abcdef", "abcdeg", "abcxyz", "abcdeé", "bcdefg", "abcdefg", "zzzzzz"])}
    one = np.ones(256, np.uint64)
    keys = spelling.deletion_keys.__globals__["words"]
    monkeypatch.setattr(keys, "_BYTE", one)
    key, word, place, kind = spelling.deletion_keys(pa.array(sorted(n)))
    rows = [(int(k.view(np.int64)), int(w), int(p), int(t)) for k, w, p, t in zip(key, word, place, kind, strict=True)]
    assert len({r[0] for r in rows if r[3] == spelling.PLACE}) == 13  # six places of six letters, seven of seven
    members = spark.createDataFrame([(k, p, t, sorted(n)[w], n[sorted(n)[w]]) for k, w, p, t in rows], "key long, place int, kind tinyint, word string, n long")
    expected = {w: (len(some), some[0], n[some[0]]) for w in n if (some := sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)))}
    assert {r.word: tuple(r)[1:] for r in spelling.confirmed(members).collect()} == expected
    table = pa.table({n: pa.array(c, t) for n, c, t in zip(("key", "id", "place", "kind"), zip(*sorted(rows), strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int8()), strict=True)})
    whole = [r for b in spelling._candidates(iter(table.to_batches())) for r in b.to_pylist()]
    for size in (1, 2, 7):
        cut = [r for b in spelling._candidates(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert cut == whole


def plain_repair(rows):
    """Digest columns of one conversation's rows after damage, by recursion from the right over whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, fault = set(), []
    for _, r, x in rows:
        solid = re.findall(f"[^{SPACE}]", x)
        fault.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @functools.cache
    def best(i, before, inserted):
        out = [(0, "", ())] if i == len(rows) and before in ("", "a") else []
        more = lambda cost, letter, row, then: out.append((then[0] + cost, letter + then[1], (row, *then[2]) if row else then[2]))
        for role in ("user", "assistant"):
            if inserted < 4 and (before, role[0]) in legal:
                more(3, "I", (role, ""), best(i, role[0], inserted + 1))
        if i < len(rows):
            _, r, x = rows[i]
            more(4, "D", None, best(i + 1, before, 0))
            if fault[i] in (None, "truncated"):
                late = 3 if fault[i] else 0
                for role, cost, letter in ((r, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if (before, role[:1]) in legal:
                        more(cost + late, letter, (role, x), best(i + 1, role[:1], 0))
        return min(out, key=lambda o: o[:2]) if out else (10**9, "", ())

    cost, audit, kept = best(0, "", 0)
    text = "\n".join(f"{r}:{x}" for r, x in kept)
    return gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def plain_damage(rows):
    space = lambda v: " " if v is None else str(v)
    out = collections.defaultdict(list)
    for c, t, r, x in rows:
        out[c]
        way = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        x = "" if way == 1 else re.sub("[.!?]", "", space(x)) if way == 2 else space(x)
        r = "user" if way == 4 else space(r)
        out[c] += [(t, r, x)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def test_conversations_repaired(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, SF).collect()}
    assert got == {c: plain_repair(turns) for c, turns in plain_damage(rows).items()}


def test_repair_of_odd_conversations(spark, tmp_path):
    """Null keys, turns, roles and texts, ties, repeated rows, other roles, clashing columns; rows all dropped; none at all."""
    g = random.Random(5)
    rows = []
    for k in [None, *range(1500)]:
        for _ in range(g.randint(1, 9)):
            role = g.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((k, g.choice([None, *range(6)]), role, g.choice(["ok.", "hi", "  ", "what?\n", "no! ", None, "é", "日。"])))
    schema = "conv_id long, turn long, role string, text string, kind string, n int, edit string"
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    df = QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    expected = {c: plain_repair(turns) for c, turns in plain_damage(rows).items()}
    assert got == expected
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert nothing in got.values()  # a conversation whose rows were all dropped
    empty = spark.createDataFrame([], schema)
    assert conversations.digests(conversations.repair(empty)).collect() == []


def test_repair_of_a_hot_conversation(spark):
    """One conversation with a third of all rows, in many batches; its edits give a conversation that alternates."""
    hot = [(7, k, ("user", "assistant", "tool", "user")[k % 4], f"text {k}{'.' * (k % 3)}") for k in range(30_000)]
    hot += [(7, 40_000 + k, "tool", "  ") for k in range(5_000)]  # a run that only deletions fit
    rest = [(100 + k // 4, k % 4, ("user", "assistant")[k % 2], f"{k}.") for k in range(60_000)]
    edits = conversations.repair(spark.createDataFrame(hot + rest, "conv_id long, turn long, role string, text string"))
    own = edits.where("conv_id = 7").orderBy("place").collect()
    assert [r.turn for r in own if r.edit != "I"] == [r[1] for r in hot]
    assert re.fullmatch("(ua)+", "".join(r.role[0] for r in own if r.edit != "D"))
    assert edits.where("conv_id <> 7 AND edit <> 'K'").isEmpty() and edits.where("conv_id <> 7").count() == 60_000
    # The layers' costs stay near each other, so the table of steps is small however long the conversation.
    layer, seen = conversations.START, set()
    for k in range(3000):
        layer = conversations.step(layer, "sua?"[k * k % 4], k % 3 == 0, k % 5 == 0)[0]
        seen.add(layer)
    assert len(seen) < 100


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def plain_tokens(rows, tokenizer):
    out, start = [], 0
    for k, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_token_files_of_documents(spark, tokenizer):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in QUERIES["op13_token_files"](spark, SF).collect())
    assert got == [r[:4] for r in plain_tokens(docs, tokenizer)]


def test_token_files_of_odd_rows(spark, tokenizer, tmp_path, monkeypatch):
    """Null and repeated keys and texts, negative keys, a long text, several files a task, other columns; single documents; damage."""
    rows = [(3, "a b c"), (None, "null key"), (1, None), (2, ""), (5, "x " * 9000), (5, "x " * 9000), (-4, "Ünï 日本 🙂"), (9, "<|endoftext|> don't"), (5, "again"), (None, None)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, path string")
    dictionary = tokenfiles.dictionary_of(docs)
    assert dictionary
    for ranges in (1, 5):
        scratch = Scratch(spark)
        folder = f"{scratch.path}/tokens"
        manifest = scratch.written(tokenfiles.write_files(docs, folder, dictionary, ranges=ranges), "manifest")
        files = tokenfiles.with_starts(manifest)
        got = sorted((tuple(r) for r in tokenfiles.read_files(files, dictionary, with_ids=True).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
        assert got[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
        expected = collections.Counter((r[0], r[2], r[3], tuple(r[4])) for r in plain_tokens(rows, tokenizer))
        assert collections.Counter((r[0], r[2], r[3], tuple(r[4])) for r in got) == expected
    path = manifest.where("docs > 1").first().path
    reader = tokenfiles.Reader(path, dictionary)
    assert [ids.tolist() for _, _, ids in reader] == [reader.document(i).tolist() for i in range(reader.n)]
    key = int(reader.keys[-1])
    assert reader.find(key) is not None and reader.find(10**9) is None
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfiles.Reader(path, b"other")
    system, at = pyarrow.fs.FileSystem.from_uri(path)
    raw = system.open_input_file(at).read()
    broken = tmp_path / "broken.tok"
    for cut in (raw[:-1], raw[1:], raw[:60], b""):
        broken.write_bytes(cut)
        with pytest.raises(ValueError):
            tokenfiles.Reader(str(broken), dictionary)
    none = tokenfiles.write_files(docs.limit(0), folder, b"")
    assert none.collect() == [] and tokenfiles.dictionary_of(docs.limit(0)) == tokenfiles.train_dictionary([])


def test_token_files_of_one_hot_key(spark, tmp_path, monkeypatch):
    """A third of all rows with one key: they lie in several ranges, files end at their limits, and starts stay gapless."""
    docs = spark.range(9000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    writer = tokenfiles.Writer(str(tmp_path / "one.tok"), b"", "<u4")
    monkeypatch.setattr(tokenfiles, "FILE_DOCS", 2)
    for k in range(2):
        assert not writer.full
        writer.add(k, np.arange(5))
    assert writer.full and writer.close()[1:3] == (2, 10)
    scratch = Scratch(spark)
    manifest = scratch.written(tokenfiles.write_files(docs, f"{scratch.path}/tokens", b"", ranges=6), "manifest")
    assert manifest.agg({"docs": "max"}).first()[0] < 3000
    got = sorted(tuple(r) for r in tokenfiles.read_files(tokenfiles.with_starts(manifest), b"").select("start", "n_tokens", "doc_id").collect())
    assert len(got) == 9000 and got[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert [r[2] for r in got] == sorted(r[2] for r in got)


#: Pages that parsers fail on or are slow with; each a few hundred thousand characters.
NASTY = {
    "sections": "<![foo[x]]>a<p>b" * 20_000, "unmatched": "<p>" + "<b>" * 80_000 + "</i>" * 80_000, "outside": "<i><article>" + "<b>" * 80_000 + "</i>" * 80_000 + "x",
    "blocks": "<b>" * 80_000 + "<hr>x" * 80_000, "items": "<ul>" + "<b>" * 80_000 + "<li>y" * 80_000, "deep": "<div>" * 150_000 + "z",
    "comments": "<!-- >" * 100_000, "open": "<!--" * 200_000, "tags": "<a " * 200_000, "declared": "<!" * 300_000, "conditions": "<![if x>" * 100_000, "quotes": "<a x=' >" * 100_000,
}


@pytest.mark.parametrize("name", sorted(NASTY))
def test_nasty_pages_end_in_seconds(name):
    start = time.perf_counter()
    for end in ("", ">", "<p>last words"):
        pages.extract(NASTY[name] + end)
    assert time.perf_counter() - start < 30


def test_unknown_sections_are_comments(spark):
    html = "<body><article><p>one<![foo[x]]> two</p><![endif]--><p>three</article><![bar["
    assert pages.extract(html) == "one two\nthree"
    rows = spark.createDataFrame([(1, "http://a.example/x", html), (2, None, None), (3, "http://a.example/y", NASTY["sections"])], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in pages.extract_pages(rows).collect()}
    assert found[1] == "one two\nthree" and found[2] == "" and found[3].startswith("a\nb")


def test_long_hosts_have_few_keys(spark):
    host = "a." * 500_000
    assert len(urls.candidate_keys(f"{host}example.net", "/en/x", (0, 4), 2, 11)) <= 6
    rows = [(1, f"http://{host}example.net/en/x"), (2, "http://" + "b" * 1_000_000), (3, f"http://{host}example.org/fr/")]
    found = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert found == {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: ("org/fr/", "allow")}


def test_images_with_huge_numbers(spark):
    rows = [(1, b"P5 99999999999999999999 1 255\n\x00"), (2, b"P2 1 1 255\n99999999999999999999999"), (3, b"P6 " + b"9" * 6000 + b" 1 255\n"), (4, b"P2 1 1 255\n-1"), (5, b"P5 1 1 255\n\x07"), (5, b"P5 1 1 255\n\x07"), (6, b"P4 99999999999 99999999999\n")]
    df = spark.createDataFrame([(k, bytearray(m), "clash") for k, m in rows], "key long, media binary, tile string")
    got = media.media_tiles(df, "key", "media").collect()
    assert sorted((r.key, r.error is None) for r in got) == [(1, False), (2, False), (3, False), (4, False), (5, True), (5, True), (6, False)]
    assert media.media_tiles(df.limit(0), "key", "media").collect() == []


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    """The whole pipeline through `run`, and stages over columns with dots, backticks and clashing names."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumn("a.b", docs.doc_id).withColumn("c`d", docs.lang).withColumn("score", docs.lang).withColumn("Key", docs.lang)
    for _, stage in corpus_pipeline.STAGES[:3]:
        odd = stage(spark, odd, SF)
        assert odd.columns == [*docs.columns, "a.b", "c`d", "score", "Key"]
    assert odd.where("`a.b` <> doc_id").isEmpty() and odd.count() > 100
    packed = corpus_pipeline.run(spark, SF)
    pieces = packed.collect()
    by_sequence = collections.defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for rows in by_sequence.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096
    # The same documents as the stages by hand, cut and packed.
    assert {r.doc_id for r in pieces} == {r.doc_id for r in odd.select("doc_id").collect()}


def plain_menus(rows, least=3, share=0.3):
    """Texts of pages of `div`s that are lists of links or paragraphs, and perhaps an article: a list goes if its number of links recurs on enough distinct pages of its host."""
    distinct = set(rows)
    pages_of = collections.Counter(h for h, _, _ in distinct)
    counts = collections.Counter((h, n) for h, blocks, _ in distinct for n in {len(b) for b in blocks if isinstance(b, tuple)})
    out = []
    for host, blocks, article in rows:
        rest = []
        for b in blocks:
            if isinstance(b, str):
                rest.append(b)
            elif not (len(b) >= 3 and counts[host, len(b)] >= least and counts[host, len(b)] >= share * pages_of[host]):
                rest.append("".join(b))
        out.append(article or "\n".join(rest))
    return out


def test_shapes_tell_menus_whose_words_differ(spark):
    """Neither tags nor classes decide these pages: menus are `div`s of links with words of their own on each page."""
    g = random.Random(4)
    word = lambda: f"w{g.randrange(10**9)}"
    rows = []
    for host, n in (("a.example", 30), ("b.example", 20), ("c.example", 2)):
        for k in range(n):
            menu = tuple(word() for _ in range(4 if g.random() < 0.8 else 5 + k))
            few = tuple(word() for _ in range(2))  # two links are no menu, however often they recur
            blocks = [menu, word(), few, word()]
            g.shuffle(blocks)
            rows.append((host, tuple(blocks), g.choice([None, None, "", word()])))
    html = lambda blocks: "".join(f"<div>{b}</div>" if isinstance(b, str) else "<div>" + "".join(f"<a>{w}</a>" for w in b) + "</div>" for b in blocks)
    table = [(k, f"http://{h}/{k}", f"<body>{html(blocks)}{'' if a is None else f'<article>{a}</article>'}</body>") for k, (h, blocks, a) in enumerate(rows)]
    got = {r.page_id: r for r in pages.extract_pages(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    assert [got[k].text for k in range(len(rows))] == plain_menus(rows)
    assert sum(r.n_template > 0 for r in got.values()) > 30


def test_template_of_registered_query(spark):
    """The registered query: something recurs on every page, and no page's text differs from that without any template."""
    rows = QUERIES["op5_template_extract"](spark, SF).collect()
    html = {r.page_id: r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(html) and sum(r.n_template > 0 for r in rows) > 5  # few hosts of so small a table have three pages
    assert all(r.text == pages.extract(html[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_shards_with_many_empty_texts(spark, monkeypatch):
    """Nine of ten rows are empty texts that weigh next to nothing: their group is dealt as a large one, not joined by its text."""
    from sluice.llm import sharding

    driver = []
    deal = sharding.longest_first
    monkeypatch.setattr(sharding, "longest_first", lambda sizes, loads: driver.append(list(sizes)) or deal(sizes, loads))
    docs = spark.range(1000).selectExpr("id AS doc_id", "IF(id % 10 = 0, concat(id, repeat('x', 300000)), IF(id % 20 = 1, NULL, '')) AS text", "id AS size")
    rows = sharding.shard(docs).collect()
    light = 900 * 16
    assert light in driver[0] and light < sum(r.size for r in rows) / (sharding.SHARDS * sharding.LARGE)
    empty = {r.shard for r in rows if r.size == 16}
    assert len(empty) == 1 and sum(r.size == 16 for r in rows) == 900
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    loads = collections.Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 300_100 + light
