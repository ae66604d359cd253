"""Operators against plain versions, round trips and held-out accuracy, on small inputs with odd rows."""

import collections
import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import chunks, components, dedup, media, mixing, ngrams, packing, pages, sharding, toxicity, urls, words
from sluice.llm.queries import QUERIES, SQL

from ..oracle import compare

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c"), (2, None), (3, ""), (4, "a b c"), (None, "x y"), (5, "Ünï \t cödé 日本 🙂"), (5, "z"), (6, "w " * 5000), (7, " \n "), (8, "A B C"), (9, "<|endoftext|> don't"), (10, "a\x00b")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", s, 0, "clash") for (k, t), s in zip(ODD, ["s1", "s2", None, "s1"] * 3, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def split(text):
    return re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, SF, QUERIES[name], SQL[name])


def test_words_and_shingles():
    texts = [t for _, t in ODD]
    hashes, at = words.word_hashes(pa.array(texts, pa.string()))
    assert np.diff(at).tolist() == [len(split(t)) for t in texts]
    seen = {}
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        for w, h in zip(split(text), hashes[a:b].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    sets, at = words.shingle_sets(pa.array(texts, pa.string()), 2)
    for text, n in zip(texts, np.diff(at), strict=True):
        w = split(text)
        assert n == len(set(zip(w, w[1:], strict=False))) if len(w) > 1 else n == len(w)
    assert len(words.shingle_sets(pa.array([], pa.string()), 2)[0]) == 0


def test_images_survive_a_round_trip():
    g = np.random.default_rng(1)
    for shape in ((1, 1), (3, 5), (7, 64), (4, 3, 3)):
        image = g.integers(0, 256, shape, dtype=np.uint8)
        for encode in (media.encode_netpbm, media.encode_bmp):
            assert (media.decode(encode(image)) == image).all()
        assert (np.load(io.BytesIO(media.npy_bytes(image))) == image).all()
    assert media.decode(b"P1 # c\n2 1\n1 0").tolist() == [[0, 255]]
    assert media.decode(b"P2\n2 1\n15\n0 15").tolist() == [[0, 255]]
    image = g.integers(0, 256, (8, 12), dtype=np.uint8)
    assert np.abs(media.area_resize(image, 4, 6) - image.reshape(4, 2, 6, 2).mean((1, 3))).max() <= 0.5
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_media_of_texts(spark, odd):
    got = {(r.doc_id, r.payload_sha256) for r in media.text_media(odd).collect()}
    expected = set()
    for k, t in ODD:
        raw = (t or "").encode()
        raw += bytes(-len(raw) % 64 or (0 if raw else 64))
        expected.add((k, hashlib.sha256(raw).hexdigest()))
    assert got == expected
    broken = spark.createDataFrame([(1, None), (2, b"P5"), (3, b"P5 1 1 255\n\x07")], "id long, media binary")
    rows = {r.id: r for r in media.media_tiles(broken, "id", "media").collect()}
    assert rows[1].error and rows[2].error and rows[3].height == 1 and rows[3].error is None


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_a_plain_model(spark, odd, order):
    import math

    k_ = 5.0
    got = sorted(map(tuple, ngrams.score(odd, order=order, prior=k_).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    counts, n, plain = collections.Counter(), 0, []
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in ODD]
    for (_, t), h in zip(ODD, held, strict=True):
        w = ["^", *split(t), "$"]
        if not h:
            n += len(w) - 1
            counts.update(tuple(w[i : i + m]) for m in range(1, order + 1) for i in range(len(w) - m + 1))
    v = sum(len(x) == 1 and x != ("^",) for x in counts)
    for (key, t), h in zip(ODD, held, strict=True):
        w, base, score = ["^", *split(t), "$"], 0.0, 0.0
        for i in range(1, len(w)):
            p = (counts[w[i],] + 1) / (n + v + 1)
            base += math.log10(p)
            for m in range(1, min(order, i + 1)):
                context = tuple(w[i - m : i])
                if counts[context]:
                    p = (counts[*context, w[i]] + k_ * p) / (counts[context] + k_)
            score += math.log10(p)
        plain.append((key, h, len(w) - 1, sum(counts[x,] > 0 for x in w[1:]), n, base, score))
    for a, b in zip(got, sorted(plain, key=str), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def plain_components(rows, width, percent=80):
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    parent = {k: k for k, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k, _ in rows}


@pytest.mark.parametrize("tile", [3, 2048])
def test_near_duplicates_equal_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(dedup, "TILE", tile)
    g = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):  # a large group at all distances around the threshold, and smaller ones
        base = [g.choice(vocabulary) for _ in range(60)]
        for _ in range(g.choice([2, 5, 40])):
            text = list(base)
            for _ in range(g.choice([0, 1, 2, 3, 4, 5])):
                text[g.randrange(60)] = g.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    rows += [(1000, "one"), (1001, "one"), (1002, ""), (1003, None), (1004, "ONE")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in dedup.near_duplicates(df, width=2).collect()}
    expected = plain_components(rows, 2)
    assert got == {k: (c, k == c) for k, c in expected.items()}


def test_near_duplicates_odd_rows(spark, odd):
    assert dedup.near_duplicates(odd).count() == len(ODD)
    assert dedup.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_encoder_equals_the_tokenizer():
    g = random.Random(1)
    letters = list("ab'sdt.,!?12 \n\té̸́=<|>ſΣ…·'’ـ日 ")
    texts = [t or "" for _, t in ODD] + ["".join(g.choice(letters) for _ in range(g.randint(0, 30))) for _ in range(3000)]
    encode = packing.Encoder(packing.vocabulary())
    got = [ids[a:b].tolist() for ids, at in encode(pa.array(texts)) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]


def plain_best_fit(lengths, length):
    rooms, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [k for k, r in enumerate(rooms) if r >= lengths[i]]
        k = min(fits, key=rooms.__getitem__) if fits else len(rooms)
        if not fits:
            rooms.append(length)
        rooms[k] -= lengths[i]
        out[i] = k
    return len(rooms)


def test_best_fit():
    g = random.Random(2)
    for _ in range(50):
        lengths = [g.randint(1, 64) for _ in range(g.randint(0, 80))]
        sequence, offset = packing.best_fit(lengths, 64)
        assert len(set(sequence)) == plain_best_fit(lengths, 64)
        for s in set(sequence):
            at = 0
            for o, n in sorted((offset[i], lengths[i]) for i in range(len(lengths)) if sequence[i] == s):
                assert o == at
                at += n
            assert at <= 64


def test_pieces_of_odd_rows(spark, odd):
    rows = packing.packed(odd, with_ids=True, length=16).collect()
    whole = collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        whole[r.doc_id, r.piece].append(r.ids)
    assert {k for k, _ in whole} == {k for k, _ in ODD} and whole[3, 0] == [[1]] and len(whole[5, 0]) == 2
    assert packing.packed(odd.limit(0)).count() == 0


PAGE = """<html><head><title>t</title></head><body><header>site</header><nav><ul><li>home<li>more</ul></nav><div class="box">Our newsletter is great</div>
<article><header><h1>T&amp;C</h1></header><p>One  two<br>three<p>Four<div class="tools">Print this page</div><ul><li>a<li>b</ul><aside>x</aside><section class="comments">bad</section><script>1</script></article><footer>f</footer></body></html>"""


def test_extraction():
    assert pages.extract(PAGE) == "T&C\nOne two three\nFour\nPrint this page\na\nb"
    assert pages.extract("") == "" and pages.extract("plain <b>text</b> &lt;") == "plain text <" and pages.extract("<nav>x</nav>") == ""


def test_templates_go(spark):
    def page(i):
        return f"<body><div class='box'>Our letter is great</div><div>own {i}</div></body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(50, "http://other.example/1", page(50)), (51, None, None), (52, "x", "")]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"own {i}" for i in range(12)}, 50: "Our letter is great\nown 50", 51: "", 52: ""}


def test_copies_are_no_template_and_a_share_is(spark):
    def page(own, box=""):
        return f"<body>{box}<div class='text'>{own}</div></body>"

    box = "<div class='box'>Our letter is great</div>"
    rows = [("http://one.example/a", page("repeated row"))] * 12  # the same row again and again
    rows += [(f"http://one.example/{i}", page("mirrored")) for i in range(12)]  # one page under many urls
    rows += [(f"http://small.example/{i}", page(f"small {i}", box)) for i in range(4)]
    rows += [(f"http://large.example/{i}", page(f"large {i}", box if i < 12 else "")) for i in range(100)]
    got = pages.extract_pages(spark.createDataFrame(rows, "url string, html string")).collect()
    texts = collections.Counter(r.text for r in got)
    assert texts["repeated row"] == 12 and texts["mirrored"] == 12
    assert all(texts[f"small {i}"] == 1 for i in range(4))
    assert all(texts[f"Our letter is great\nlarge {i}" if i < 12 else f"large {i}"] == 1 for i in range(100))


def test_notices_within_articles_go_and_shared_passages_stay(spark):
    def page(i):
        shared = "<p>A passage of several articles" if i < 8 else ""
        return f"<body><article><h1>Title {i}</h1><p>own {i}{shared}<p>Write to us for more<ul><li>Follow<li>Subscribe</ul></article></body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(20)]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nown {i}" + ("\nA passage of several articles" if i < 8 else "") for i in range(20)}


def plain_templates(rows, least=3, share=0.3, least_within=10, share_within=0.8):
    """Texts without recurring subtrees, by comparing serialised subtrees of pages with one another."""
    import html.parser

    class Tree(html.parser.HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.root = self.at = ["#", [], None]
            self.feed(page)
            self.close()

        def handle_starttag(self, tag, attrs):
            self.at[1].append([tag, [], self.at])
            self.at = self.at[1][-1]

        def handle_endtag(self, tag):
            self.at = self.at[2]

        def handle_data(self, data):
            self.at[1].append(data)

    def shape(node):
        return node if isinstance(node, str) else (node[0], *map(shape, node[1]))

    def subtrees(node, inside=False):
        for c in node[1]:
            if not isinstance(c, str):
                yield c, inside and c[0] == "p"
                yield from subtrees(c, inside or c[0] == "article")

    trees = [Tree(page).root for _, page in rows]
    distinct = {}
    for (host, _), tree in zip(rows, trees, strict=True):
        distinct.setdefault((host, shape(tree)), tree)
    counts, pages_of = collections.Counter(), collections.Counter(h for h, _ in distinct)
    for (host, _), tree in distinct.items():
        counts.update({(host, shape(c), w) for c, w in subtrees(tree) if c[0] not in ("body", "article")})

    def text(node, host, inside=False):
        out = []
        for c in node[1]:
            if isinstance(c, str):
                out.append(c)
                continue
            within = inside and c[0] == "p"
            n = counts[host, shape(c), within]
            if n >= (least_within if within else least) and n >= (share_within if within else share) * pages_of[host]:
                continue
            out += text(c, host, inside or c[0] == "article")
        return out

    return ["\n".join(text(t, h)) for (h, _), t in zip(rows, trees, strict=True)]


@pytest.mark.parametrize("most_marks", [10**6, 0])
def test_recurrence_alone_tells_the_template(spark, most_marks):
    g = random.Random(8)
    word = lambda: g.choice("alpha beta gamma delta".split()) + str(g.randrange(10**6))
    rows = []
    for host, n in (("a.example", 40), ("b.example", 12), ("c.example", 2)):
        parts = [f"<div>{word()}</div>" for _ in range(3)] + [f"<section><p>{word()}</p><p>{word()}</p></section>"]
        shared = [f"<p>{word()}</p>" for _ in range(2)]
        for _ in range(n):
            body = "".join(p for p in parts if g.random() < 0.7) + "".join(f"<div><p>{word()}</p></div>" for _ in range(2))
            if g.random() < 0.5:
                body += "<article>" + "".join(f"<p>{word()}</p>" for _ in range(2)) + shared[0] + (shared[1] if g.random() < 0.3 else "") + "</article>"
                body = body[body.index("<article>") :]
            rows.append((host, f"<body>{body}</body>"))
    rows += [rows[0]] * 5
    df = spark.createDataFrame([(i, f"http://{h}/{i}", page, "kept", -1) for i, (h, page) in enumerate(rows)], "page_id long, url string, html string, site string, n_chars int")
    out = pages.extract_pages(df, most_marks=most_marks)
    assert sorted(out.columns) == ["html", "n_chars", "n_template", "page_id", "site", "text", "url"]
    got = {r.page_id: r for r in out.collect()}
    assert [got[i].text for i in range(len(rows))] == plain_templates(rows)
    assert sum(r.n_template > 0 for r in got.values()) > 20 and all(r.site == "kept" and r.n_chars == len(r.text) for r in got.values())


def test_no_pages(spark):
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_cascade_is_exact(spark):
    universe = [f"k{i}" for i in range(3000)]
    listed = {f"k{i}" for i in range(0, 3000, 7)} | {"absent"}
    cascade = urls.build_cascade(spark.createDataFrame([(k,) for k in universe], "key string"), listed)
    assert all((k in cascade) == (k in listed) for k in universe) and len(cascade.levels) > 1
    assert "k1" not in urls.build_cascade(spark.createDataFrame([("k1",)], "key string"), [])


def test_odd_urls(spark):
    rows = [(1, None), (2, "no"), (3, "http://"), (4, "HTTP://WWW.Casino-Win.example.org?x"), (5, "http://a.example.net/en/x#y"), (6, "x://net/"), (7, "http://example.org/fr/")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: (None, "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "block"), 5: ("example.net/en/", "allow"), 6: ("net/", "block"), 7: ("org/fr/", "allow")}


def test_chunks_shift():
    g = random.Random(3)
    text = "".join(g.choice("abcdefgh ") for _ in range(5000))
    a, b, c = chunks.chunk_sets(pa.array([text, "shifted" + text, text[::-1]]))
    assert chunks.containment(a, b) > 0.95 and chunks.containment(a, c) < 0.05 and chunks.containment(a, a) == 1
    alone = chunks.chunk_sets(pa.array([text]))[0]
    assert chunks.fingerprint(alone) == chunks.fingerprint(a)
    assert sum(n for n in chunks.chunk_sets(pa.array(["short"]))[0][1]) == 5


def test_fingerprints_follow_the_order_of_keys(spark, odd):
    rows = sorted(((k, t or "") for k, t in ODD), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in chunks.fingerprints(odd).collect())
    expected = [(k is not None, k or 0, len(t), chunks.sha_hex(chunks.edit_tail(t, rows[(i + 1) % len(rows)][1]))) for i, (k, t) in enumerate(rows)]
    assert got == sorted(expected)
    assert chunks.fingerprints(odd.limit(0)).count() == 0


def test_mix_meets_targets(spark, odd):
    rows = mixing.plan(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = collections.defaultdict(int)
    for r in rows:
        by[r.source_size, r.target] += r.taken
    assert all(abs(n - target) <= 1 for (_, target), n in by.items())
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert sum(len(split(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mixed(odd.limit(0)).count() == 0


def test_longest_first():
    loads = [0.0] * 3
    assert longest(loads) == [0, 1, 2, 2, 1] and sorted(loads) == [6, 6, 7]


def longest(loads):
    return sharding.longest_first([7, 5, 4, 2, 1], loads)


def test_shards_keep_equal_texts_together(spark, odd):
    rows = sharding.shard(odd, shards=3).collect()
    assert len(rows) == len(ODD)
    for s in range(3):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    where = collections.defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert sharding.shard(odd.limit(0)).count() == 0


def made_up(n, seed):
    g = random.Random(seed)
    bad = ["grumbex", "vilkorn", "snarfel"]
    texts, toxic = [], []
    for i in range(n):
        w = [g.choice("the of and moon tree river stone cloud paper light".split()) for _ in range(g.randint(5, 200))]
        if i % 4 == 0:
            w[g.randrange(len(w))] = g.choice(bad)
        texts.append(" ".join(w))
        toxic.append(i % 4 == 0)
    return texts, np.array(toxic)


def test_network_learns_and_its_gradients_are_right():
    texts, toxic = made_up(300, 1)
    net = toxicity.train(texts, toxic)
    texts, toxic = made_up(200, 2)
    found = []
    for data, at in words.blocks(pa.array(texts, pa.large_string())):
        value, _, w = net.best_windows(toxicity.tokens(data, at))
        found += (np.maximum.reduceat(value, w[:-1]) > 0).tolist()
    assert (np.array(found) == toxic).mean() > 0.95
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, at = words.text_bytes(pa.array(["a b c d", "e f"]))
    t = toxicity.tokens(data, at)
    index = net.index(t, toxicity.windows(t.offsets)[0])
    g = np.random.default_rng(3)
    vectors = np.vstack([g.standard_normal((len(t.word), toxicity.INPUT)), np.zeros((1, toxicity.INPUT))])
    _, saved = net.forward(vectors, index, keep=True)
    grads, dvectors = net.backward(vectors, index, saved, np.array([1.0, -0.5]))
    loss = lambda: float(net.forward(vectors, index)[0] @ np.array([1.0, -0.5]))
    for name in ("Wf", "Ub", "A", "a", "v"):
        p = net.p[name]
        at = tuple(0 for _ in p.shape)
        keep, p[at] = p[at], p[at] + 1e-3
        up = loss()
        p[at] = keep - 1e-3
        down = loss()
        p[at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)
    assert dvectors.shape == vectors.shape


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (3, 1), (6, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.with_scores(odd, toxicity.fit(odd, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.with_scores(odd.limit(0), toxicity.fit(odd.limit(0), labels)).count() == 0


def test_pipeline(spark, odd):
    import corpus_pipeline

    names = {"key": 77, "turn": 78, "place": 79, "toxicity": 80, "_key": 81, "row": 82, "name": 83, "block": 84}
    docs = odd.select("*", *(F.lit(v).alias(k) for k, v in names.items()))
    columns, sizes = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        rows = docs.collect()
        assert all(r[k] == v for r in rows for k, v in names.items()) and all(r.score == "clash" for r in rows)
        sizes.append(len(rows))
    assert sizes[1] < sizes[0]
    assert corpus_pipeline.STAGES[3][1](spark, docs, SF).select(F.sum("length")).first()[0] >= sizes[2]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_one_document_of_each_group_stays(spark):
    import corpus_pipeline

    g = random.Random(12)
    rows = []
    for _ in range(12):
        base = [f"w{g.randrange(5000)}" for _ in range(80)]
        for _ in range(g.choice([1, 2, 6])):
            text = list(base)
            for _ in range(g.choice([0, 0, 1, 2, 3])):
                text[g.randrange(80)] = f"z{g.randrange(5000)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(500, rows[0][1]), (500, "words of its own that nothing else has at all"), (501, None), (502, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(spark.createDataFrame([(None, "no id here but these few words", "en", "s", 0)] * 3, docs.schema))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    plain = plain_components(rows[:-4], 5)
    expected = sorted(k for k, c in plain.items() if k == c)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [*expected, 501, 502]
    assert [r.text for r in kept if r.doc_id is None] == ["no id here but these few words"]


@pytest.mark.parametrize("tile, hot", [(3, 16384), (2048, 16384), (4, 2)])
def test_near_duplicates_of_repeated_and_null_keys(spark, tile, hot, monkeypatch):
    monkeypatch.setattr(dedup, "TILE", tile)
    monkeypatch.setattr(dedup, "HOT", hot)
    g = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    near = lambda a, n: " ".join([*base[a : a + 60 - n], *(f"x{g.randrange(10**6)}" for _ in range(n))])
    x, y = near(0, 0), near(60, 0)
    rows = [(3, x), (5, x), (5, y), (7, y), (9, near(120, 0)), (None, near(120, 2)), (None, near(180, 0)), (None, near(180, 1)), (11, ""), (11, x), (13, " "), (None, ""), (9, near(120, 0))]
    form = [" ".join([*base[:40], *(f"y{g.randrange(10**6)}" for _ in range(14))]) for _ in range(30)]  # alike, but not linked
    rows += [(100 + i, t) for i, t in enumerate(form)] + [(200 + i, t + " end") for i, t in enumerate(form[:10])]
    got = collections.Counter(map(tuple, dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()))
    # Row numbers stand for rows; a further word shared by all rows of a key would link them.
    plain = plain_components([(i, t) for i, (_, t) in enumerate(rows)], 2)
    groups = {}
    for i, c in plain.items():
        groups.setdefault(c, set()).add(i)
    merged = True
    while merged:
        merged = False
        for a in list(groups):
            for b in list(groups):
                keys = [{rows[i][0] for i in groups[c] if rows[i][0] is not None and rows[i][1].strip()} for c in (a, b)] if a in groups and b in groups and a != b else [set(), set()]
                if keys[0] & keys[1]:
                    groups[a] |= groups.pop(b)
                    merged = True
    expected = collections.Counter()
    for members in groups.values():
        least = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        for i in members:
            k, w = rows[i][0], split(rows[i][1])
            n = len(set(zip(w, w[1:], strict=False))) if len(w) > 1 else len(w)
            expected[k, n, least, least is None or k == least] += 1
    assert got == expected


@pytest.mark.parametrize("tile, few", [(2048, 32), (64, 1)])
def test_a_hot_key_loses_no_link(spark, tile, few, monkeypatch):
    """Pairs at the very threshold, made from one form, that only a key of all rows brings together."""
    monkeypatch.setattr(dedup, "HOT", 2)
    monkeypatch.setattr(dedup, "TILE", tile)
    monkeypatch.setattr(dedup, "FEW", few)
    form, n = [f"form{i}" for i in range(40)], 600
    text = lambda i, k: " ".join([*form, *(f"both{i}x{j}" for j in range(40)), *(f"own{i}x{k}x{j}" for j in range(10))])
    docs = spark.createDataFrame([(2 * i + k, text(i, k)) for i in range(n) for k in (0, 1)], "doc_id long, text string")
    scratch = dedup.Scratch(spark)
    rows = dedup._rows(docs, "doc_id", "text")
    classes = scratch.written(dedup.sketches(rows, 1).withColumnRenamed("id", "node"), "classes")
    search = dedup._Search(scratch, rows, classes, 1, 80)
    known = spark.createDataFrame([], "u long, v long")
    got = search.links(classes.select("node", F.lit(0).cast("bigint").alias("band")), known).collect()
    assert sorted(map(tuple, got)) == [(2 * i, 2 * i + 1) for i in range(n)]


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder of tables with odd documents, on which the registered queries run."""
    g = random.Random(21)
    words_ = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(g.choice(words_) for _ in range(g.choice([0, 1, 3, 20, 90, 400]))), "en", g.choice(["a", "b", None]), 0) for i in range(120)]
    rows += [(200 + i, rows[i % 5][1], "en", "b", 0) for i in range(20)] + [(300, None, None, None, None), (301, "", "", "", 0), (302, "Ünï \t cödé 日本 🙂" * 30, "xx", "c", 1), (303, "x" * 5000, "en", "a", 0)]
    folder = tmp_path_factory.mktemp("made")
    docs = spark.createDataFrame(rows, EMPTY)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 6 == 0)) for r in rows if r[0] < 200], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {r[0]: r[1] for r in rows}


def run_query(spark, made, name):
    return QUERIES[name](spark, made[0]).collect()


def test_op1_query_equals_a_plain_version(spark, made):
    def plain(text):
        data = (text or "").encode()
        n = len(data)
        data += bytes(-n % 64 or (0 if n else 64))
        rows = len(data) // 64
        media_ = b"P5\n64 %d\n255\n" % rows + data
        # Mean of the exact area, by repeating each sample as often as the new grid needs.
        big = np.repeat(np.repeat(np.frombuffer(data, np.uint8).reshape(rows, 64), 8, 0), 9, 1).astype(np.float64)
        means = big.reshape(8, rows, 9, 64).mean((1, 3))
        tile = np.clip(np.floor(means + 0.5), 0, 255).astype(np.uint8)
        bits = (tile[:, :-1] < tile[:, 1:]).reshape(-1)
        return n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media_), hashlib.sha256(media_).hexdigest(), f"{int(''.join('01'[int(b)] for b in bits), 2):016x}"

    got = {r.doc_id: tuple(r)[1:8] for r in run_query(spark, made, "op1_media_tiles")}
    assert got == {k: plain(t) for k, t in made[1].items()}


def test_op2_query_equals_a_plain_model(spark, made):
    got = {r.doc_id: r for r in run_query(spark, made, "op2_backoff_score")}
    counts, n = collections.Counter(), 0
    for k, t in made[1].items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            w = ["^", *split(t), "$"]
            n += len(w) - 1
            counts.update(tuple(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    v = sum(len(x) == 1 and x != ("^",) for x in counts)
    for k, t in made[1].items():
        w, score = ["^", *split(t), "$"], 0.0
        for i in range(1, len(w)):
            p = (counts[w[i],] + 1) / (n + v + 1)
            for m in range(1, min(ngrams.ORDER, i + 1)):
                context = tuple(w[i - m : i])
                if counts[context]:
                    p = (counts[*context, w[i]] + ngrams.PRIOR * p) / (counts[context] + ngrams.PRIOR)
            score += np.log10(p)
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) - 1, sum(counts[x,] > 0 for x in w[1:]), n) and r.score == pytest.approx(score, rel=1e-9)


def test_lanes_of_any_length_give_the_same_scores():
    g = random.Random(9)
    column = pa.array([" ".join(g.choice("abcd") for _ in range(g.randrange(60))) for _ in range(50)])
    tokens, offsets = ngrams.token_hashes(column)
    for order in (1, 2, 3, 4):
        by_order = ngrams.grams(tokens, offsets, order)
        asked = [ngrams._Asked(by_order, orders) for orders in ngrams.rounds(order)]
        count = np.concatenate([a.counts(np.ones(len(tokens), bool), len(column)) for a in asked])
        automaton = ngrams.Automaton(asked, count, offsets, order, 500, 3.0)
        scores = [automaton.read(asked[0].at[1], offsets, lane) for lane in (1, 2, 5, 1000)]
        assert all(np.allclose(s, scores[0], rtol=1e-12) for s in scores)


def test_op3_query_equals_brute_force(spark, made):
    got = {r.doc_id: (r.component_id, r.kept) for r in run_query(spark, made, "op3_minhash_dedup")}
    assert got == {k: (c, k == c) for k, c in plain_components(list(made[1].items()), 2).items()}


def test_op4_query_packs_every_piece(spark, made):
    rows = run_query(spark, made, "op4_bestfit_pack")
    tokenizer = packing.Encoder(packing.vocabulary()).tokenizer
    expected = {}
    for k, t in made[1].items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 4096):
            part = ids[i : i + 4096]
            expected[k, i // 4096] = (i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) == plain_best_fit([n for _, n, _ in expected.values()], 4096)


def plain_chunks(text):
    """Boundaries one byte after another, as the normalised gear hash defines them."""
    data, out, start, value = text.encode(), [], 0, 0
    hashes = []
    for byte in data:
        value = ((value << 1) + int(chunks._GEAR[byte])) % 2**64
        hashes.append(value)
    least, normal, most = chunks.SIZES
    while start < len(data):
        end = min(start + most, len(data))
        for at in range(start + least, end):
            if hashes[at - 1] >> (64 - (chunks.BITS[0] if at < start + normal else chunks.BITS[1])) == 0:
                end = at
                break
        out.append(data[start:end])
        start = end
    return out


def test_op7_query_equals_a_plain_version(spark, made):
    rows, texts = {r.doc_id: r for r in run_query(spark, made, "op7_chunk_fingerprint")}, made[1]
    order = sorted(texts)

    def share(a, b):
        a, b = set(plain_chunks(a)), set(plain_chunks(b))
        return sum(len(c) for c in a & b) / sum(map(len, a)) if a else float(not b)

    for i, k in enumerate(order):
        own, nxt, r = texts[k] or "", texts[order[(i + 1) % len(order)]] or "", rows[k]
        n = len(own) // 2
        edited = own[: len(own) - n] + nxt[:n]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint) == 14 * len(set(plain_chunks(own))) and len(r.edited_fingerprint) == 14 * len(set(plain_chunks(edited)))
        assert (r.near_edited, r.near_next) == (pytest.approx(share(own, edited)), pytest.approx(share(own, nxt)))


def test_fingerprints_of_many_rows_with_one_key_or_none(spark, monkeypatch):
    monkeypatch.setattr(chunks, "BLOCK_ROWS", 8)
    g = random.Random(13)
    rows = [(g.choice([None, 5, 5, g.randrange(100)]), f"text {i} " * g.randrange(5)) for i in range(300)]
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    plain = collections.Counter((k, len(t), chunks.sha_hex(chunks.edit_tail(t, expected[(i + 1) % len(expected)][1]))) for i, (k, t) in enumerate(expected))
    got = chunks.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()) == plain


def test_op9_query_never_sees_held_out_labels(spark, made, tmp_path):
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in run_query(spark, made, "op9_gru_toxicity")}
    assert got.keys() == made[1].keys() and all(h == (zlib.crc32(str(k).encode()) % 5 == 0) and p == (s >= 0.5) for k, (h, s, p) in got.items())
    labels = spark.read.parquet(f"{made[0]}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    spark.read.parquet(f"{made[0]}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    again = {r.doc_id: (r.held_out, r.score, r.predicted) for r in QUERIES["op9_gru_toxicity"](spark, str(tmp_path)).collect()}
    assert {k: v[1] for k, v in again.items()} == pytest.approx({k: v[1] for k, v in got.items()})
    by_text = collections.defaultdict(set)
    for k, (_, s, _) in got.items():
        by_text[made[1][k] or ""].add(s)
    assert all(max(s) - min(s) < 1e-5 for s in by_text.values())


def test_network_finds_held_out_toxic_texts(spark):
    texts, toxic = made_up(400, 5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(toxic.tolist())], "doc_id long, toxic int")
    rows = toxicity.with_scores(docs, toxicity.fit(docs, labels)).collect()
    held = [(r.score >= 0.5, bool(toxic[r.doc_id])) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and sum(a == b for a, b in held) > 0.95 * len(held)


def test_op10_query_deals_longest_first(spark, made):
    rows = run_query(spark, made, "op10_lpt_shards")
    size = {k: len((t or "").encode()) + 16 for k, t in made[1].items()}
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {k: (n, zlib.crc32((made[1][k] or "").encode()), "bytes", None) for k, n in size.items()}
    loads, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[made[1][r.doc_id] or ""].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    # One block: the loads are those of the plain rule, groups by size.
    groups = collections.Counter()
    for k, n in size.items():
        groups[made[1][k] or ""] += n
    plain = [0] * 40
    for n in sorted(groups.values(), reverse=True):
        plain[plain.index(min(plain))] += n
    assert sorted(loads[s] for s in range(40)) == sorted(plain)


@pytest.mark.parametrize("make", [
    lambda d: media.text_media(d), lambda d: ngrams.score(d), lambda d: dedup.near_duplicates(d), lambda d: packing.packed(d), lambda d: chunks.fingerprints(d), lambda d: mixing.plan(d),
    lambda d: sharding.shard(d), lambda d: urls.filter_urls(d, "text"), lambda d: pages.extract_pages(d, "lang", "text"),
])
def test_empty_tables(spark, make):
    assert make(spark.createDataFrame([], EMPTY)).collect() == []


def test_clashing_columns_stay_out_of_the_way(spark):
    names = "group key row band node n size turn name block shard place cell chunk held_out judged rule host salt site marks copy sum position id".split()
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 6), (2, "a b c d e f", "en", "s", 6), (2, "x", None, None, None)], EMPTY).select("*", *(F.lit(f"kept {n}").alias(n) for n in names))
    assert {r.shard for r in sharding.shard(docs).collect()} <= set(range(40))
    for make in (media.text_media, ngrams.score, dedup.near_duplicates, packing.packed, chunks.fingerprints, mixing.plan):
        assert len(make(docs).collect()) == 3
    out = pages.extract_pages(urls.filter_urls(docs.drop("rule", "host"), "lang"), "lang", "text").collect()
    assert len(out) == 3 and all(r[n] == f"kept {n}" for r in out for n in names if n not in ("rule", "host"))
    assert all(r[n] == f"kept {n}" for r in mixing.mixed(docs).collect() for n in names)


def test_netpbm_and_bmp_of_other_kinds():
    assert media.decode(b"P2\n2 1\n15\n0 15").tolist() == [[0, 255]] and media.decode(b"P5\n1 1\n65535\n\xff\xff").tolist() == [[255]]
    for broken in (b"P2\n2 1\n15\n0 16", b"P5\n1 1\n0\n\x00", b"P5\n2 2\n255\n\x00", b"BM"):
        with pytest.raises((ValueError, struct.error)):
            media.decode(broken)
    head = b"BM" + struct.pack("<IHHI", 70, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 32, 3, 4, 0, 0, 0, 0)
    fields = struct.pack("<3I", 0x0000FF, 0x00FF00, 0xFF0000)
    assert media.decode(head + fields + bytes([1, 2, 3, 0])).tolist() == [[[1, 2, 3]]]
    g = np.random.default_rng(4)
    tall = g.integers(0, 256, (9000, 5), dtype=np.uint8)
    whole = np.zeros((9001, 6))
    whole[1:, 1:] = np.cumsum(np.cumsum(tall, 0, dtype=np.float64), 1)
    means = np.array([[whole[1125 * (i + 1), j + 1] - whole[1125 * i, j + 1] - whole[1125 * (i + 1), j] + whole[1125 * i, j] for j in range(5)] for i in range(8)]) / 1125
    assert (media.area_resize(tall, 8, 5) == np.floor(means + 0.5)).all()


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from sluice.sources import shared

    conf = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://x:7077"), conf=conf)
    with pytest.raises(RuntimeError):
        shared.shared_dir(fake)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_of_documents_equal_exact_links(spark, width):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(docs, width=width).collect()}
    expected = plain_components(rows, width)
    assert got == expected and len(set(expected.values())) < len(rows)
