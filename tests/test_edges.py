"""Rows that a crawl has, and that no job may end on."""

import time

from sluice.operators import previews


def test_previews_of_malformed_pages(spark):
    sections = '<![foo[x]]><meta property="og:title" content="t"><![endif]--><title>one<![x</title>'
    nasty = ["<!-- >" * 100_000, "<!--" * 200_000, "<![if x>" * 100_000, "<p>" + "<b>" * 80_000 + "</i>" * 80_000, "<title>" + "<" * 300_000]
    rows = spark.createDataFrame([(k, f"http://a.example/{k}", h) for k, h in enumerate([sections, *nasty, None])], "page_id long, url string, html string")
    start = time.perf_counter()
    got = {r.page_id: r.preview for r in previews.previews(rows).collect()}
    assert time.perf_counter() - start < 60
    assert len(got) == 7 and got[0].title == "t"


def test_conditional_sections_say_nothing():
    said = list(previews.statements('<title>a<![CDATA[ b ]]>c<![if x>d<![endif]-->e</title><meta name="k" content="v">'))
    assert said == [("<title>", "a"), ("<title>", "c"), ("<title>", "d"), ("<title>", "e"), ("k", "v")]
