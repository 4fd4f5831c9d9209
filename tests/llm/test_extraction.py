"""op4 on written pages; suffix arrays against a scan of all token strings."""

from __future__ import annotations

import html
import random
import re

import numpy as np

from granary.llm import extraction, queries

from .helpers import SF, table


def text(page):
    return extraction.main_texts([extraction.blocks(page)])[0]


def test_marked_pages():
    page = "<html><head><title>x</title></head><body><header>Site</header><div class='cookie-notice'>c</div><main><h1>T &amp; t</h1><p>one<b> two</p><p>three<br>four <ul><li>a<li>b</ul><div class='comments'><p>nice</p></div><form>f<input></form><p>x &lt;b&gt; <!-- c --> y</main><footer>f</footer>"
    assert text(page) == "T & t\none two\nthree four\na\nb\nx <b> y"
    assert text("<article><p>a</p><aside>no</aside><p>b<script>'</p>'</script> c</p></article>tail") == "a\nb c"


def test_unmarked_and_broken_pages():
    assert text("<p>a <![CDATA[hello world") == "a hello world" and text("<p>a <![CDATA[b]]> c") == "a b c"
    assert text("<p>a <a title=\"x>y</a> z</p>") == "a y z" and text("<p>a</p><p class='b") == "a"
    assert text(None) == text("") == "" and text("only &eacute; \n text") == "only é text"
    assert text("<p>a<script>var x='<p>';") == "a" and text("a < b <p title='>'>q</i>") == "a < b\nq"
    pages = [extraction.blocks(f"<body><div>Home About Contact Us Today Now Please</div><div>Story {i} {'abcdefgh'[i]} is unique here</div></body>") for i in range(4)]
    assert extraction.main_texts(pages) == [f"Story {i} {'abcdefgh'[i]} is unique here" for i in range(4)]


def test_repeated_tokens():
    rng = random.Random(3)
    for _ in range(30):
        streams = [[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 5))]
        wanted = []
        for i, s in enumerate(streams):
            mask = np.zeros(len(s), bool)
            for k in range(len(s) - 2):
                if any(s[k : k + 3] == o[x : x + 3] for j, o in enumerate(streams) if j != i for x in range(len(o) - 2)):
                    mask[k : k + 3] = True
            wanted.append(mask.tolist())
        assert [m.tolist() for m in extraction.repeated_tokens(streams, 3)] == wanted


def test_repeats_over_a_whole_host(spark):
    made = [f"<p>{' '.join(f'w{i}x{k}' for k in range(8))}</p>" for i in range(900)]
    for n in range(12):  # each notice on two pages only, far apart
        for i in (n, 899 - 37 * n):
            made[i] += f"<div>{' '.join(f'notice{n}x{k}' for k in range(7))}</div>"
    made[5] += "<main>kept</main>"
    df = spark.createDataFrame([(i, f"http://{'b' if i == 450 else 'a'}.net/{i}", p) for i, p in enumerate([*made, made[7]])], "page_id long, url string, html string")
    got = {(r.id, r.url): r.text for r in extraction.extract(df).collect()}
    pages = [extraction.blocks(p) for p in [*made, made[7]]]
    wanted = extraction.main_texts([p for i, p in enumerate(pages) if i != 450])
    wanted.insert(450, extraction.main_texts([pages[450]])[0])
    assert [got[r.page_id, r.url] for r in df.collect()] == wanted
    assert not any("notice" in t for t in wanted) and wanted[7] == wanted[900] == "" and wanted[5] == "kept" and wanted[450]


def test_whole_table(spark):
    got = {r.page_id: r for r in queries.op4_html_extraction(spark, SF).collect()}
    pages = table("pages")
    assert len(got) == len(pages)
    for page, url, source in pages:
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        wanted = "\n".join(p for p in parts if p)
        assert (got[page].url, got[page].text, got[page].n_chars) == (url, wanted, len(wanted))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, 1), (2, "http://a/x", "<p>q</p>", 1), (2, "http://a/x", "<p>q</p>", 1), (None, "", "<p>" * 500 + "deep", 1)], "page_id long, url string, html string, host int")
    got = sorted((r.id or 0, r.text) for r in extraction.extract(df).collect())
    assert got == [(0, "deep"), (1, ""), (2, "q"), (2, "q")]
    assert extraction.extract(df.limit(0)).count() == 0


def test_names_are_matched_whole():
    """A junk word inside another name marks nothing (before: all three texts vanished)."""
    assert text("<article><p>a <span class='ad-free'>b</span></p><p id='header-image'>c</p><p class='no-ads big'>d</p></article>") == "a b\nc\nd"
    assert text("<article><p>a</p><div class='x ad-slot-2'>b</div><div id='reader-comments'>c</div><div class='share_buttons'>d</div></article>") == "a"


def test_suffixes_are_ordered_over_ranges(spark):
    """One notice on all pages of a host: its run goes over many ranges, and tokens are compared, not hashes."""
    assert not hasattr(extraction, "string_hashes")
    made = [(i, "http://a.net/", f"<p>{' '.join(f'w{i}x{k}' for k in range(9))}</p><p>one notice of exactly seven tokens here</p>") for i in range(300)]
    got = {r.id: r.text for r in extraction.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(f"w{i}x{k}" for k in range(9)) for i in range(300)}
    twice = "<p>" + "the same seven tokens on one page " * 2 + "</p>"
    assert extraction.extract(spark.createDataFrame([(1, "http://b.net/", twice)], "page_id long, url string, html string")).first().text == ("the same seven tokens on one page " * 2).strip()
