"""Main text of pages: parsing by cases, repeats against a plain search for equal runs of tokens."""

import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import html_text
from tidemark.llm.html_text import LENGTH, WINDOW, main_text, parse

SF = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="fixture tables are not here")
PAGES = "page_id long, url string, html string, text string, u long, host int"


def text_of(html):
    return main_text(parse(html), [])[0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain & simple", "plain & simple"),
        ("<p>a<b>b</b> c<br>d\n e</p><p>f</p>", "ab c d e f"),
        ("<article><h1>T&amp;amp;</h1><p>x &lt;p&gt; &#233;&eacute;&nbsp;y</p></article>", "T&amp; x <p> éé y"),
        ("<article><p>&am &amp &copy 2 < 3 and a<b</p></article>", "&am & © 2 < 3 and a"),
        ("<script>var t='</p><p>no';</script><style>p{}</style><textarea>no</textarea><p>yes", "yes"),
        ("<SCRIPT>if (a</script >yes<script>never ended <p>no", "yes"),
        ("a<!-- <p>no</p> -->b<!-- never ended <p>no", "ab"),
        ("<nav><ul><li><a href='/x'>menu</a></ul></nav><p>text</p><footer>foot</footer>", "text"),
        ("<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>x</p><aside>no</aside></main>", "Title x"),
        ("<div class='x1'>lead</div><article>body<div class='ad-slot'>buy</div><p>more</p></article>", "lead body more"),
        ("<div role=banner>no</div><div id='cookieConsent'>no</div><div class='no-sidebar content'>yes</div>", "yes"),
        ("<div class='has-sidebar ads-wrap'><article>yes<p>p</article></div>", "yes p"),
        ("<article>yes</article><div class='comments'><article>no</article></div><article class='comment'>no</article>", "yes"),
        ("<div hidden>no</div><p style='display: none'>no</p><p aria-hidden='true'>no</p><p>yes</p>", "yes"),
        ("<a title=\"a > b\">x</a> <a title='never ended>y</a> z", "x y z"),
        ("<p>one<span class=advert> no</span> two</p>", "one two"),
        ("</div></p>x</article><p>y</body>z", "x y z"),
        ("<article><p>a<form>no<p>no</form>b</article>", "a b"),
        ("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "1 2 3 4"),
        ("<p>" * 3 + "<i>" * 2000 + "deep" + "</i>" * 2000, "deep"),
        ("<svg><path/><text>no</text></svg>yes", "yes"),
    ],
)
def test_parsing(html, want):
    assert text_of(html) == want


def test_long_and_hostile_pages_take_linear_time():
    for html in ("<" * 300_000, "<a '" * 100_000, "&" * 300_000, "<div>" * 100_000 + "x", "<!--" * 100_000, "</p>" * 100_000, "<p>w </p>" * 60_000):
        parse(html)
    assert text_of("<article><p>" + "word " * 400_000 + "</p></article>").count("word") == 400_000


WORDS = [f"w{i}" for i in range(400)]


def site(host, pages, seed, article=True):
    """Pages of one host: three blocks that all share, one of two others, and an own body, under classes that say nothing."""
    rng = np.random.default_rng(seed)
    say = lambda n: " ".join(rng.choice(WORDS, n)) + f" {host}{rng.integers(1e9)}"
    shared = [say(15), say(20), say(14)]
    either = [say(16), say(17)]
    out = []
    for k in range(pages):
        body = [say(30), say(25)]
        inner = "".join(f"<p>{b}</p>" for b in body)
        whole = f"<article>{inner}</article>" if article else f"<div class='b2'>{inner}</div>"
        out.append((f"<html><body><div class='q1'>{shared[0]}</div><div class='z'>{shared[1]}</div>{whole}<section class='k'>{either[k % 2]}</section><div class='q9'>{shared[2]}</div></body></html>", " ".join(body)))
    return out


def rows_of(sites):
    rows, want, k = [], {}, 0
    for host, made in sites.items():
        for html, text in made:
            rows.append((k, f"https://{host}/p/{k}", html, "clash", 1, 2))
            want[k] = text
            k += 1
    return rows, want


@pytest.mark.parametrize("article", [True, False])
def test_blocks_repeated_on_a_host_go(spark, article):
    rows, want = rows_of({"a.example": site("a", 30, 1, article), "B.example": site("b", 9, 2, article)})
    got = html_text.extract(spark.createDataFrame(rows, PAGES).repartition(6)).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) and r.repeated_words > 60 and r.marked_words == 0 for r in got)


def test_what_is_on_other_hosts_only_stays(spark):
    shared = "<div class='q'>" + " ".join(WORDS[:40]) + "</div>"
    rows = [(k, f"http://h{k}.example/", f"{shared}<p>own {k} " + " ".join(WORDS[50 + k :: 7]) + "</p>", "", 0, 0) for k in range(5)]
    got = html_text.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert all(r.text.startswith("w0 w1 ") and r.repeated_words == 0 for r in got)


def test_copied_articles_stay(spark):
    """Copies of one page under several addresses, with and without an element that declares the article."""
    for article in (True, False):
        made = site("a", 12, 3, article)
        rows, want = rows_of({"a.example": made + [made[0]] * 3 + [made[1]]})
        got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
        assert got == want


def test_a_part_of_a_block_that_repeats_goes(spark):
    line = " ".join(WORDS[:30])
    rows = [(k, "http://a.example/", f"<p>own{k} " + " ".join(WORDS[40 + k :: 5]) + f" {line}</p><p>rest{k}</p>", "", 0, 0) for k in range(4)]
    for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect():
        left = set(r.text.split()) & set(line.split())
        assert r.text.startswith(f"own{r.page_id} ") and r.text.endswith(f" rest{r.page_id}") and len(left) < WINDOW


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (None, "http://x.example", "<p>x</p>"), (None, "http://x.example", "<p>x</p>"), (3, "http://x.example/?q", "<p>" + "long " * 50_000 + "</p>"), (4, "http://y.example", "\u0000<p>\u0000z</p>")]
    df = spark.createDataFrame([(*r, "clash", 0, 0) for r in rows], PAGES)
    got = sorted(((r.page_id or 0, r.url, r.text) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, None, ""), (2, "no scheme", ""), (0, "http://x.example", "x"), (0, "http://x.example", "x"), (3, "http://x.example/?q", " ".join(["long"] * 50_000)), (4, "http://y.example", "\u0000 \u0000z")], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def plain_repeats(pages):
    """For each page the positions of all runs of LENGTH tokens that another page of its host has."""
    where = defaultdict(set)
    streams = {i: parse(html).tokens for i, _, html in pages}
    for i, host, _ in pages:
        for k in range(len(streams[i]) - LENGTH + 1):
            where[host, tuple(streams[i][k : k + LENGTH])].add(i)
    return {i: {k: len(where[host, tuple(streams[i][k : k + LENGTH])]) for k in range(len(streams[i]) - LENGTH + 1) if len(where[host, tuple(streams[i][k : k + LENGTH])]) > 1} for i, host, _ in pages}


@needs_tables
def test_kept_suffixes_find_every_long_repeat_on_the_tables(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet").where("page_id < 1200")
    known = html_text._identified(table)
    found = {r.page_id: {x.place: x.n for x in r.found} for r in known.join(html_text.repeats(known), ["u", "v"]).select("page_id", "found").collect()}
    pages = [(r.page_id, r.url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].lower(), r.html) for r in table.collect()]
    want, tally = plain_repeats(pages), Counter()
    for i, runs in want.items():
        mine = found.get(i, {})
        assert all(1 < n <= runs.get(k, 0) for k, n in mine.items())  # nothing but true repeats; a page counts where it keeps the suffix
        for k in runs:
            if all(k + j in runs and runs[k + j] == runs[k] for j in range(WINDOW)):
                tally["long"] += 1
                assert any(k <= p < k + WINDOW for p in mine)
    assert tally["long"] > 1000
