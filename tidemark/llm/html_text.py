"""Main text of web pages: host-wide repeats go, unique runs stay.

A page is read once into elements, blocks of text and a stream of tokens (tags with their classes, and words). The
streams of one host, one behind the other, form its text, whose suffixes are sorted together. Only repeats of at least
``LENGTH`` tokens matter, so suffixes need an order by their first ``LENGTH`` tokens alone, and that order can be
any: it is the order of a hash of host and tokens, in which equal beginnings are neighbours. The array is sparse: of
every ``WINDOW`` suffixes in a row one is kept, chosen by what it begins with, so each repeat of
``LENGTH + WINDOW - 1`` tokens or more keeps the same suffixes wherever it stands. Spark deals suffixes by their
hash and counts the distinct pages of each with partial sums; a suffix on two pages or more marks its tokens as
covered on all of them. A host is therefore never held in one task, however many pages it has.

What goes: covered tokens; and what the markup itself names as navigation, header, footer, sidebar, form, advert, notice
or comment, by element, role, or a word of its class or id. What stays: unique runs, and all of an element that
declares itself the article (article, main, or their roles), even where pages are copies of each other. In a page that
declares none, tokens go only if they are on more pages than its core, the fifth of its tokens that is on the fewest, so
that a copied page keeps its text.

Text is decoded, white space (Unicode's) inside a block becomes one space, blocks are joined by one in page order.

Defined results: null html and html without text give an empty text; a null url belongs to the host without a name, and
so does a url without ``://``; rows equal in page_id, url and html are one page and each gets the same text; null page_id stays; an
empty table gives an empty result; other columns are ignored. Two different beginnings of ``LENGTH`` tokens count as
equal with a chance of 2**-64. A task holds one Arrow batch of pages and the tokens of one page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table

#: Tokens that make a repeat, and of how many suffixes in a row one is kept.
LENGTH, WINDOW = 12, 4
#: Share of a page's tokens that makes its core.
CORE = 0.2
RESULT = "page_id long, url string, text string, n_chars long, repeated_words long, marked_words long"

RAW = frozenset("script style title textarea iframe noembed noframes xmp template noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside form menu dialog button select svg object canvas audio video datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of a class or id that name what is not the article.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar sidebars rail cookie cookies consent gdpr notice notices alert disclaimer newsletter subscribe "
    "subscription popup modal overlay comment comments commentlist disqus discussion replies respond share sharing social related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation "
    "footer header masthead topbar toolbar widget widgets pagination pager login signin signup search skip".split()
)
#: Of these, words that name a part of an article inside one.
HEADS = frozenset("header masthead".split())
#: A word behind one of these says that something is or isn't there, not what the element is.
ABOUT = frozenset("no not has have with without is show hide".split())
#: These name readers' words even around an article, which a comment may call itself.
COMMENT = frozenset("comment comments commentlist disqus replies".split())

TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?/][^a-zA-Z>][^>]*>?|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
TELLING = re.compile("class|id|role|hidden|style|itemprop", re.I)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
ROOT, DECLARED, HARD, SOFT, SPOKEN, TITLE = 1, 2, 4, 8, 16, 32


class Page(NamedTuple):
    """``blocks``: words of each block in page order and whether it is dropped by its markup (for words that are both,
    two entries); ``declared`` likewise whether it lies in the declared article. ``tokens`` is the stream outside the
    declared article, ``places`` the (block, word) of each token, (-1, -1) for tags."""

    blocks: list[list[str]]
    marked: list[bool]
    declared: list[bool]
    tokens: list[str]
    places: list[tuple[int, int]]


def words_of(name: str) -> list[str]:
    return [p.lower() for p in PART.findall(name)]


def _named(names: list[str]) -> set[str]:
    """The telling words of class names and an id."""
    found = set()
    for name in names:
        parts = words_of(name)
        found |= {w for before, w in zip(["", *parts], parts) if w in NAMED and before not in ABOUT}
    return found


def _element(name: str, text: str) -> tuple[str, int, bool]:
    """(token, flags, whether only the outside of an article counts) of a tag."""
    if not text or not TELLING.search(text):
        flags = HARD if name in DROPPED else ROOT if name in ("article", "main") else TITLE if name == "h1" else 0
        return f"<{name}>", flags | (DECLARED if name == "article" else 0), name == "header"
    given = {k.lower(): v[1:-1] if v[:1] in ("'", '"') else v for k, v in reversed(ATTRIBUTE.findall(text))}
    names = [*unescape(given.get("class", "")).split(), *unescape(given.get("id", "")).split()]
    role, flags, outside = given.get("role", "").lower(), 0, False
    if name in DROPPED or role in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        flags = HARD
    elif name == "article" or role == "article" or given.get("itemprop", "").lower() == "articlebody":
        # a comment if a class says nothing else
        flags = HARD if any((w := set(words_of(n))) & COMMENT and w <= COMMENT | {"reader", "user"} for n in names) else ROOT | DECLARED
    elif name == "main" or role == "main":
        flags = ROOT
    elif name not in ("html", "body") and (found := _named(names)):
        flags, outside = SOFT | (SPOKEN if found & COMMENT else 0), found <= HEADS
    elif name == "header":
        outside = True
    return f"<{'.'.join([name, *names])}>", flags | (TITLE if name == "h1" or flags & ROOT and not flags & DECLARED else 0), outside


def parse(html: str) -> Page:
    """One pass with the open elements as a stack."""
    parents, flags, outside = [0], [0], [False]
    stack, open_names = [(0, "")], {}
    events: list[tuple[str, int]] = []  # tags as (token, element), text as ("", piece)
    pieces: list[tuple[int, int, str]] = []  # (block, element, text)
    block, at, size = 0, 0, len(html)

    def said(text: str) -> None:
        if text:
            events.append(("", len(pieces)))
            pieces.append((block, stack[-1][0], unescape(text) if "&" in text else text))

    while at < size:
        m = TAG.search(html, at)
        if m is None:
            said(html[at:])
            break
        said(html[at : m.start()])
        at, name = m.end(), m[2]
        if name is None:
            continue
        if html[at - 1] != ">":  # a quote that does not end
            at = html.find(">", at) + 1 or size
        name = name.lower()
        if name == "br":
            said(" ")
            continue
        if name not in INLINE:
            block += 1
        if m[1]:
            if open_names.get(name):
                while stack[-1][1] != name:
                    open_names[stack.pop()[1]] -= 1
                element = stack.pop()[0]
                open_names[name] -= 1
                events.append((f"</{name}>", element))
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            at = (html.find(">", end.end()) + 1 or size) if end else size
            continue
        token, own, only_outside = _element(name, m[3])
        if name in VOID or m[3].endswith("/") and name in ("use", "path", "g"):
            continue
        parents.append(stack[-1][0])
        flags.append(own)
        outside.append(only_outside)
        stack.append((len(parents) - 1, name))
        open_names[name] = open_names.get(name, 0) + 1
        events.append((token, len(parents) - 1))
    return _judged(parents, flags, outside, events, pieces)


def _judged(parents: list[int], flags: list[int], outside: list[bool], events: list[tuple[str, int]], pieces: list[tuple[int, int, str]]) -> Page:
    # the names of elements around an article don't count; those of comments, around a title or a main part
    holds, holds_title = [False] * len(parents), [False] * len(parents)
    for i in range(len(parents) - 1, 0, -1):
        holds[parents[i]] |= bool(flags[i] & ROOT and not flags[i] & HARD) or holds[i]
        holds_title[parents[i]] |= bool(flags[i] & TITLE or flags[i] & ROOT and not flags[i] & DECLARED) or holds_title[i]
    gone = [False] * len(parents)
    for kind in (DECLARED, ROOT):
        root = [False] * len(parents)
        for i in range(1, len(parents)):
            p, f = parents[i], flags[i]
            within = root[p]
            hinted = (f & SOFT or outside[i]) and not (holds_title[i] if f & SPOKEN else holds[i]) and not (outside[i] and within)
            gone[i] = gone[p] or bool(f & HARD or hinted)
            root[i] = within or bool(f & kind and not gone[i])
        if any(root):
            break
    blocks: list[list[str]] = []
    marked: list[bool] = []
    declared: list[bool] = []
    tokens: list[str] = []
    places: list[tuple[int, int]] = []
    k, last = 0, len(events)
    while k < last:
        token, x = events[k]
        if token:
            if not root[x] or not root[parents[x]]:
                tokens.append(token)
                places.append((-1, -1))
            k += 1
            continue
        number, texts = pieces[x][0], ([], [])
        inside = root[pieces[x][1]]
        while k < last:  # all pieces of one block; inline tags between them are no tokens
            token, x = events[k]
            if not token:
                if pieces[x][0] != number or root[pieces[x][1]] != inside:
                    break
                texts[gone[pieces[x][1]]].append(pieces[x][2])
            elif k + 1 == last or events[k + 1][0] or pieces[events[k + 1][1]][0] != number:
                break
            k += 1
        for dropped in (False, True):
            found = "".join(texts[dropped]).split()
            if found:
                if not inside:
                    tokens += found
                    places += [(len(blocks), j) for j in range(len(found))]
                blocks.append(found)
                marked.append(dropped)
                declared.append(inside)
    return Page(blocks, marked, declared, tokens, places)


_RNG = np.random.default_rng(12)
_PLACE = _RNG.integers(0, 2**63, LENGTH, dtype=np.uint64) * 2 + 1


class Hasher:
    """64-bit hashes of tokens, remembered up to a bound."""

    MOST = 500_000

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > self.MOST:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return np.fromiter((known[t] for t in tokens), np.uint64, len(tokens))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def suffixes(hashes: np.ndarray, host: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of the kept suffixes of one stream, each key at its first position only."""
    n = len(hashes) - LENGTH + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.full(n, np.uint64(host % 2**64))
    for j in range(LENGTH):
        key += hashes[j : j + n] * _PLACE[j]
    key = _mix(key)
    if n > WINDOW:
        rows = np.lib.stride_tricks.sliding_window_view(key, WINDOW)[:, ::-1]
        at = np.unique(np.arange(len(rows)) + WINDOW - 1 - rows.argmin(axis=1))
    else:
        at = np.array([n - 1 - key[::-1].argmin()])
    return at, key[at].view(np.int64)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _identified(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host and a 128-bit name of each distinct row."""
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    parts = [F.col("page_id"), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))]
    return own.select("*", F.xxhash64(*parts).alias("u"), F.xxhash64(F.lit(12), *reversed(parts)).alias("v"), F.xxhash64(host_of(F.col("url"))).alias("host"))


def repeats(pages: DataFrame) -> DataFrame:
    """u, v of each distinct page with the positions of its repeated suffixes and on how many pages each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            u, v, host, html = batch.columns
            places, keys = [], []
            for h, text in zip(host.to_pylist(), html):
                at, key = suffixes(hasher(parse(text.as_py() or "").tokens), h)
                places.append(at)
                keys.append(key)
            yield pa.RecordBatch.from_arrays([u, v, pa.array(places, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], ["u", "v", "place", "key"])

    found = pages.select("u", "v", "host", "html").mapInArrow(run, "u long, v long, place array<int>, key array<long>").where("size(key) > 0")
    array = materialize(found.groupBy("u", "v").agg(F.first("place").alias("place"), F.first("key").alias("key")), "suffixes")
    # a page that has a beginning twice counts once
    counted = array.select(F.explode(F.array_distinct("key")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    each = array.select("u", "v", F.inline(F.arrays_zip("place", "key")))
    return each.join(counted, "key").groupBy("u", "v").agg(F.collect_list(F.struct("place", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n"))).alias("found"))


def main_text(page: Page, found: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text, words that went as repeats, words that went by markup) of a page whose suffix at each ``place`` is on ``n`` pages."""
    count = np.ones(len(page.tokens), dtype=np.int64)
    for place, n in found:
        near = count[place : place + LENGTH]
        np.maximum(near, n, out=near)
    core = 1
    if not any(page.declared):
        own = np.sort([c for c, (b, _) in zip(count.tolist(), page.places) if b >= 0 and not page.marked[b]])
        core = int(own[int(len(own) * CORE)]) if len(own) else 1
    covered: dict[int, set[int]] = {}
    for k in np.flatnonzero(count > core).tolist():
        b, j = page.places[k]
        if b >= 0:
            covered.setdefault(b, set()).add(j)
    kept, repeated, marked = [], 0, 0
    for b, words in enumerate(page.blocks):
        gone = covered.get(b, ())
        # a repeat ends up to WINDOW - 1 tokens before or behind what its kept suffixes cover
        if 2 * len(gone) >= len(words) or len(words) - len(gone) < WINDOW and gone:
            repeated += len(words)
        elif page.marked[b]:
            marked += len(words)
        else:
            repeated += len(gone)
            kept += [w for j, w in enumerate(words) if j not in gone] if gone else words
    return " ".join(kept), repeated, marked


def squeezed(known: DataFrame) -> DataFrame:
    """``known`` with html compressed (null for null) and its size, for the shuffle that brings pages and repeats together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            html = [x.as_py() for x in batch.column(4)]
            packed = [None if x is None else codec.compress(x, asbytes=True) for x in html]
            sizes = [None if x is None else len(x) for x in html]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())], ["u", "v", "page_id", "url", "html", "size"])

    return known.select("u", "v", "page_id", "url", F.col("html").cast("binary")).mapInArrow(run, "u long, v long, page_id long, url string, html binary, size long")


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page, as in ``RESULT``."""
    known = _identified(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")

        def plain(packed: bytes | None, size: int | None) -> str:
            return codec.decompress(packed, size, asbytes=True).decode("utf-8", "replace") if size else ""

        for batch in batches:
            ids, urls, html, bytes_, found = batch.columns
            made = [main_text(parse(plain(h.as_py(), n.as_py())), [(x["place"], x["n"]) for x in f.as_py() or ()]) for h, n, f in zip(html, bytes_, found)]
            text, repeated, marked = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(repeated, pa.int64()), pa.array(marked, pa.int64())], [c.split()[0] for c in RESULT.split(", ")])

    told = squeezed(known).join(repeats(known), ["u", "v"], "left")
    return told.select("page_id", "url", "html", "size", "found").mapInArrow(run, RESULT)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op12_html_text": op12_html_text}
#: Suffix arrays have no SQL; on the tables, whose pages all declare their article, this is the text to be found.
ORACLES = {
    "op12_html_text": r"""
WITH inner_part AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<[^>]*>', ' ', 'g') AS t FROM pages
), decoded AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM inner_part
)
SELECT page_id, url, text, length(text) AS n_chars FROM decoded
"""
}
