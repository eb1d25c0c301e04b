"""Page trees: elements of a page with their nesting, and records read from them.

One pass over a page's tags with the open elements as a stack gives its nodes in document order: elements, and pieces of
text with the tag ``#text``. A node knows its number and that of the last node inside it, so what lies inside an element
is one slice of the array, whatever the nesting; all selection is done on such slices with column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.text import parse_number
from tidemark.functions.time import zone_to_utc

NODES = "array<struct<n:int,last:int,tag:string,classes:array<string>,attrs:map<string,string>,text:string>>"
TEXT = "#text"
#: Bytes of pages whose nodes are held at a time; as Python objects they take some 30 times as much.
CHARS = 1 << 19
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "template"))
#: An element that ends where one of the same kind begins, unless one of the second kind has opened since.
ENDS_AT_NEXT = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "dt": ("dl",), "dd": ("dl",), "p": ("div", "section", "article", "td", "li")}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


def parse(html: str) -> list[list]:
    """[number from 1, last number inside, tag, attributes, text] of every node in document order."""
    nodes: list[list] = []
    stack: list[list] = []
    held: dict[str, int] = {}
    at, size = 0, len(html)

    def said(text: str) -> None:
        if text and not text.isspace():
            nodes.append([len(nodes) + 1, len(nodes) + 1, TEXT, {}, unescape(text)])

    def close(name: str) -> None:
        while True:
            node = stack.pop()
            node[1] = len(nodes)
            held[node[2]] -= 1
            if node[2] == name:
                return

    while at < size:
        m = TAG.search(html, at)
        said(html[at : m.start()] if m else html[at:])
        if m is None:
            break
        at, name = m.end(), (m[2] or "").lower()
        if name and html[at - 1] != ">":  # a quote that does not end
            at = html.find(">", at) + 1 or size
        if not name:
            continue
        if m[1]:
            if held.get(name):
                close(name)
            continue
        if name in ENDS_AT_NEXT and held.get(name):
            above = next(x[2] for x in reversed(stack) if x[2] == name or x[2] in ENDS_AT_NEXT[name])
            if above == name:
                close(name)
        given = {k.lower(): unescape(v[1:-1] if v[:1] in ("'", '"') else v) for k, v in reversed(ATTRIBUTE.findall(m[3]))} if m[3].strip(" /\n\t") else {}
        node = [len(nodes) + 1, len(nodes) + 1, name, given, None]
        nodes.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            at = (html.find(">", end.end()) + 1 or size) if end else size
        elif name not in VOID:
            stack.append(node)
            held[name] = held.get(name, 0) + 1
    while stack:
        close(stack[-1][2])
    return nodes


def _listed(sizes: list[int]) -> pa.Array:
    ends = [0]
    for n in sizes:
        ends.append(ends[-1] + n)
    return pa.array(ends, pa.int32())


def _packed(pages: list[list[list]]) -> pa.Array:
    flat = [node for page in pages for node in page]
    classes = [(x[3].get("class") or "").split() for x in flat]
    names = pa.ListArray.from_arrays(_listed([len(c) for c in classes]), pa.array([c for x in classes for c in x], pa.string()))
    attrs = pa.MapArray.from_arrays(_listed([len(x[3]) for x in flat]), pa.array([k for x in flat for k in x[3]], pa.string()), pa.array([v for x in flat for v in x[3].values()], pa.string()))
    parts = [pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.string()), names, attrs, pa.array([x[4] for x in flat], pa.string())]
    return pa.ListArray.from_arrays(_listed([len(p) for p in pages]), pa.StructArray.from_arrays(parts, ["n", "last", "tag", "classes", "attrs", "text"]))


def in_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows that hold about ``CHARS`` bytes of text in ``column``."""
    begin, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + n > CHARS:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def trees(pages: DataFrame, html: str = "html", out: str = "nodes") -> DataFrame:
    """``pages`` with the nodes of ``html`` in its place; null and empty pages have none. Memory: one Arrow batch of pages as
    text, and the nodes of ``CHARS`` characters of it or of one page."""
    rest = [c for c in pages.columns if c not in (html, out)]
    rows = pages.select(*rest, F.coalesce(F.col(html), F.lit("")).alias(html))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, len(rest)):
                made = _packed([parse(x.as_py()) for x in part.column(len(rest))])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], made], [*rest, out])

    return rows.mapInArrow(run, StructType([*pages.select(*rest).schema.fields, *StructType.fromDDL(f"{out} {NODES}").fields]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``: selections nest, and would multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def inside(nodes: Column, e: Column) -> Column:
    """What lies inside an element; nothing inside a missing one."""
    return let(e, lambda x: F.when(x.isNotNull(), F.slice(nodes, x["n"] + 1, x["last"] - x["n"])).otherwise(F.slice(nodes, 1, 0)))


def having(nodes: Column, *classes: str, tag: str | None = None, attr: str | None = None) -> Column:
    """The elements with all of ``classes``, of a tag, with an attribute."""

    def fits(x: Column) -> Column:
        ok = F.lit(True) if tag is None else x["tag"] == tag
        for c in classes:
            ok = ok & F.array_contains(x["classes"], c)
        return ok & (x["tag"] != TEXT) if attr is None else ok & x["attrs"][attr].isNotNull()

    return F.filter(nodes, fits)


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def has(e: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(e["classes"], name), F.lit(False))


def text_of(nodes: Column, e: Column, joint: str = "") -> Column:
    """All text inside an element, each piece trimmed; empty for a missing one."""
    said = F.transform(F.filter(inside(nodes, e), lambda x: x["tag"] == TEXT), lambda x: F.regexp_replace(x["text"], r"^\s+|\s+$", ""))
    return F.array_join(said, joint)


def own_text_of(nodes: Column, e: Column) -> Column:
    """Text of an element that is in no element inside it."""

    def mine(within: Column) -> Column:
        deep = F.filter(within, lambda x: x["tag"] != TEXT)
        own = lambda ds: F.filter(within, lambda x: (x["tag"] == TEXT) & ~F.exists(ds, lambda d: (x["n"] > d["n"]) & (x["n"] <= d["last"])))
        return let(deep, lambda ds: F.array_join(F.transform(own(ds), lambda x: x["text"]), ""))

    return F.trim(let(inside(nodes, e), mine))


def number(text: Column, kind: str = "int") -> Column:
    return parse_number(text, kind)


def shown(nodes: Column, e: Column) -> Column:
    """A cell's text; where it tells sides apart, that of both."""
    both = first(having(inside(nodes, e), "side", "mod-both"))
    return F.coalesce(F.nullif(text_of(nodes, both), F.lit("")), text_of(nodes, e))


LABELS = ("PICK", "BAN", "DECIDER")


def map_name(nodes: Column, header: Column) -> Column:
    """The map of a game's header: the first span whose own text is neither a label of the veto nor a time."""

    def named(at: Column) -> Column:
        spans = F.transform(having(inside(nodes, at), tag="span"), lambda s: own_text_of(nodes, s))
        said = first(F.filter(spans, lambda t: (t != "") & ~F.upper(t).isin(*LABELS) & ~t.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$")))
        line = F.regexp_replace(F.split_part(text_of(nodes, at, "\n"), F.lit("\n"), F.lit(1)), r"\s*\d{1,2}:\d{2}(:\d{2})?\s*$", "")
        return F.trim(F.regexp_replace(F.coalesce(said, line), rf"({'|'.join(LABELS)})\s*$", ""))

    return let(first(having(inside(nodes, header), "map")), named)


def round_strip(nodes: Column, game: Column) -> Column:
    """Number, winner, side and how it was won of every round that a game's strip shows."""
    strip = first(having(inside(nodes, game), "vlr-rounds"))
    columns = F.filter(having(inside(nodes, strip), "vlr-rounds-row-col"), lambda c: ~has(c, "mod-spacing") & (F.size(having(inside(nodes, c), "rnd-sq")) > 0))

    def won_by(c: Column, i: Column, squares: Column, place: Column) -> Column:
        stem = lambda won: F.regexp_extract(first(having(inside(nodes, won), tag="img"))["attrs"]["src"], r"([^/.]*)(?:\.[^/]*)?$", 1)
        told = lambda won: F.struct(
            F.coalesce(number(text_of(nodes, first(having(inside(nodes, c), "rnd-num")))), i + 1).alias("number"),
            F.when(place == 1, "team1").when(place > 1, "team2").otherwise("").alias("winner"),
            F.when(has(won, "mod-t"), "attack").when(has(won, "mod-ct"), "defense").otherwise("").alias("side"),
            let(stem(won), lambda x: F.when(x.isin("elim", "boom", "defuse", "time"), x).otherwise("")).alias("win_method"),
        )
        return let(F.get(squares, (place - 1).cast("int")), told)

    def one(c: Column, i: Column) -> Column:
        at = lambda squares: F.array_position(F.transform(squares, lambda s: has(s, "mod-win")), True)
        return let(having(inside(nodes, c), "rnd-sq"), lambda squares: let(at(squares), lambda place: won_by(c, i, squares, place)))

    return F.transform(columns, one)


def player_cells(nodes: Column, game: Column) -> Column:
    """Players of a game in order, from a name cell each and an even share of the other cells."""

    def one(cell: Column, own: Column) -> Column:
        value = lambda col: number(shown(nodes, first(F.filter(own, lambda c: c["attrs"]["data-col"] == col))), "double")
        parts = F.flatten(F.transform(F.filter(own, lambda c: has(c, "mod-kda")), lambda c: having(inside(nodes, c), "ovw-kda-stat")))
        count = lambda ps, col: number(shown(nodes, first(F.filter(ps, lambda c: c["attrs"]["data-col"] == col))))
        picture = lambda within: first(having(inside(nodes, first(having(within, "ovw-agents"))), tag="img"))["attrs"]
        name = lambda within: F.coalesce(F.nullif(text_of(nodes, first(having(within, "ovw-player-name"))), F.lit("")), text_of(nodes, first(having(within, "text-of"))))
        told = lambda within, ps, pic: F.struct(
            name(within).alias("name"), F.coalesce(F.nullif(pic["title"], F.lit("")), pic["alt"], F.lit("")).alias("agent"),
            *(count(ps, c).alias(c) for c in ("kills", "deaths", "assists")), value("acs").alias("acs"), value("kast").alias("kast_pct"), value("adr").alias("adr"), value("hsp").alias("hs_pct"),
            value("fb").cast("int").alias("fk"), value("fd").cast("int").alias("fd"),
        )
        return let(inside(nodes, cell), lambda within: let(parts, lambda ps: let(picture(within), lambda pic: told(within, ps, pic))))

    def all_of(names: Column, stats: Column, share: Column) -> Column:
        return F.when(F.size(names) >= 2, F.transform(names, lambda cell, i: let(F.slice(stats, i * share + 1, share), lambda own: one(cell, own))))

    def parted(cells: Column) -> Column:
        names, stats = F.filter(cells, lambda c: has(c, "mod-player")), F.filter(cells, lambda c: ~has(c, "mod-player"))
        share = lambda ns, ss: F.floor(F.size(ss) / F.greatest(F.size(ns), F.lit(1))).cast("int")
        return let(names, lambda ns: let(stats, lambda ss: let(share(ns, ss), lambda k: all_of(ns, ss, k))))

    return let(having(inside(nodes, game), "ovw-cell"), parted)


def table_rows(nodes: Column, table: Column) -> Column:
    """Rows of a table's body as arrays of cells."""
    body = let(table, lambda t: F.coalesce(first(having(inside(nodes, t), tag="tbody")), t))
    return F.filter(F.transform(having(inside(nodes, body), tag="tr"), lambda r: having(inside(nodes, r), tag="td")), lambda r: F.size(r) > 0)


def player_tables(nodes: Column, game: Column) -> Column:
    """Players of both teams from the older layout, a table for each team with twelve columns or more."""

    def one(cells: Column) -> Column:
        v = lambda i, kind="int": number(shown(nodes, F.get(cells, F.lit(i))), kind)
        cell = F.get(cells, F.lit(0))
        picture = first(having(inside(nodes, F.get(cells, F.lit(1))), tag="img"))["attrs"]
        name = F.coalesce(F.nullif(text_of(nodes, first(having(inside(nodes, cell), "text-of"))), F.lit("")), text_of(nodes, cell))
        return F.struct(
            name.alias("name"), F.coalesce(F.nullif(picture["title"], F.lit("")), picture["alt"], F.lit("")).alias("agent"), v(4).alias("kills"), v(5).alias("deaths"), v(6).alias("assists"), v(3, "double").alias("acs"),
            v(8, "double").alias("kast_pct"), v(9, "double").alias("adr"), v(10, "double").alias("hs_pct"), v(11).alias("fk"), v(12).alias("fd"),
        )

    tables = F.slice(having(inside(nodes, game), "wf-table-inset", "mod-overview", tag="table"), 1, 2)
    return F.transform(tables, lambda t: F.transform(F.filter(table_rows(nodes, t), lambda r: F.size(r) >= 12), one))


def side_score(nodes: Column, team: Column, side: str) -> Column:
    said = F.transform(having(inside(nodes, team), side), lambda e: number(text_of(nodes, e)))
    return first(F.filter(said, lambda x: x.isNotNull()))


def games_of(nodes: Column) -> Column:
    """Maps of a match page that have two scores, numbered from 1; the block of all maps together is none."""
    blocks = F.filter(having(nodes, "vm-stats-game", tag="div", attr="data-game-id"), lambda g: ~g["attrs"]["data-game-id"].isin("", "all"))

    def told(g: Column, header: Column, teams: Column, cells: Column, legacy: Column) -> Column:
        team = lambda i: F.get(teams, F.lit(i))
        score = lambda i: number(text_of(nodes, first(having(inside(nodes, team(i)), "score"))))
        half = F.floor(F.size(cells) / 2).cast("int")
        return F.struct(
            g["attrs"]["data-game-id"].alias("game_id"), map_name(nodes, header).alias("map_name"), score(0).alias("team1_score"), score(1).alias("team2_score"),
            *(side_score(nodes, team(i), f"mod-{s}").alias(f"team{i + 1}_{s}") for i in (0, 1) for s in ("ct", "t")),
            text_of(nodes, first(having(inside(nodes, g), "map-duration"))).alias("duration"), round_strip(nodes, g).alias("rounds"),
            F.coalesce(F.slice(cells, 1, half), F.get(legacy, F.lit(0))).alias("team1_players"), F.coalesce(F.slice(cells, half + 1, F.size(cells)), F.get(legacy, F.lit(1))).alias("team2_players"),
        )

    def one(g: Column) -> Column:
        whole = lambda h, ts: let(player_cells(nodes, g), lambda cs: let(player_tables(nodes, g), lambda ls: told(g, h, ts, cs, ls)))
        return let(first(having(inside(nodes, g), "vm-stats-game-header")), lambda h: let(having(inside(nodes, h), "team"), lambda ts: whole(h, ts)))

    return F.filter(F.transform(blocks, one), lambda m: m["team1_score"].isNotNull() & m["team2_score"].isNotNull())


def match_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the fields of a match page in place of ``html``, and ``error``: why there is no record (null if there is one).

    Start times are wall clocks of the site's zone. A page without one has an error, and its other fields are what was found.
    """
    n = F.col("nodes")
    spans = F.transform(F.filter(having(inside(n, first(having(n, "match-header-vs-score"))), tag="span"), lambda s: text_of(n, s).rlike(r"^\d+$")), lambda s: F.struct(text_of(n, s).try_cast("int").alias("v"), has(s, "match-header-vs-score-winner").alias("w")))
    # what several fields use becomes a column of its own
    known = trees(pages, html).withColumns({"_above": first(having(n, "match-header-super")), "_spans": spans, "_status": F.lower(text_of(n, first(having(n, "match-header-vs-note"))))})
    at = lambda *classes, of=n, **more: first(having(of, *classes, **more))
    above, spans = F.col("_above"), F.col("_spans")
    link = at(of=inside(n, above), tag="a")
    event = F.when(link.isNotNull(), text_of(n, F.coalesce(at(of=inside(n, link), tag="div"), link))).otherwise(text_of(n, at(of=inside(n, above), tag="div")))
    status = F.col("_status")
    said = F.when(status.contains("final"), "completed").when(status.contains("live"), "live").when(status != "", "upcoming").otherwise("unknown")
    raw = F.trim(at("moment-tz-convert", attr="data-utc-ts")["attrs"]["data-utc-ts"])
    start = zone_to_utc(F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ss"))))
    score = lambda i: F.when(F.size(spans) >= 2, F.get(spans, F.lit(i))["v"])
    marked = lambda i: F.get(spans, F.lit(i))["w"]
    winner = F.when(F.size(spans) < 2, "").when(marked(0), "team1").when(marked(1), "team2").when(said == "completed", F.when(score(0) > score(1), "team1").otherwise("team2")).otherwise("")
    side = lambda i: at("match-header-link-name", f"mod-{i}")
    name = lambda i: F.split_part(text_of(n, F.coalesce(at("wf-title-med", of=inside(n, side(i))), side(i)), "\n"), F.lit("\n"), F.lit(1))
    team_id = lambda i: F.nullif(F.regexp_extract(at("match-header-link", f"mod-{i}")["attrs"]["href"], r"^/(?:team/)?(\d+)/", 1), F.lit(""))
    length = first(F.filter(F.transform(having(n, "match-header-vs-note"), lambda e: F.regexp_extract(F.lower(text_of(n, e)), r"bo\s*([135])", 1)), lambda t: t != "")).try_cast("int")
    top, total = F.greatest(score(0), score(1)), score(0) + score(1)
    best_of = F.coalesce(length, F.when(top >= 3, 5).when((top == 2) | (total >= 2), 3).when(total == 1, 1), F.lit(3))
    made = {
        "start_ts": start.cast("timestamp_ntz"), "event": event, "series": text_of(n, at("match-header-event-series", of=inside(n, above))), "veto": text_of(n, at("match-header-note")), "status": said,
        **{f"team{i}_{what}": make(i) for i in (1, 2) for what, make in (("id", team_id), ("name", name))}, "team1_maps": score(0), "team2_maps": score(1), "winner": winner, "best_of": best_of,
        "maps": F.when(said == "completed", games_of(n)), "error": F.when(F.size(n) == 0, "empty page").when(start.isNull(), "no start time"),
    }
    return known.select(*(c for c in known.columns if c not in ("nodes", "_above", "_spans", "_status") and c not in made), *(v.alias(k) for k, v in made.items()))


def performance(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per player of a performance tab: lower-cased name, and sums of multi-kills, clutches, plants and defuses over
    the columns that count them. Rows of another width than the header are left out."""
    n = F.col("nodes")
    table = first(having(n, "wf-table-inset", "mod-adv-stats", tag="table"))
    heads = F.transform(having(inside(n, first(having(inside(n, table), tag="thead"))), tag="th"), lambda h: F.upper(text_of(n, h)))
    rest = [c for c in pages.columns if c != html]
    rows = trees(pages, html).select(*rest, "nodes", heads.alias("heads"), F.explode(table_rows(n, table)).alias("cells")).where("size(cells) = size(heads)")
    value = lambda c: F.coalesce(F.when(text_of(n, c).rlike(r"^\d+$"), text_of(n, c)).try_cast("long"), F.lit(0).cast("long"))
    counted = F.transform(F.arrays_zip(F.col("cells").alias("c"), F.col("heads").alias("h")), lambda z: F.struct(z["h"].alias("h"), value(z["c"]).alias("v")))
    total = lambda *names: F.aggregate(F.filter("counted", lambda z: z["h"].isin(*names)), F.lit(0).cast("long"), lambda a, z: a + z["v"])
    cell = F.get("cells", F.lit(0))
    name = F.coalesce(F.nullif(text_of(n, first(having(inside(n, cell), "text-of"))), F.lit("")), F.split_part(text_of(n, cell, "\n"), F.lit("\n"), F.lit(1)))
    out = rows.withColumns({"counted": counted, "name": F.lower(F.trim(name))}).where("name <> ''").where(F.exists("heads", lambda h: h.isin("2K", "3K", "4K", "5K", "1V1", "1V2", "1V3", "1V4", "1V5")))
    return out.select(*rest, "name", total("2K", "3K", "4K", "5K").alias("multikills"), total("1V1", "1V2", "1V3", "1V4", "1V5").alias("clutch_wins"), total("PL", "PLANTS").alias("plants"), total("DE", "DEFUSES").alias("defuses"))
