"""Page trees: nesting, selection, and match pages with every part."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import pagetree


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("<a>x<b>y</b>z</a>w", [(1, 5, "a", None), (2, 2, "#text", "x"), (3, 4, "b", None), (4, 4, "#text", "y"), (5, 5, "#text", "z"), (6, 6, "#text", "w")]),
        ("<ul><li>1<li>2<ul><li>3</ul></ul>", [(1, 8, "ul", None), (2, 3, "li", None), (3, 3, "#text", "1"), (4, 8, "li", None), (5, 5, "#text", "2"), (6, 8, "ul", None), (7, 8, "li", None), (8, 8, "#text", "3")]),
        ("<p>a<br>b</i></p></p><!-- <c> --><SCRIPT>if (a<b) {}</script ><img src='>'>&lt;", [(1, 4, "p", None), (2, 2, "#text", "a"), (3, 3, "br", None), (4, 4, "#text", "b"), (5, 5, "script", None), (6, 6, "img", None), (7, 7, "#text", "<")]),
        ("<div><span>open", [(1, 3, "div", None), (2, 3, "span", None), (3, 3, "#text", "open")]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", [(1, 9, "table", None), (2, 6, "tr", None), (3, 4, "td", None), (4, 4, "#text", "1"), (5, 6, "td", None), (6, 6, "#text", "2"), (7, 9, "tr", None), (8, 9, "td", None), (9, 9, "#text", "3")]),
    ],
)
def test_nesting(html, want):
    assert [(n, last, tag, text) for n, last, tag, _, text in pagetree.parse(html)] == want


def test_long_and_hostile_pages_take_linear_time():
    for html in ("<" * 200_000, "<i>" * 100_000, "</i>" * 100_000, "<p>" * 100_000, "<a '" * 50_000, "<li>x" * 50_000):
        pagetree.parse(html)


def player(name, kills, legacy=False):
    if legacy:
        return f"<tr><td><div class='text-of'>{name}</div>tag<td><img alt='sova'>" + "".join(f"<td><span class='side mod-both'>{v}</span><span class='side mod-t'>9</span>" for v in ("1.1", "210", kills, "11", "4", "+3", "71%", "140.5", "–", "2", "1"))
    cell = lambda col, v: f"<div class='ovw-cell' data-col='{col}'><span class='side mod-t'>0</span><span class='side mod-both'>{v}</span></div>"
    kda = "".join(f"<span class='ovw-kda-stat' data-col='{c}'><b class='side mod-both'>{v}</b></span>" for c, v in (("kills", kills), ("deaths", 11), ("assists", "")))
    return f"<div class='ovw-cell mod-player'><div class='ovw-player-name'> {name} </div><div class='ovw-agents'><img title='jett'></div></div>", f"<div class='ovw-cell mod-kda'>{kda}</div>{cell('acs', 210)}{cell('kast', '71%')}{cell('fb', 2)}{cell('fd', '-')}"


def game(number, label, s1, s2, players, sides=(8, 5, 3, 4)):
    square = lambda win, side, pic: f"<div class='rnd-sq{' mod-win' if win else ''} {side}'>{f'<img src=/i/{pic}.webp>' if win else ''}</div>"
    strip = "<div class='vlr-rounds-row-col mod-spacing'><div class='rnd-sq mod-win'></div></div>" + "".join(
        f"<div class='vlr-rounds-row-col'><div class='rnd-num'>{k}</div>{square(one, side, pic)}{square(not one and pic, side, pic)}</div>" for k, one, side, pic in ((1, True, "mod-t", "elim"), ("", False, "mod-ct", "defuse"), (13, False, "", ""))
    )
    team = lambda s, ct, t: f"<div class='team'><div class='score'> {s} </div><span class='mod-ct'>{ct}</span> / <span class='mod-t'>{t}</span></div>"
    return f"<div class='vm-stats-game' data-game-id='{number}'><div class='vm-stats-game-header'>{team(s1, *sides[:2])}<div class='map'><div>{label}</div><div class='map-duration'>41:03</div></div>{team(s2, *sides[2:])}</div><div class='vlr-rounds'><div>{strip}</div></div>{players}</div>"


def page(maps, score="<span class='match-header-vs-score-winner'>2</span><span>:</span><span>0</span>", ts="2026-07-24 04:00:00", note="final</div><div class='match-header-vs-note'>Bo3"):
    return f"""<html><head><title>t</title></head><body><div class="match-header-super"><div><a href="/event/1"><div>Cup &amp; Co</div><div class="match-header-event-series"> Playoffs:
      <i>Final</i></div></a></div></div><div class="moment-tz-convert" data-utc-ts="{ts}">date</div><a class="match-header-link wf-link mod-1" href="/team/12/alpha"><div class="match-header-link-name mod-1"><div class="wf-title-med">Alpha</div>
      <div>[rank]</div></div></a><div class="match-header-vs"><div class="match-header-vs-note">{note}</div><div class="match-header-vs-score">{score}</div></div><a class="match-header-link mod-2" href="/x"><div class="match-header-link-name mod-2">Beta
      <div>more</div></div></a><div class="match-header-note">Alpha ban Bind</div><div class="vm-stats-game" data-game-id="all"><div class="vm-stats-game-header"></div></div>{maps}</body></html>"""


def test_match_pages(spark):
    cells = [player("Zed", 20), player("amy", "18"), player("Bo", 9), player("Cy", "")]
    overview = "".join(p for p, _ in cells) + "".join(s for _, s in cells)
    tables = "".join(f"<table class='wf-table-inset mod-overview'><thead><tr><th>n</th></tr></thead><tbody>{player(n, 7, True)}<tr><td>short</table>" for n in ("Old", "Older"))
    maps = game(301, "<span>Lotus<span class='picked'>PICK</span></span>", 13, 7, overview) + game(302, "<span class='picked'>DECIDER</span><span>Sunset</span><span>41:03</span>", 13, 4, tables) + game(303, "HavenBAN 41:03", "-", 3, "")
    rows = [(1, page(maps)), (2, page(maps, ts="soon", score="", note="")), (3, None), (4, ""), (5, page("", score="<span>1</span><span>3</span>", note="final")), (6, page(game(7, "Ascent PICK", 1, 13, "")))]
    got = {r.page_id: r for r in pagetree.match_pages(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    r = got[1]
    assert (r.event, r.series, r.veto, r.status, r.team1_id, r.team1_name, r.team2_id, r.team2_name) == ("Cup & Co", "Playoffs:Final", "Alpha ban Bind", "completed", "12", "Alpha", None, "Beta")
    assert (r.start_ts, r.team1_maps, r.team2_maps, r.winner, r.best_of, r.error) == (datetime(2026, 7, 24, 8), 2, 0, "team1", 3, None)
    assert [(m.game_id, m.map_name, m.team1_score, m.team2_score, m.team1_ct, m.team1_t, m.team2_ct, m.team2_t, m.duration) for m in r.maps] == [("301", "Lotus", 13, 7, 8, 5, 3, 4, "41:03"), ("302", "Sunset", 13, 4, 8, 5, 3, 4, "41:03")]
    assert [tuple(x) for x in r.maps[0].rounds] == [(1, "team1", "attack", "elim"), (2, "team2", "defense", "defuse"), (13, "", "", "")]
    assert [[(p.name, p.agent, p.kills, p.deaths, p.assists, p.acs, p.kast_pct, p.fk, p.fd) for p in t] for t in (r.maps[0].team1_players, r.maps[0].team2_players)] == [
        [("Zed", "jett", 20, 11, None, 210.0, 71.0, 2, None), ("amy", "jett", 18, 11, None, 210.0, 71.0, 2, None)],
        [("Bo", "jett", 9, 11, None, 210.0, 71.0, 2, None), ("Cy", "jett", None, 11, None, 210.0, 71.0, 2, None)],
    ]
    assert [[(p.name, p.agent, p.kills, p.acs, p.adr, p.hs_pct, p.fk, p.fd) for p in t] for t in (r.maps[1].team1_players, r.maps[1].team2_players)] == [[("Old", "sova", 7, 210.0, 140.5, None, 2, 1)], [("Older", "sova", 7, 210.0, 140.5, None, 2, 1)]]
    assert (got[2].error, got[2].status, got[2].maps, got[2].best_of) == ("no start time", "unknown", None, 3) and got[3].error == got[4].error == "empty page"
    assert (got[5].winner, got[5].best_of, got[5].maps) == ("team2", 5, []) and [m.map_name for m in got[6].maps] == ["Ascent"]


def test_performance_tab(spark):
    head = "".join(f"<th>{h}</th>" for h in ("", "2K", "3k", "1v1", "ECON", "PL", "DE"))
    rows = "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in cells)}</tr>" for cells in (("<div class='text-of'> Zed </div>x", 3, "1", 2, 50, 4, ""), ("amy<br>tag", "", "2 (x)", 0, 1, 1, 1), ("short", 1), ("", 1, 1, 1, 1, 1, 1)))
    html = f"<table class='wf-table-inset mod-adv-stats'><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, html.replace("2K", "a").replace("3k", "b").replace("1v1", "c"))], "page_id long, html string")
    got = [tuple(r) for r in pagetree.performance(df).orderBy("name").collect()]
    assert got == [(1, "amy", 0, 0, 1, 1), (1, "zed", 4, 2, 4, 0)]


def test_nodes_of_few_pages_are_held_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    texts = ["", "<p>" + "x" * 40, "", "<b>" * 9, "y" * 300, "<i>z"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "html": texts})
    monkeypatch.setattr(pagetree, "CHARS", 64)
    parts = list(pagetree.in_parts(batch, 1))
    assert [p.num_rows for p in parts] == [3, 1, 1, 1] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    monkeypatch.undo()
    assert 32 * len(list(pagetree.in_parts(pa.RecordBatch.from_pydict({"html": ["z" * 2048] * 10_000}), 0))) >= 1_250
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, html string")
    assert [len(r.nodes) for r in pagetree.trees(rows).orderBy("id").collect()] == [len(pagetree.parse(t)) for t in texts]
