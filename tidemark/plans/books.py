"""Queries on the ledger, the price log, stores, names and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import odds
from tidemark.functions.stats import published, rounded
from tidemark.functions.text import contains_text, is_playoff, normalize_name, tier, tournament, url_key
from tidemark.operators import coverage, ledger, linking, markets, summaries
from tidemark.operators import trends as form
from tidemark.sources import pages, pagetree, store
from tidemark.sources import fixtures as fx

with_views = fx.with_views
_R4 = "floor(({}) * 1e4 + 0.5) / 1e4".format
_R3 = "floor(({}) * 1e3 + 0.5) / 1e3".format


def r4(name: str, out: str | None = None):
    return rounded(F.col(name)).alias(out or name)


def _tiered(spark, sf) -> DataFrame:
    return fx.ledger(spark, sf).withColumn("tier", F.substring("event", 1, 1))


def ledger_summary(spark, sf):
    s = ledger.summary(fx.ledger(spark, sf))
    return s.select("n_pending", "n_graded", "n_low_history", "n_scored", *(r4(f"{m}_{p}") for p in ("model", "elo") for m in ("log_loss", "brier", "accuracy")))


def tier_period_metrics(spark, sf):
    t = ledger.tier_metrics(_tiered(spark, sf))
    return t.select("tier", "period", "whole", "n_scored", r4("log_loss_model"), r4("brier_model"), r4("accuracy_model"), r4("log_loss_elo"))


def tier_leaders(spark, sf):
    return ledger.leaders(ledger.tier_metrics(_tiered(spark, sf)).where("whole = 1"))


def checkpoint(spark, sf):
    c = ledger.checkpoint(fx.ledger(spark, sf), F.lit("1995-01-01").cast("timestamp_ntz"))
    return c.select("n", "n_established", "phase", r4("ll_model"), r4("ll_elo"), "primary_met")


def calibration_cells(spark, sf):
    c = ledger.calibration_cells(_tiered(spark, sf), "tier")
    return c.select("tier", "bucket", "n", r4("mean_p"), r4("observed"), r4("low"), r4("high"), "status")


def spiegelhalter(spark, sf):
    return ledger.spiegelhalter(fx.ledger(spark, sf)).select("n", rounded(F.col("z"), 3).alias("z"), "extrapolated")


def calibration_curve(spark, sf):
    c = ledger.calibration_curve(ledger.scored(fx.ledger(spark, sf)))
    return c.select("bin", "n", r4("mean_p"), r4("observed"))


def ece(spark, sf):
    return ledger.expected_calibration_error(ledger.calibration_curve(ledger.scored(fx.ledger(spark, sf)))).select(r4("ece"))


def scoreboard_pending(spark, sf):
    return ledger.scoreboard(fx.ledger(spark, sf))[1].select("match_id", "start_ts", "p_model")


def scoreboard_graded(spark, sf):
    return ledger.scoreboard(fx.ledger(spark, sf))[0].select("match_id", "start_ts", "team1_won")


def capture_state(spark, sf):
    rows = fx.captures(spark, sf).withColumn("book_event_id", F.col("match_id")).withColumn("match_id", F.when(F.col("match_id") % 4 != 0, F.col("match_id")))
    return markets.capture_state(rows).select("source", "slot", "market", "freeze", "close")


def entry_close(spark, sf):
    e = markets.entry_close(fx.captures(spark, sf))
    return e.select("match_id", "market", "source", F.col("entry.captured_at").alias("entry_at"), F.col("entry.price_home").alias("entry_home"), F.col("close.captured_at").alias("close_at"), F.col("close.price_home").alias("close_home"), "n_unorientable")


def devig(spark, sf):
    c = fx.captures(spark, sf)
    d = c.select("match_id", "seq", odds.devig(F.col("price_home"), F.col("price_away")).alias("d"))
    return d.select("match_id", "seq", *(rounded(F.col(f"d.{x}")).alias(x) for x in ("implied", "overround", "shin", "multiplicative")))


def _priced_ledger(spark, sf) -> DataFrame:
    dist = F.create_map(F.lit("2"), F.col("p_elo"), F.lit("3"), 1 - F.col("p_elo"))
    return _tiered(spark, sf).withColumn("p_maps_dist", F.when(F.col("match_id") % 5 != 0, dist)).select("match_id", "p_model", "graded", "team1_won", "maps_played", "p_maps_dist", "event", "start_ts")


def _picked(spark, sf) -> DataFrame:
    return markets.picks(fx.captures(spark, sf), _priced_ledger(spark, sf))


def picks(spark, sf):
    p = _picked(spark, sf)
    return p.select("match_id", "market", "side", "source", "n_books", r4("p"), r4("price_entry"), r4("shin"), r4("shin_consensus"), r4("ev"), r4("clv"), "extrapolated", "won", "entry_at", "ev_excluded")


def market_agg(spark, sf):
    a = markets.market_aggregates(_picked(spark, sf).withColumn("tier", F.substring("event", 1, 1)))
    return a.select("tier", "market", F.col("level").cast("int").alias("level"), "n_covered", "n_graded", "n_extrapolated", "n_ev_excluded", *(rounded(F.col(c), 3).alias(c) for c in ("win_rate", "avg_ev", "avg_clv", "beat_close_rate")), "ev_validated")


def unit_tracker(spark, sf):
    return markets.unit_tracker(_picked(spark, sf)).select("n_staked", "n_wins", rounded(F.col("units_staked"), 2).alias("units_staked"), rounded(F.col("units_pnl"), 2).alias("units_pnl"), r4("roi"), rounded(F.col("flat_pnl"), 2).alias("flat_pnl"))


def skipped_counts(spark, sf):
    return markets.skipped(fx.captures(spark, sf), _priced_ledger(spark, sf))


def coverage_partition(spark, sf):
    caps, led = fx.captures(spark, sf), _priced_ledger(spark, sf)
    return coverage.counts(coverage.partition(led.where("graded"), caps, markets.picks(caps, led), first_capture=F.lit("1994-01-01").cast("timestamp_ntz")))


def capture_log(spark, sf):
    return coverage.log_statistics(fx.captures(spark, sf))


def _unlinked(spark, sf) -> DataFrame:
    c = fx.captures(spark, sf)
    return c.select("match_id", "seq", "source", "market", "line", "captured_at", F.col("match_id").alias("book_event_id")).withColumn("match_id", F.when(F.col("match_id") % 3 == 0, F.col("match_id")))


def dedupe_unlinked(spark, sf):
    return linking.dedupe_unlinked(_unlinked(spark, sf)).select("source", "book_event_id", "market", "line", "captured_at", "seq")


def _fixtures(spark, sf) -> DataFrame:
    """Book fixtures named after two customers, one of them sometimes by an alias, in either order."""
    o = fx.table(spark, sf, "orders")
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    a, b = name(F.col("o_custkey")), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("CUST "), (F.col("o_custkey") + 1).cast("string"))).otherwise(name(F.col("o_custkey") + 1))
    flip = F.col("o_orderkey") % 4 == 0
    return o.select(F.col("o_orderkey").alias("fixture_id"), F.when(flip, b).otherwise(a).alias("book_home"), F.when(flip, a).otherwise(b).alias("book_away"), F.when(F.col("o_orderkey") % 5 != 0, F.expr("o_orderdate + INTERVAL 3 HOUR")).alias("book_start_ts"))


def _predictions(spark, sf) -> DataFrame:
    o = fx.table(spark, sf, "orders")
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    return o.select(F.col("o_orderkey").alias("match_id"), name(F.col("o_custkey")).alias("team1_name"), name(F.col("o_custkey") + 1).alias("team2_name"), F.col("o_orderdate").alias("start_ts"), F.col("o_orderkey").alias("position"))


def _aliases(spark, sf) -> DataFrame:
    c = fx.table(spark, sf, "customer")
    return c.select(F.concat(F.lit("CUST "), F.col("c_custkey").cast("string")).alias("alias"), F.col("c_name").alias("canonical"))


def link_fixture(spark, sf):
    return linking.link_fixtures(_fixtures(spark, sf), _predictions(spark, sf), _aliases(spark, sf)).select("fixture_id", "match_id", "book_home_is_team1", "method")


def retro_match(spark, sf):
    f = _fixtures(spark, sf).withColumn("match_id", F.lit(None).cast("long")).withColumn("captured_at", F.col("book_start_ts")).withColumn("captured_at", F.coalesce("captured_at", F.lit("1995-01-01").cast("timestamp_ntz")))
    return linking.retro_match(f, _predictions(spark, sf), _aliases(spark, sf)).select("match_id", "fixture_id", "method", "rule")


def fuzzy_top(spark, sf):
    """All suppliers at home, as books shorten or lengthen their names, each against a visitor of its own (letters of a
    hash); every third book name is the number alone, and every fourth pair is the other way round."""
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("one"), F.left(F.md5("s_name"), F.lit(16)).alias("two"))
    home = F.when(F.col("k") % 3 == 0, F.concat(F.regexp_extract("one", "[0-9]+", 0), F.lit(" FC"))).otherwise(F.concat(F.lit("Team "), "one"))
    away = F.concat("two", F.lit(" Gaming"))
    flip = F.col("k") % 4 == 0
    fixtures = s.select(F.col("k").alias("fixture_id"), F.when(flip, away).otherwise(home).alias("book_home"), F.when(flip, home).otherwise(away).alias("book_away"))
    predictions = s.select(F.col("k").alias("match_id"), F.col("one").alias("team1_name"), F.concat("two", F.lit(" Esports")).alias("team2_name"))
    return linking.fuzzy_links(fixtures, predictions)


def _rows(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("status"))


def upsert(spark, sf):
    rows = _rows(spark, sf)
    old = rows.where("match_id % 3 <> 0")
    first = rows.where("match_id % 2 = 0").withColumn("v", F.when(F.col("match_id") % 4 == 0, F.col("v") + 1).otherwise(F.col("v"))).withColumn("position", F.lit(1))
    again = rows.where("match_id % 10 = 0").withColumn("v", F.col("v") + 2).withColumn("position", F.lit(2))
    return store.upsert(old, first.unionByName(again))


def ledger_insert(spark, sf):
    led = fx.ledger(spark, sf).select("match_id", "start_ts")
    new = led.where("match_id % 2 = 0").withColumn("position", F.col("match_id")).unionByName(led.where("match_id % 6 = 0").withColumn("position", F.col("match_id") + 1))
    out = ledger.insert_status(new, led.where("match_id % 5 = 0"), F.lit("1995-01-01").cast("timestamp_ntz"))
    return out.select("match_id", "position", "status")


def ingest_dedupe(spark, sf):
    c = fx.captures(spark, sf)
    keys = ("match_id", "market", "line", "source", "capture_kind")
    log = c.where("seq % 2 = 0").select(*keys)
    return store.new_only(c.where("seq % 2 = 1").select(*keys), log, keys)


def grade(spark, sf):
    led = fx.ledger(spark, sf).select("match_id", "graded", "team1_won", "maps_played")
    results = led.where("match_id % 3 = 0").select("match_id", F.lit(1).alias("team1_won"), F.lit(3).alias("maps_played"))
    return ledger.grade(led, results)


EVENTS = ("VCT 2025 Game Changers EMEA - Group Stage", "Challengers League  NA: Week 3", "Champions Tour Pacific - Playoffs: Day 1", "Masters Bangkok   Swiss", "Show match", "Evolution Series VCT Grand Final", "")
ROUNDS = ("Upper Bracket Final", "Week 1", "SEMIFINALS", "")


def names(spark, sf):
    """Customers' names, and events and rounds of every kind by their keys."""
    c = fx.table(spark, sf, "customer")
    of = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values)).cast("int"))
    return c.select("c_custkey", normalize_name("c_name").alias("norm"), tier(of(EVENTS)).alias("tier"), is_playoff(of(ROUNDS)).alias("playoff"), tournament(of(EVENTS)).alias("tournament"))


def published_probability(spark, sf):
    return fx.ledger(spark, sf).select("match_id", published(F.col("p_model")).alias("p"))


def page_fields(spark, sf):
    return pages.page_fields(fx.table(spark, sf, "pages"))


def page_links(spark, sf):
    return pages.links(fx.table(spark, sf, "pages"))


def url_keys(spark, sf):
    """Cache names of the pages whose address holds a text."""
    return fx.table(spark, sf, "pages").where(contains_text("url", " Example.ORG/e")).select("page_id", url_key("url").alias("key"))


def page_cards(spark, sf):
    """Entries of the pages' menus: links to a page of this site, the first of each address."""
    return pages.cards(fx.table(spark, sf, "pages"), r"^/([^/?#]+)")


def page_match(spark, sf):
    """Match pages that are written from contests, read again: header, score, one map with its rounds."""
    c = fx.contests(spark, sf)
    t = lambda x: F.lit(x)
    s = lambda x: F.col(x).cast("string")
    won = F.col("team1_score") > F.col("team2_score")
    side = lambda i: (t(f"<a class='match-header-link mod-{i}' href='/team/"), s(f"team{i}"), t(f"/x'><div class='match-header-link-name mod-{i}'><div class='wf-title-med'>T"), s(f"team{i}"), t("</div></div></a>"))
    score = lambda i, ok: (t("<span class='"), F.when(ok, "match-header-vs-score-winner").otherwise("loser"), t("'>"), s(f"team{i}_score"), t("</span>"))
    block = lambda i: (t("<div class='team'><div class='score'> "), s(f"team{i}_score"), t(" </div><span class='mod-ct'>"), s("best_of"), t("</span></div>"))
    rounds = F.array_join(F.transform(F.sequence(t(1), F.col("best_of")), lambda k: F.concat(t("<div class='vlr-rounds-row-col'><div class='rnd-num'>"), k.cast("string"), t("</div><div class='rnd-sq"), F.when((F.col("match_id") + k) % 3 == 0, " mod-win mod-t").otherwise(""), t("'></div><div class='rnd-sq"), F.when((F.col("match_id") + k) % 3 == 1, " mod-win mod-ct").otherwise(""), t("'><img src='/i/boom.webp'></div></div>"))), "")
    html = F.concat(
        t("<html><body><div class='match-header-super'><div><a href='/e'><div>"), F.col("map_name"), t(" &amp; more</div><div class='match-header-event-series'>"), F.col("series"), t("</div></a></div></div><div class='moment-tz-convert' data-utc-ts='"), F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss"), t("'>x</div>"),
        *side(1), t("<div class='match-header-vs'><div class='match-header-vs-note'>final</div><div class='match-header-vs-score'>"), *score(1, won), t("<span>:</span>"), *score(2, ~won), t("</div><div class='match-header-vs-note'>Bo"), s("best_of"), t("</div></div>"), *side(2),
        t("<div class='vm-stats-game' data-game-id='"), s("match_id"), t("'><div class='vm-stats-game-header'>"), *block(1), t("<div class='map'><span>"), F.col("map_name"), t("<span class='picked'>PICK</span></span></div>"), *block(2), t("</div><div class='vlr-rounds'>"), rounds, t("</div></div></body></html>"),
    )
    out = pagetree.match_pages(c.select("match_id", html.alias("html")))
    m = F.get("maps", F.lit(0))
    told = F.array_join(F.transform(m["rounds"], lambda r: F.concat_ws("-", r["number"].cast("string"), r["winner"], r["side"], r["win_method"])), ";")
    return out.select("match_id", "start_ts", "event", "series", "status", "team1_id", "team1_name", "team2_id", "team2_name", "team1_maps", "team2_maps", "winner", "best_of", "error", m["map_name"].alias("map_name"), m["team1_score"].alias("team1_score"), m["team2_score"].alias("team2_score"), m["team1_ct"].alias("team1_ct"), told.alias("rounds"))


def daily_summaries(spark, sf):
    """Rows and distinct users of each week from daily sketches, beside exact counts; the estimate is judged, not shown."""
    e = fx.table(spark, sf, "events").select("ts", "user_id", "event_type")
    week = F.date_trunc("week", "ts").cast("date").alias("week")
    days = summaries.by_day(e, "ts", "user_id")
    guess = summaries.merged(days, F.date_trunc("week", "day").cast("date").alias("week")).select("week", F.col("n").alias("rows_merged"), F.col("n_distinct").alias("guess"))
    exact = summaries.distinct_values(e, "user_id", week).join(guess, "week")
    near = F.abs(F.col("guess") - F.col("n_distinct")) <= 4 * summaries.standard_error() * F.col("n_distinct") + 1
    return exact.select("week", "n", "rows_merged", "n_distinct", near.alias("estimate_near"))


def value_counts(spark, sf):
    return summaries.value_counts(fx.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


def linear_fit(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    out = summaries.linear_fit(rows, "x", "y", 1_000_000.0, "l_returnflag")
    return out.select("l_returnflag", "n", rounded(F.col("slope"), 3).alias("slope"), rounded(F.col("intercept"), 3).alias("intercept"), rounded(F.col("crossing"), 3).alias("crossing"))


def last_rows(spark, sf):
    e = fx.table(spark, sf, "events").select("user_id", "event_id", "ts")
    return form.last_rows(e, "user_id", 5, ["ts", "event_id"])


QUERIES = {f.__name__: f for f in (ledger_summary, tier_period_metrics, tier_leaders, checkpoint, calibration_cells, spiegelhalter, calibration_curve, ece, scoreboard_pending, scoreboard_graded, capture_state, entry_close, devig, picks, market_agg, unit_tracker, skipped_counts, coverage_partition, capture_log, dedupe_unlinked, link_fixture, retro_match, fuzzy_top, upsert, ledger_insert, ingest_dedupe, grade, names, published_probability, page_fields, page_links, url_keys, page_cards, page_match, daily_summaries, value_counts, linear_fit, last_rows)}

_CLIP = "least(greatest({0}, 1e-6), 1 - 1e-6)".format
_LL = lambda p: f"-(team1_won * ln({_CLIP(p)}) + (1 - team1_won) * ln(1 - {_CLIP(p)}))"
_BR = lambda p: f"({p} - team1_won) * ({p} - team1_won)"
_ACC = lambda p, op=">=": f"CASE WHEN ({p} {op} 0.5) = (team1_won = 1) THEN 1.0::DOUBLE ELSE 0.0 END"
_SCORED = "scored AS (SELECT *, left(event, 1) AS tier, year(made_at) || 'H' || CASE WHEN month(made_at) <= 6 THEN 1 ELSE 2 END AS period FROM ledger WHERE graded AND NOT low_history)"
_BUCKET = "CASE WHEN p_model < 0.15 THEN 'extrapolation_low' WHEN p_model > 0.88 THEN 'extrapolation_high' WHEN p_model <= 0.35 THEN '[0.15,0.35]' WHEN p_model <= 0.50 THEN '[0.35,0.50]' WHEN p_model <= 0.65 THEN '[0.50,0.65]' ELSE '[0.65,0.88]' END"
_LO = "greatest(0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n))"
_HI = _LO.replace("greatest(0", "least(1").replace("- 1.96", "+ 1.96")
_EDGES = "e AS (SELECT list_sort(list_distinct(quantile_cont(p_model, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS q FROM scored), b AS (SELECT p_model, team1_won, len(list_filter(q[2:len(q) - 1], lambda x: p_model > x)) AS bin FROM scored, e), curve AS (SELECT bin, count(*) AS n, avg(p_model) AS mean_p, avg(team1_won) AS observed FROM b GROUP BY bin)"
_OK = "(price_home > 1 AND isfinite(price_home) AND price_away > 1 AND isfinite(price_away))"
_ORI = "(market <> 'series_moneyline' OR book_home_is_team1 IS NOT NULL)"
_SHIN = lambda a, b: f"CASE WHEN 1 / {a} + 1 / {b} <= 1 + 1e-12 THEN (1 / {a}) / (1 / {a} + 1 / {b}) ELSE 1 / {a} - (1 / {a} + 1 / {b} - 1) / 2 END"
_ENTRY = f"""good AS (SELECT *, {_ORI} AS ori FROM captures WHERE {_OK}),
ec AS (SELECT match_id, market, line, source,
  coalesce(arg_min({{'a': captured_at, 'k': capture_kind, 'h': price_home, 'w': price_away, 'o': book_home_is_team1}}, (captured_at, seq, price_home, price_away)) FILTER (ori AND capture_kind = 'freeze'),
           arg_min({{'a': captured_at, 'k': capture_kind, 'h': price_home, 'w': price_away, 'o': book_home_is_team1}}, (captured_at, seq, price_home, price_away)) FILTER (ori)) AS e,
  arg_max({{'a': captured_at, 'k': capture_kind, 'h': price_home, 'w': price_away, 'o': book_home_is_team1}}, (captured_at, seq, price_home, price_away)) FILTER (capture_kind <> 'freeze') AS c,
  count(*) FILTER (NOT ori) AS n_unorientable FROM good GROUP BY ALL)"""
_SIDE = lambda c, s: f"CASE WHEN market <> 'series_moneyline' OR {c}.o THEN {c}.{'hw'[s]} WHEN NOT {c}.o THEN {c}.{'wh'[s]} END"
_PRICED = f"""led AS (SELECT *, CASE WHEN match_id % 5 <> 0 THEN 1 - p_elo END AS p_over FROM ledger),
pr AS (SELECT ec.*, led.* EXCLUDE (match_id), CASE WHEN market = 'series_moneyline' THEN p_model WHEN line IS NOT NULL THEN p_over END AS p0, {_SIDE("e", 0)} AS x0, {_SIDE("e", 1)} AS x1, {_SIDE("c", 0)} AS c0, {_SIDE("c", 1)} AS c1,
  CASE source WHEN 'pinnacle' THEN 0 WHEN 'cloudbet' THEN 1 ELSE 2 END AS rk FROM ec JOIN led USING (match_id) WHERE e IS NOT NULL),
gr AS (SELECT match_id, market, line, count(*) AS n_books, any_value(p0) AS p0, any_value(event) AS event, any_value(graded) AS graded, any_value(team1_won) AS team1_won, any_value(maps_played) AS maps_played,
  arg_max({{'p': x0, 's': source, 'e': e, 'c': c0, 'y': x1}}, (x0, -rk)) AS b0, arg_max({{'p': x1, 's': source, 'e': e, 'c': c1, 'y': x0}}, (x1, -rk)) AS b1, quantile_cont({_SHIN("x0", "x1")}, 0.5) AS fair0
  FROM pr WHERE p0 IS NOT NULL GROUP BY match_id, market, line),
ch AS (SELECT *, CASE WHEN p0 * b0.p - 1 >= (1 - p0) * b1.p - 1 THEN 0 ELSE 1 END AS side FROM gr),
pk AS (SELECT match_id, market, line, side, event, CASE WHEN side = 0 THEN b0 ELSE b1 END AS b, n_books, CASE WHEN side = 0 THEN p0 ELSE 1 - p0 END AS p, CASE WHEN side = 0 THEN fair0 ELSE 1 - fair0 END AS fair,
  CASE WHEN graded THEN CASE WHEN market = 'series_moneyline' THEN team1_won = 1 ELSE maps_played > line END = (side = 0) END AS won FROM ch),
picks AS (SELECT match_id, market, line, side, event, b.s AS source, n_books, p, b.p AS price_entry, {_SHIN("b.p", "b.y")} AS shin, fair AS shin_consensus, p * b.p - 1 AS ev, CASE WHEN b.e.k = 'freeze' THEN b.p / b.c - 1 END AS clv,
  NOT (p BETWEEN 0.15 AND 0.88) AS extrapolated, won, b.e.a AS entry_at, CASE WHEN NOT (p BETWEEN 0.15 AND 0.88) THEN 'extrapolation' WHEN market = 'maps_total' THEN 'totals_independence_bias' END AS ev_excluded FROM pk)"""
_PICKS = f"{with_views('captures', 'ledger')}, {_ENTRY}, {_PRICED}"
_NAME = lambda k: f"'Customer#' || lpad(({k})::VARCHAR, 9, '0')"
_NORM = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
_LINK = f"""WITH f AS (SELECT o_orderkey AS fixture_id, {_NAME("o_custkey")} AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'CUST ' || (o_custkey + 1) ELSE {_NAME("o_custkey + 1")} END AS b, o_orderkey % 4 = 0 AS flip,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 3 HOUR END AS bs FROM orders),
fx AS (SELECT fixture_id, {_NORM("CASE WHEN flip THEN b ELSE a END")} AS h, {_NORM("CASE WHEN flip THEN a ELSE b END")} AS w, bs FROM f),
al AS (SELECT {_NORM("'CUST ' || c_custkey")} AS k, {_NORM("c_name")} AS v FROM customer),
ax AS (SELECT fixture_id, bs, h, w, coalesce(x.v, h) AS h2, coalesce(y.v, w) AS w2 FROM fx LEFT JOIN al x ON x.k = h LEFT JOIN al y ON y.k = w),
keyed AS (SELECT fixture_id, bs, 0 AS m, h, w FROM ax UNION ALL SELECT fixture_id, bs, 1, h2, w2 FROM ax WHERE h <> h2 OR w <> w2),
p AS (SELECT o_orderkey AS match_id, {_NORM(_NAME("o_custkey"))} AS t1, {_NORM(_NAME("o_custkey + 1"))} AS t2, o_orderdate AS start_ts FROM orders)"""

#: All fixtures against all predictions by the rungs above the ratio, which no two of the visitors' names reach.
_FUZZY_SQL = """WITH pairs AS (SELECT s_suppkey AS k, ['supplier', regexp_extract(s_name, '[0-9]+')] AS one, [left(md5(s_name), 16)] AS two FROM supplier),
named AS (SELECT *, CASE WHEN k % 3 = 0 THEN one[2:2] ELSE one END AS home FROM pairs),
f AS (SELECT k AS fixture_id, CASE WHEN k % 4 = 0 THEN two ELSE home END AS h, CASE WHEN k % 4 = 0 THEN home ELSE two END AS a FROM named),
met AS (SELECT fixture_id, k AS match_id, unnest([{'x': [h, one], 'y': [a, two], 's': TRUE}, {'x': [h, two], 'y': [a, one], 's': FALSE}]) AS m FROM f, pairs),
scored AS (SELECT fixture_id, match_id, m.s AS s, list_min(list_transform([m.x, m.y], lambda z: CASE WHEN z[1] = z[2] THEN 1.0::DOUBLE WHEN list_has_all(z[1], z[2]) OR list_has_all(z[2], z[1]) THEN 0.92::DOUBLE ELSE 0.0::DOUBLE END)) AS v FROM met),
best AS (SELECT fixture_id, match_id, max(v) AS score, arg_max(s, (v, s)) AS s FROM scored GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt, lead(match_id) OVER w AS other FROM best WINDOW w AS (PARTITION BY fixture_id ORDER BY score DESC, match_id))
SELECT fixture_id, match_id, score, s AS book_home_is_team1, CASE WHEN nxt >= 0.75 AND score - nxt < 0.05 THEN other END AS ambiguous_with FROM ranked WHERE r = 1 AND score >= 0.75"""
_VISIBLE_SQL = r"""v AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g') AS h FROM pages),
found AS (SELECT page_id, regexp_extract_all(h, '(?is)<a\s[^>]*href\s*=\s*[\x22\x27][^\x22\x27]*[\x22\x27][^>]*>.*?</a\s*>') AS a FROM v), each_link AS (SELECT page_id, unnest(a) AS a, CAST(generate_subscripts(a, 1) - 1 AS INT) AS position FROM found),
links AS (SELECT page_id, position, regexp_extract(a, '(?is)href\s*=\s*[\x22\x27]([^\x22\x27]*)[\x22\x27]', 1) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM each_link)"""
ORACLES = {
    "fuzzy_top": _FUZZY_SQL,
    "url_keys": "SELECT page_id, sha1(url) AS key FROM pages WHERE contains(lower(url), 'example.org/e')",
    "page_links": f"WITH {_VISIBLE_SQL} SELECT page_id, position, href, text FROM links",
    "page_cards": f"WITH {_VISIBLE_SQL} SELECT page_id, regexp_extract(href, '^/([^/?#]+)', 1) AS id, arg_min(text, position) AS text, min(position) AS position FROM links WHERE regexp_extract(href, '^/([^/?#]+)', 1) <> '' GROUP BY 1, 2",
    "page_match": f"""{with_views("contests")} SELECT match_id, timezone('UTC', timezone('America/New_York', date_trunc('second', start_ts))) AS start_ts, map_name || ' & more' AS event, series, 'completed' AS status,
       CAST(team1 AS VARCHAR) AS team1_id, 'T' || team1 AS team1_name, CAST(team2 AS VARCHAR) AS team2_id, 'T' || team2 AS team2_name, team1_score AS team1_maps, team2_score AS team2_maps, CASE WHEN team1_score > team2_score THEN 'team1' ELSE 'team2' END AS winner, best_of,
       NULL::VARCHAR AS error, map_name, team1_score, team2_score, best_of AS team1_ct,
       array_to_string(list_transform(range(1, best_of + 1), lambda k: k || CASE (match_id + k) % 3 WHEN 0 THEN '-team1-attack-' WHEN 1 THEN '-team2-defense-boom' ELSE '---' END), ';') AS rounds FROM contests""",
    "daily_summaries": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, count(*) AS rows_merged, count(DISTINCT user_id) AS n_distinct, TRUE AS estimate_near FROM events GROUP BY 1",
    "value_counts": "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "linear_fit": f"""WITH f AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE) AS b, regr_intercept(l_extendedprice::DOUBLE, l_quantity::DOUBLE) AS a FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, {_R3("b")} AS slope, {_R3("a")} AS intercept, CASE WHEN b > 0 THEN {_R3("(1e6 - a) / b")} END AS crossing FROM f""",
    "ledger_summary": f"{with_views('ledger')} SELECT count(*) FILTER (NOT graded) AS n_pending, count(*) FILTER (graded) AS n_graded, count(*) FILTER (graded AND low_history) AS n_low_history, count(*) FILTER (graded AND NOT low_history) AS n_scored, "
    + ", ".join(f"{_R4(f'avg({g(p)}) FILTER (graded AND NOT low_history)')} AS {m}_{s}" for p, s in (("p_model", "model"), ("p_elo", "elo")) for m, g in (("log_loss", _LL), ("brier", _BR), ("accuracy", _ACC))) + " FROM ledger",
    "tier_period_metrics": f"{with_views('ledger')}, {_SCORED} SELECT tier, period, CAST(grouping(period) AS INT) AS whole, count(*) AS n_scored, {_R4(f'avg({_LL("p_model")})')} AS log_loss_model, {_R4(f'avg({_BR("p_model")})')} AS brier_model, {_R4(f'avg({_ACC("p_model", ">")})')} AS accuracy_model, {_R4(f'avg({_LL("p_elo")})')} AS log_loss_elo FROM scored GROUP BY GROUPING SETS ((tier), (tier, period))",
    "tier_leaders": f"{with_views('ledger')}, {_SCORED}, t AS (SELECT avg({_LL('p_model')}) AS m, avg({_LL('p_elo')}) AS e FROM scored GROUP BY tier) SELECT count(*) FILTER (m < e) AS model_leads, count(*) FILTER (e < m) AS elo_leads, count(*) AS n FROM t",
    "checkpoint": f"{with_views('ledger')}, era AS (SELECT * FROM ledger WHERE graded AND made_at >= TIMESTAMP '1995-01-01'), s AS (SELECT count(*) FILTER (low_history) AS n, count(*) FILTER (NOT low_history) AS n_established, avg({_LL('p_model')}) FILTER (low_history) AS m, avg({_LL('p_elo')}) FILTER (low_history) AS e FROM era) SELECT n, n_established, CASE WHEN n < 30 THEN 'accumulating' WHEN n < 50 THEN 'directional' ELSE 'decision' END AS phase, CASE WHEN n >= 30 THEN {_R4('m')} END AS ll_model, CASE WHEN n >= 30 THEN {_R4('e')} END AS ll_elo, CASE WHEN n >= 50 THEN m < e END AS primary_met FROM s",
    "calibration_cells": f"{with_views('ledger')}, c AS (SELECT left(event, 1) AS tier, {_BUCKET} AS bucket, count(*) AS n, avg(p_model) AS mean_p, sum(team1_won)::DOUBLE AS k FROM ledger WHERE graded GROUP BY 1, 2), w AS (SELECT *, {_LO} AS lo, {_HI} AS hi FROM c) SELECT tier, bucket, n, {_R4('mean_p')} AS mean_p, {_R4('k / n')} AS observed, {_R4('lo')} AS low, {_R4('hi')} AS high, CASE WHEN n < 30 THEN 'insufficient' WHEN n < 100 THEN 'reported' WHEN mean_p < lo OR mean_p > hi THEN 'DRIFT' ELSE 'ok' END AS status FROM w",
    "spiegelhalter": f"{with_views('ledger')} SELECT count(*) AS n, floor(sum((team1_won - p_model) * (1 - 2 * p_model)) / sqrt(sum((1 - 2 * p_model) * (1 - 2 * p_model) * p_model * (1 - p_model))) * 1e3 + 0.5) / 1e3 AS z, count(*) FILTER (p_model < 0.15 OR p_model > 0.88) AS extrapolated FROM ledger WHERE graded",
    "calibration_curve": f"{with_views('ledger')}, {_SCORED}, {_EDGES} SELECT bin, n, {_R4('mean_p')} AS mean_p, {_R4('observed')} AS observed FROM curve",
    "ece": f"{with_views('ledger')}, {_SCORED}, {_EDGES} SELECT {_R4('sum(n * abs(mean_p - observed)) / sum(n)')} AS ece FROM curve",
    "scoreboard_pending": f"{with_views('ledger')} SELECT match_id, start_ts, p_model FROM ledger WHERE NOT graded ORDER BY start_ts, match_id LIMIT 500",
    "scoreboard_graded": f"{with_views('ledger')} SELECT match_id, start_ts, team1_won FROM ledger WHERE graded ORDER BY start_ts DESC, match_id LIMIT 300",
    "capture_state": f"{with_views('captures')} SELECT source, CASE WHEN match_id % 4 <> 0 THEN match_id::VARCHAR ELSE 'book:' || match_id END AS slot, market, bool_or(capture_kind = 'freeze') AS freeze, bool_or(capture_kind = 'close') AS close FROM captures GROUP BY 1, 2, 3, line",
    "entry_close": f"{with_views('captures')}, {_ENTRY} SELECT match_id, market, source, e.a AS entry_at, e.h AS entry_home, c.a AS close_at, c.h AS close_home, n_unorientable FROM ec",
    "devig": f"{with_views('captures')}, q AS (SELECT match_id, seq, CASE WHEN price_home > 1 THEN 1 / price_home END AS a, CASE WHEN price_away > 1 THEN 1 / price_away END AS b FROM captures) SELECT match_id, seq, {_R4('a')} AS implied, {_R4('a + b - 1')} AS overround, {_R4('CASE WHEN a + b <= 1 + 1e-12 THEN a / (a + b) ELSE a - (a + b - 1) / 2 END')} AS shin, {_R4('a / (a + b)')} AS multiplicative FROM q",
    "picks": f"{_PICKS} SELECT match_id, market, side, source, n_books, {_R4('p')} AS p, {_R4('price_entry')} AS price_entry, {_R4('shin')} AS shin, {_R4('shin_consensus')} AS shin_consensus, {_R4('ev')} AS ev, {_R4('clv')} AS clv, extrapolated, won, entry_at, ev_excluded FROM picks",
    "market_agg": f"{_PICKS}, t AS (SELECT *, left(event, 1) AS tier, won IS NOT NULL AND ev_excluded IS NULL AS core FROM picks) SELECT tier, market, CAST(grouping(tier, market) AS INT) AS level, count(*) AS n_covered, count(won) AS n_graded, count(*) FILTER (extrapolated) AS n_extrapolated, count(ev_excluded) AS n_ev_excluded, "
    + ", ".join(f"floor(({x}) * 1e3 + 0.5) / 1e3 AS {n}" for n, x in (("win_rate", "avg(won::INT)"), ("avg_ev", "avg(ev) FILTER (core)"), ("avg_clv", "avg(clv) FILTER (core)"), ("beat_close_rate", "avg((clv > 0)::INT) FILTER (core AND clv IS NOT NULL)"))) + ", count(*) FILTER (core) >= 100 AS ev_validated FROM t GROUP BY GROUPING SETS ((), (tier), (market))",
    "unit_tracker": f"{_PICKS}, r AS (SELECT *, least(25 * least(ev, 0.10::DOUBLE) / (price_entry - 1), 3) AS stake, CASE WHEN won THEN price_entry - 1 ELSE -1 END AS gain FROM picks WHERE market = 'series_moneyline' AND won IS NOT NULL AND ev_excluded IS NULL AND ev > 0) SELECT count(*) AS n_staked, count(*) FILTER (won) AS n_wins, floor(sum(stake) * 100 + 0.5) / 100 AS units_staked, floor(sum(stake * gain) * 100 + 0.5) / 100 AS units_pnl, {_R4('sum(stake * gain) / sum(stake)')} AS roi, floor(sum(gain) * 100 + 0.5) / 100 AS flat_pnl FROM r",
    "skipped_counts": f"{with_views('captures', 'ledger')}, r AS (SELECT captures.*, {_OK} AS ok, {_ORI} AS ori FROM captures JOIN ledger USING (match_id)), g AS (SELECT bool_or(ori AND (market = 'series_moneyline' OR match_id % 5 <> 0)) AS fine FROM r WHERE ok GROUP BY match_id, market, line) SELECT 'n_unpriceable' AS counter, count(*) FILTER (NOT ok) AS n FROM r UNION ALL SELECT 'n_unorientable', count(*) FILTER (ok AND NOT ori) FROM r UNION ALL SELECT 'n_groups_unpriced', count(*) FILTER (NOT fine) FROM g",
    "coverage_partition": f"""{_PICKS}, s AS (SELECT match_id, count(*) AS n, count(*) FILTER ({_OK}) AS ok, count(*) FILTER ({_OK} AND market = 'series_moneyline') AS money, count(*) FILTER ({_OK} AND market = 'series_moneyline' AND book_home_is_team1 IS NOT NULL) AS oriented FROM captures GROUP BY 1),
x AS (SELECT CASE WHEN match_id IN (SELECT match_id FROM picks) THEN '1_covered' WHEN n > 0 AND ok = 0 THEN '3_linked_unpriceable' WHEN ok > 0 AND money = 0 AND match_id % 5 <> 0 THEN '2c_unexplained' WHEN ok > 0 AND money = 0 THEN '2a_totals_only_no_dist' WHEN ok > 0 AND oriented = 0 THEN '2b_orientation_missing' WHEN ok > 0 THEN '2c_unexplained' WHEN start_ts < TIMESTAMP '1994-01-01' THEN '5a_pre_capture_era' ELSE '5b_never_listed' END AS bucket FROM ledger LEFT JOIN s USING (match_id) WHERE graded)
SELECT bucket, count(*) AS n FROM x GROUP BY 1""",
    "capture_log": f"{with_views('captures')} SELECT source, min(captured_at) AS first, max(captured_at) AS last, count(*) AS n, count(DISTINCT match_id) AS n_matches FROM captures GROUP BY 1",
    "dedupe_unlinked": f"{with_views('captures')} SELECT source, match_id AS book_event_id, market, line, captured_at, seq FROM (SELECT *, row_number() OVER (PARTITION BY source, match_id, market, line ORDER BY captured_at, seq) AS r FROM captures WHERE match_id % 3 <> 0) WHERE r = 1",
    "link_fixture": f"{_LINK}, hit AS (SELECT fixture_id, match_id, h = t1 AS o, m, row_number() OVER (PARTITION BY fixture_id ORDER BY m, match_id) AS r FROM keyed JOIN p ON (h = t1 AND w = t2) OR (h = t2 AND w = t1) WHERE bs IS NULL OR abs(epoch_us(bs) - epoch_us(start_ts)) <= 21600000000) SELECT fx.fixture_id, match_id, o AS book_home_is_team1, CASE m WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' END AS method FROM fx LEFT JOIN (SELECT * FROM hit WHERE r = 1) USING (fixture_id)",
    "retro_match": f"{_LINK}, hit AS (SELECT fixture_id, match_id, m, bs, row_number() OVER (PARTITION BY match_id ORDER BY coalesce(bs, TIMESTAMP '1995-01-01'), fixture_id, m) AS r FROM keyed JOIN p ON (h = t1 AND w = t2) OR (h = t2 AND w = t1) WHERE CASE WHEN bs IS NOT NULL THEN abs(epoch_us(bs) - epoch_us(start_ts)) <= 21600000000 ELSE epoch_us(TIMESTAMP '1995-01-01') - epoch_us(start_ts) BETWEEN -1209600000000 AND 10800000000 END) SELECT match_id, fixture_id, CASE m WHEN 0 THEN 'raw' ELSE 'alias' END AS method, CASE WHEN bs IS NOT NULL THEN 'book_start' ELSE 'captured_at' END AS rule FROM hit WHERE r = 1",
    "upsert": "WITH r AS (SELECT o_orderkey AS match_id, o_totalprice AS v, o_orderstatus AS status FROM orders), o AS (SELECT * FROM r WHERE match_id % 3 <> 0), n AS (SELECT match_id, CASE WHEN match_id % 10 = 0 THEN v + 2 WHEN match_id % 4 = 0 THEN v + 1 ELSE v END AS v, status FROM r WHERE match_id % 2 = 0) SELECT match_id, coalesce(n.v, o.v) AS v, coalesce(n.status, o.status) AS status, CASE WHEN o.match_id IS NULL THEN 'new' WHEN n.match_id IS NOT NULL AND (n.v <> o.v OR n.status <> o.status) THEN 'changed' ELSE 'same' END AS change FROM o FULL JOIN n USING (match_id)",
    "ledger_insert": f"{with_views('ledger')}, b AS (SELECT match_id, start_ts, match_id AS position FROM ledger WHERE match_id % 2 = 0 UNION ALL SELECT match_id, start_ts, match_id + 1 FROM ledger WHERE match_id % 6 = 0) SELECT match_id, position, CASE WHEN epoch_us(start_ts) - epoch_us(TIMESTAMP '1995-01-01') < 300000000 THEN 'too_late' WHEN match_id % 5 = 0 OR position <> match_id THEN 'frozen' ELSE 'inserted' END AS status FROM b",
    "ingest_dedupe": f"{with_views('captures')} SELECT DISTINCT match_id, market, line, source, capture_kind FROM captures WHERE seq % 2 = 1 EXCEPT SELECT match_id, market, line, source, capture_kind FROM captures WHERE seq % 2 = 0",
    "grade": f"{with_views('ledger')} SELECT match_id, graded OR match_id % 3 = 0 AND team1_won IS NOT NULL AS graded, team1_won, maps_played FROM ledger WHERE graded OR match_id % 3 <> 0 UNION ALL SELECT match_id, TRUE, 1, 3 FROM ledger WHERE NOT graded AND match_id % 3 = 0",
    "names": rf"""WITH c AS (SELECT c_custkey, c_name, trim(regexp_replace({list(EVENTS)!r}[c_custkey % {len(EVENTS)} + 1], '\s+', ' ', 'g')) AS e, lower({list(ROUNDS)!r}[c_custkey % {len(ROUNDS)} + 1]) AS s FROM customer)
SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS norm,
       CASE WHEN lower(e) LIKE '%game changers%' THEN 'game_changers' WHEN lower(e) LIKE '%challengers%' OR lower(e) LIKE '%evolution series%' THEN 'tier2' WHEN regexp_matches(lower(e), '\bvct\b') OR lower(e) LIKE '%champions tour%' OR lower(e) LIKE '%masters%' THEN 'tier1' ELSE 'other' END AS tier,
       s LIKE '%playoff%' OR s LIKE '%final%' OR s LIKE '%bracket%' AS playoff,
       coalesce(nullif(regexp_replace(regexp_replace(e, '(Group Stage|Week [0-9]|Playoffs|Swiss|Grand Final).*$', ''), '^[ :-]+|[ :-]+$', '', 'g'), ''), '(unknown event)') AS tournament FROM c""",
    "published_probability": f"{with_views('ledger')} SELECT match_id, least(greatest({_R4('p_model')}, 0.0001::DOUBLE), 0.9999::DOUBLE) AS p FROM ledger",
    "last_rows": "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5",
    "page_fields": r"""WITH v AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g') AS h FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(h, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
       trim(regexp_replace(regexp_replace(regexp_extract(h, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS heading, CAST(len(regexp_extract_all(h, '(?i)<a\s[^>]*href')) AS INT) AS n_links FROM v""",
}
