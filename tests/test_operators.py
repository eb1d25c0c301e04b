import heapq
import random
import re
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import series
from tidemark.functions.time import estimated_end
from tidemark.operators import asof, backtest, coverage, evaluation, features, flatten, ledger, linking, markets, models, namejoin, predict, ratings, roster, trends, views
from tidemark.operators.intervals import phase_peaks
from tidemark.sources import fixtures, pages, payloads, records, store

T0 = datetime(2024, 1, 1)


def games(spark, n=60):
    rows = records.synthetic_contests(spark, n, teams=6)
    return flatten.long_frame(rows.withColumn("end_ts", estimated_end("start_ts", "best_of")))


def test_sweep_equals_range_join(spark):
    rows = games(spark)
    probes = rows.select("match_id", "team", "start_ts")
    swept = asof.sweep(rows, probes, ["team"], {"n": F.lit(1), "w": F.col("won")})
    joined = asof.range_join(rows, probes, ["team"], [F.count("f_match_id").alias("n"), F.coalesce(F.sum("f_won"), F.lit(0)).alias("w")])
    key = lambda r: (r.match_id, r.team, int(r.n), int(r.w))
    assert sorted(map(key, swept.collect())) == sorted(map(key, joined.collect()))


def test_roster_weights_equal_a_range_join(spark):
    """Changing line-ups, longer and empty ones: subsets give the weights that a join of all pairs gives."""
    rows = games(spark, 90)
    player = lambda i: F.concat(F.lit("p"), F.pmod(i * 2 + F.floor(F.col("match_id") / 13) * F.col("team").cast("int"), F.lit(7)).cast("string"))
    seats = F.when(F.col("match_id") % 10 == 0, F.array().cast("array<int>")).when(F.col("match_id") % 17 == 0, F.lit(None).cast("array<int>")).otherwise(F.sequence(F.lit(0), F.when(F.col("match_id") % 6 == 0, 6).otherwise(4)))
    facts = rows.withColumn("seats", seats).withColumn("lineup", F.array_distinct(F.transform("seats", player))).drop("seats").cache()
    probes = rows.select("match_id", "team", "start_ts")
    states = roster.roster_states(facts).cache()
    assert states.select(F.explode("core")).distinct().count() > 5
    core = asof.latest(states, probes, ["team"], F.struct("end_ts", "start_ts", "match_id", "core"), name="s").select(*probes.columns, F.coalesce("s.core", F.array().cast("array<string>")).alias("core"))
    for factor in (0.5, 0.8, 1.0):
        swept = asof.roster_sweep(facts, probes, states, {"w": F.lit(1.0), "rw": F.col("rounds_won")}, 20.0, factor, {"n": F.lit(1)})
        age = (F.unix_micros(F.col("p.start_ts").cast("timestamp")) - F.unix_micros(F.col("f_start_ts").cast("timestamp"))) / 86400e6
        weight = asof.roster_weight(age, 20.0, F.coalesce("f_lineup", F.array().cast("array<string>")), F.col("p.core"), factor)
        joined = asof.range_join(facts, core, ["team"], [F.count("f_match_id").alias("n"), F.coalesce(F.sum(F.when(F.col("f_match_id").isNotNull(), weight)), F.lit(0.0)).alias("w"), F.coalesce(F.sum(weight * F.col("f_rounds_won")), F.lit(0.0)).alias("rw")])
        got = {(r.match_id, r.team): (r.n, r.w, r.rw) for r in swept.collect()}
        want = {(r.match_id, r.team): (r.n, r.w, r.rw) for r in joined.collect()}
        assert len(got) == probes.count() and got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)
    plain = asof.decayed_sweep(facts, probes, ["team"], {"w": F.lit(1.0)}, 20.0)
    assert {(r.match_id, r.team): pytest.approx(r.w) for r in plain.collect()} == {k: v[1] for k, v in got.items()}


def test_poisoned_future_changes_nothing(spark):
    rows = games(spark)
    cut = T0 + timedelta(days=4)
    probe = rows.where(F.col("start_ts") == F.lit(T0 + timedelta(days=4)).cast("timestamp_ntz")).select("match_id", "team", "start_ts")
    assert probe.count() == 2
    poison = rows.withColumn("rounds_won", F.when(F.col("end_ts") > F.lit(cut).cast("timestamp_ntz"), 999).otherwise(F.col("rounds_won")))
    boundary = rows.withColumn("rounds_won", F.when(F.col("end_ts") <= F.lit(cut).cast("timestamp_ntz"), F.col("rounds_won") + 1).otherwise(F.col("rounds_won")))
    get = lambda r: sorted((x.match_id, x.team, x.s) for x in asof.sweep(r, probe, ["team"], {"s": F.col("rounds_won")}).collect())
    assert get(rows) == get(poison)
    assert get(rows) != get(boundary)


def test_eligible_at_the_very_end(spark):
    facts = spark.createDataFrame([("a", T0, T0 + timedelta(hours=3))], "team string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    probes = spark.createDataFrame([("a", T0 + timedelta(hours=3)), ("a", T0 + timedelta(hours=3) - timedelta(microseconds=1)), ("b", T0)], "team string, start_ts timestamp_ntz")
    got = {(r.team, r.start_ts): r.n for r in asof.sweep(facts, probes, ["team"], {"n": F.lit(1)}).collect()}
    assert list(got.values()).count(1.0) == 1 and got[("a", T0 + timedelta(hours=3))] == 1


def test_ratings_equal_a_plain_replay(spark):
    """Two separate universes, contests of up to three maps, extra maps, ends that are out of order."""
    made = records.synthetic_contests(spark, 80, teams=5).unionByName(records.synthetic_contests(spark, 40, teams=4).withColumns({"match_id": F.col("match_id") + 1000, "team1": F.col("team1") + 100, "team2": F.col("team2") + 100}))
    made = made.where("team1_score <> team2_score").withColumn("end_ts", estimated_end("start_ts", "best_of"))
    won = (F.col("team1_score") > F.col("team2_score")).cast("int")
    games = F.slice(F.array(F.struct("map_name", won.alias("won")), F.struct(F.lit("map1").alias("map_name"), (1 - won).alias("won")), F.struct(F.lit("map2").alias("map_name"), won.alias("won"))), 1, F.pmod("match_id", F.lit(3)).cast("int") + 1)
    rows = made.withColumns({"won": won, "maps": games, "extra_maps": F.array(F.lit("map1"), F.lit("map9"))})
    assert {r.universe for r in ratings.universes(rows).collect()} == {0, 100}
    log = ratings.rating_log(rows, (32, 64))
    got = {r.match_id: r for r in ratings.prematch(log).where("k = 32").collect()}
    r, on, waiting, want = {}, {}, [], {}
    chance = lambda x, y: 1 / (1 + 10 ** ((y - x) / 400))
    for m in sorted(rows.collect(), key=lambda m: (m.start_ts, m.match_id)):
        while waiting and waiting[0][0] <= m.start_ts:
            _, _, _, a, b, games = heapq.heappop(waiting)
            for name, w in games:
                x, y = (on.get((t, name), (r.get(t, 1500), 0)) for t in (a, b))
                d = 32 * (w - chance(x[0], y[0]))
                on[a, name], on[b, name] = (x[0] + d, x[1] + 1), (y[0] - d, y[1] + 1)
                d = 32 * (w - chance(r.get(a, 1500), r.get(b, 1500)))
                r[a], r[b] = r.get(a, 1500) + d, r.get(b, 1500) - d
        names = list(dict.fromkeys([g.map_name for g in m.maps] + m.extra_maps))
        pulled = lambda t, n: (lambda v: v[0] * v[1] / (v[1] + 10) + r.get(t, 1500) * 10 / (v[1] + 10))(on.get((t, n), (r.get(t, 1500), 0)))
        want[m.match_id] = (r.get(m.team1, 1500), r.get(m.team2, 1500), [(n, pulled(m.team1, n), pulled(m.team2, n)) for n in names])
        heapq.heappush(waiting, (m.end_ts, m.start_ts, m.match_id, m.team1, m.team2, [tuple(g) for g in m.maps]))
    assert got.keys() == want.keys()
    for k, (a, b, maps) in want.items():
        assert (got[k].rating, got[k].opp_rating) == pytest.approx((a, b)) and [x.map_name for x in got[k].maps] == [n for n, _, _ in maps]
        assert [(x.rating, x.opp_rating) for x in got[k].maps] == [pytest.approx(x[1:]) for x in maps]
    # split into stretches of a few contests, the log is the same bit for bit
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(ratings.rating_log(rows, (32, 64), stretch=7)) == plain(log)
    placed = ratings.in_stretches(ratings.events(rows), 7)
    sizes = [r["count"] for r in placed.groupBy("stretch").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 60 and placed.groupBy("at").agg(F.countDistinct("stretch").alias("n")).where("n > 1").isEmpty()
    assert ratings.rating_log(rows.limit(0)).count() == 0
    last = ratings.trajectory(log.where("k = 64"), 3).where("step = 1").count()
    assert last == rows.select("team1").union(rows.select("team2")).distinct().count()


def test_ratings_replay_universes_side_by_side(spark):
    """Rounds follow the longest lane: copies of the same contests under other keys add lanes, not rounds."""
    made = records.synthetic_contests(spark, 40, teams=4).where("team1_score <> team2_score").withColumn("end_ts", estimated_end("start_ts", "best_of"))
    games = made.withColumn("won", (F.col("team1_score") > F.col("team2_score")).cast("int")).withColumn("maps", F.array(F.struct("map_name", "won")))
    copy = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("copy")
    rows = games.select("*", copy).withColumns({c: F.col(c) + F.col("copy") * 1000 for c in ("match_id", "team1", "team2")})
    placed = ratings.in_stretches(ratings.in_lanes(ratings.events(rows), 20), 20)
    size = placed.agg(F.max("step").alias("step"), F.countDistinct("lane").alias("lanes"), F.countDistinct("stretch").alias("n")).first()
    assert size.lanes > 3 and size.step + 1 < size.n
    assert placed.groupBy("lane", "at").agg(F.countDistinct("stretch").alias("n")).where("n > 1").isEmpty()
    log = [ratings.rating_log(r, (32,), stretch=20).where("kind = 'change'").select(F.pmod("match_id", F.lit(1000)).alias("m"), F.pmod("team", F.lit(1000)).alias("t"), "rating").distinct() for r in (rows, games)]
    assert sorted(map(tuple, log[0].collect())) == sorted(map(tuple, log[1].collect()))


def test_roster_weights_agree_for_short_and_long_histories(spark, monkeypatch):
    team = lambda i: F.when(i % 3 == 0, 1).otherwise(F.when(i % 5 == 0, 2).otherwise(3))
    at = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id * 7 % 90 AS int))")
    lineup = F.when(F.col("id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(*(F.concat(F.lit("p"), ((F.col("id") * k + k) % 6).cast("string")) for k in (1, 2, 5))))
    facts = spark.range(60).select(F.col("id").alias("match_id"), team(F.col("id")).alias("team"), at.alias("start_ts"), (at + F.expr("INTERVAL 2 HOUR")).alias("end_ts"), lineup.alias("lineup"), (F.col("id") % 13).alias("v"))
    probes = facts.select("match_id", "team", "start_ts").unionByName(spark.createDataFrame([(99, 9, T0)], "match_id long, team int, start_ts timestamp_ntz"))
    seen = []
    for short in (0, 20, 10**6):
        monkeypatch.setattr(asof, "SHORT", short)
        swept = asof.roster_sweep(facts, probes, roster.roster_states(facts), {"w": F.lit(1.0), "v": F.when(F.col("v") > 3, F.col("v"))}, 20.0, 0.8, {"n": F.lit(1)})
        seen.append({(r.match_id, r.team): (r.w, r.v, r.n) for r in swept.collect()})
    assert len(seen[0]) == 61 and max(n for *_, n in seen[0].values()) > 20
    for other in seen[1:]:
        assert other.keys() == seen[0].keys() and all(other[k] == pytest.approx(v) for k, v in seen[0].items())


def test_phase_peaks_meet_no_pairs_and_equal_a_plain_look(spark):
    at = lambda us: T0 + timedelta(microseconds=us)
    samples = [(at(t), float(v) if v else None) for t, v in ((0, 5), (0, 0), (7, 9), (8, 2), (10, 1), (4_000_000_000, 30), (8_000_000_000, 4), (8_000_000_001, 50))] + [(None, 99.0)]
    bounds = [(0, 0), (1, 6), (7, 7), (7, 8), (0, 10), (8, 4_000_000_000), (9, 8_000_000_000), (0, 9_000_000_000), (10, 8), (5, 4_000_000_001)]
    phases = [(i, at(b), at(e)) for i, (b, e) in enumerate(bounds)] + [(3, at(10), at(10)), (77, None, at(9))]
    df = spark.createDataFrame(samples, "ts timestamp_ntz, value double"), spark.createDataFrame(phases, "phase_id int, begin timestamp_ntz, finish timestamp_ntz")
    want = {}
    for i, b, e in phases:
        inside = [v for t, v in samples if t is not None and b is not None and b <= t <= e]
        if inside:
            values, n = want.get(i, ([], 0))
            want[i] = values + [v for v in inside if v is not None], n + len(inside)
    got = phase_peaks(*df)
    assert {r.phase_id: (r.peak, r.n) for r in got.collect()} == {i: (max(v, default=None), n) for i, (v, n) in want.items()}
    # many phases over many samples at once: rows of the result are made by no join of the two
    one = spark.range(40_000).select(F.lit(T0).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("value"))
    crowd = phase_peaks(one, one.select(F.col("value").alias("phase_id"), F.col("ts").alias("begin"), F.col("ts").alias("finish")))
    assert crowd.agg(F.min("n"), F.max("n"), F.min("peak")).first()[:] == (40_000, 40_000, 39_999.0)


def match(match_id="m", **more):
    player = lambda n, **x: {"name": n, "agent": "jett", "kills": 10, "fk": 1, "fd": 2, "multikills": 1, "clutches": 0} | x
    base = {"match_id": match_id, "start_ts": T0, "status": "completed", "best_of": 3, "event": "Cup - Playoffs: Final", "series": "Final", "team1_id": "1", "team1_name": "A", "team2_id": "2", "team2_name": "B", "winner": "team1", "team1_series_score": 2, "team2_series_score": 0, "veto": "",
            "maps": [{"game_id": "g", "map_name": "Haven", "index": 0, "team1_score": 13, "team2_score": 7, "team1_attack": 6, "team1_defence": 7, "team2_attack": 3, "team2_defence": 4, "rounds": [{"number": 1, "winner": "team1", "win_method": "elim"}, {"number": 2, "winner": "team2", "win_method": "boom"}, {"number": 13, "winner": "team2", "win_method": "time"}], "team1_players": [player("Zed"), player("amy")], "team2_players": [player("X", kills=None), player("Y", multikills=None)], "team1_econ": {"fullbuy": {"n": 10, "won": 6}, "lowbuy": None}, "team2_econ": None},
                     {"game_id": "h", "map_name": "Split", "index": 1, "team1_score": 12, "team2_score": 12, "team1_attack": None, "team1_defence": None, "team2_attack": None, "team2_defence": None, "rounds": None, "team1_players": None, "team2_players": None, "team1_econ": None, "team2_econ": None}]}
    return base | more


def test_maps_frame(spark):
    df = spark.createDataFrame([match(), match("u", status="upcoming")], schemas.MATCH)
    rows = {r.is_team1: r for r in flatten.maps_frame(df).collect()}
    assert len(rows) == 2
    a, b = rows[True], rows[False]
    assert (a.atk_rw, a.atk_rl, a.def_rw, a.def_rl) == (6, 4, 7, 3) and (b.atk_rw, b.atk_rl) == (3, 7)
    assert a.lineup == ["amy", "zed"] and (a.pistols_won, a.pistols_played, b.pistols_won) == (1, 2, 1)
    assert (a.multikills, b.multikills, a.fk, a.fullbuy_n, b.fullbuy_n, a.lowbuy_n) == (2, None, 2, 10, None, None)
    facts = flatten.trends_facts(df).where("team = '1'").orderBy("map_index").collect()
    assert len(facts) == 2 and facts[0].methods == [1, 0, 0, 0] and facts[0].kills is None and facts[1].fk is None
    assert flatten.matches_frame(df).first().maps_played == 2 and flatten.tournament_index(df).first().name == "Cup"
    table = trends.trends(flatten.trends_facts(df), min_maps=1).where("team = '1'").first()
    assert table.win_rate == 0.5 and table.pistol_wr == 0.5 and table.comb_kills_avg is None and table.fk_diff12 == pytest.approx(12 * -2 / 20)
    assert table.agents_top[0].n == 2 and table.method_mix == [1.0, 0.0, 0.0, 0.0]
    assert trends.trends(flatten.trends_facts(df), min_maps=1, event="nobody knows").count() == 0


def test_core_roster_takes_five_then_drops_empty(spark):
    lines = [["a", "b"], ["a", "c"], [], [], [], ["a", "d"], ["x", "y"]]
    df = spark.createDataFrame([("t", i, T0 + timedelta(days=i), T0 + timedelta(days=i), x) for i, x in enumerate(lines)], "team string, match_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, lineup array<string>")
    got = roster.core_roster(df).first()
    assert got.core == ["a", "d", "x", "y"] and got.core_absent == pytest.approx(2 / 5) and got.newface == 0.0 and got.stability == pytest.approx((2 + 2) / 2 / 5)


def test_roster_states_equal_the_core_roster_of_each_moment(spark):
    lines = [["a", "b"], ["a", "c"], [], ["d", "a"], [], ["a", "d"], ["x", "y", "z"], ["x", "a"], None]
    df = spark.createDataFrame([("t", i, T0 + timedelta(days=i), T0 + timedelta(days=i), x) for i, x in enumerate(lines)] + [("u", 99, T0, T0, [])], "team string, match_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, lineup array<string>").cache()
    states = {(r.team, r.match_id): r.roster for r in roster.roster_states(df).collect()}
    assert states["u", 99] is None
    for i in range(len(lines)):
        want = roster.core_roster(df.where(F.col("match_id") <= i).where("team = 't'")).first()
        assert tuple(states["t", i]) == pytest.approx((want.stability, want.core_absent, want.newface))


CAPS = "match_id long, seq int, captured_at timestamp_ntz, source string, capture_kind string, market string, line double, price_home double, price_away double, book_home_is_team1 boolean"
LED = "match_id long, p_model double, graded boolean, team1_won int, maps_played int, p_maps_dist map<string,double>, event string, start_ts timestamp_ntz"


def test_picks_through_each_books_own_orientation(spark):
    at = lambda h: T0 + timedelta(hours=h)
    ml = "series_moneyline"
    caps = spark.createDataFrame([
        (1, 1, at(0), "other", "freeze", ml, None, 2.0, 1.8, True), (1, 2, at(1), "cloudbet", "freeze", ml, None, 1.7, 2.2, False), (1, 3, at(2), "pinnacle", "freeze", ml, None, 2.2, 1.7, True),
        (1, 4, at(5), "pinnacle", "close", ml, None, 1.9, 1.95, False), (1, 5, at(0), "pinnacle", "freeze", ml, None, 9.0, 1.1, None), (1, 6, at(0), "pinnacle", "freeze", ml, None, 0.0, 1.1, True),
        (2, 1, at(0), "pinnacle", "close", "maps_total", 2.5, 2.0, 1.9, None), (3, 1, at(0), "pinnacle", "freeze", ml, None, 2.0, 1.9, None)], CAPS)
    led = spark.createDataFrame([(1, 0.6, True, 1, 3, None, "e", T0), (2, 0.5, True, 0, 3, {"2": 0.3, "3": 0.7}, "e", T0), (3, 0.5, False, None, None, None, "e", T0)], LED)
    got = {r.match_id: r for r in markets.picks(caps, led).collect()}
    one = got[1]
    assert (one.side, one.source, one.price_entry, one.n_books, one.won) == (0, "pinnacle", 2.2, 3, True)
    assert one.clv == pytest.approx(2.2 / 1.95 - 1) and one.ev == pytest.approx(0.6 * 2.2 - 1)
    assert got[2].won is True and got[2].clv is None and got[2].ev_excluded == "totals_independence_bias" and 3 not in got
    counts = {r.counter: r.n for r in markets.skipped(caps, led).collect()}
    assert counts == {"n_unpriceable": 1, "n_unorientable": 2, "n_groups_unpriced": 1}
    parts = {r.match_id: r.bucket for r in coverage.partition(led, caps, markets.picks(caps, led)).collect()}
    assert parts == {1: "1_covered", 2: "1_covered", 3: "2b_orientation_missing"}


def test_linking(spark):
    fixtures = spark.createDataFrame([(1, "Team A", "Beta", None), (2, "beta", "TEAM a", T0), (3, "Old A", "Beta", T0), (4, "Team A", "Beta", T0 + timedelta(days=3)), (5, "No", "Body", None)], "fixture_id long, book_home string, book_away string, book_start_ts timestamp_ntz")
    predictions = spark.createDataFrame([(10, "Team A", "Beta", T0, 0), (11, "Beta", "Team A", T0, 1)], "match_id long, team1_name string, team2_name string, start_ts timestamp_ntz, position int")
    aliases = spark.createDataFrame([("Old A", "Team A")], "alias string, canonical string")
    got = {r.fixture_id: (r.match_id, r.book_home_is_team1, r.method) for r in linking.link_fixtures(fixtures, predictions, aliases).collect()}
    assert got == {1: (10, True, "exact"), 2: (10, False, "exact"), 3: (10, True, "alias"), 4: (None, None, None), 5: (None, None, None)}


GENERIC_WORDS = {"esports", "esport", "gaming", "team", "club", "org", "the", "fc", "gg", "e", "sports"}
GUARDED = {"academy", "gc", "female", "fe", "youth", "black", "white", "red", "blue"}


def plain_similarity(a, b):
    """The ladder for one pair, in Python."""
    raw = [[t for t in re.split("[^a-z0-9]+", x.lower()) if t] for x in (a, b)]
    (ra, rb), (ca, cb) = raw, [[t for t in r if t not in GENERIC_WORDS] or r for r in raw]
    first = lambda r: "".join(t[0] for t in r)
    if not ca or not cb or (GUARDED & set(ra)) != (GUARDED & set(rb)):
        return 0.0
    if ca == cb:
        return 1.0
    if set(ca) <= set(cb) or set(cb) <= set(ca):
        return 0.92
    if (len(ca) == 1 and ca[0] in (first(rb), first(cb))) or (len(cb) == 1 and cb[0] in (first(ra), first(ca))):
        return 0.9
    return SequenceMatcher(None, " ".join(ca), " ".join(cb)).ratio()


def plain_links(fixtures, predictions, threshold=0.75, margin=0.05):
    out = {}
    for f, h, a in fixtures:
        scored = sorted((-max(min(plain_similarity(h, x), plain_similarity(a, y)), min(plain_similarity(h, y), plain_similarity(a, x))), m) for m, x, y in predictions)
        if scored and -scored[0][0] >= threshold:
            near = len(scored) > 1 and -scored[1][0] >= threshold and scored[1][0] - scored[0][0] < margin
            out[f] = (scored[0][1], pytest.approx(-scored[0][0]), scored[1][1] if near else None)
    return out


def misspelt(names, n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        x = list(rng.choice(names))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "z", "0", " ", "mo"])
        yield "".join(x)


ODD_NAMES = ["Team Liquid", "Liquid", "ab", "axb", "RRQ", "Rex Regum Qeon", "G2", "G2 Academy", "Academy G2", "Sentinels", "Sentinel", "Cloud9", "abc", "a b c", "Evil Geniuses", "EG", "Team", "the gg", "", "!!", "Straße", "STRASSE", "a", "b", "x" * 300, "x" * 250 + "y" * 50, "abcdefgh", "a1b2c3d4efgh"]


@pytest.mark.parametrize("threshold", [0.7, 0.75, 0.9])
def test_similarity_join_loses_no_pair_and_meets_few(spark, threshold):
    rng = random.Random(7)
    made = lambda: " ".join("".join(rng.choice("ka ri to ne zu mo la shi ber gar ton ex ul".split()) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(1, 2)))
    right = sorted({made() for _ in range(150)} | set(ODD_NAMES))
    left = sorted(set(misspelt(right, 150, 3)) | set(ODD_NAMES))
    rows = spark.createDataFrame([(x, threshold) for x in left] + [(None, threshold), (left[3], 0.99)], "name string, least double"), spark.createDataFrame([(x,) for x in right] + [(None,), (right[3],)], "name string")
    got = {(r.a, r.b): r.s for r in namejoin.similar(*rows).collect()}
    plain = lambda x: x.replace("ß", "ss")
    want = {(a, b): s for a in left for b in right if (s := plain_similarity(plain(a), plain(b))) >= threshold}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    if threshold >= 0.75:
        assert namejoin.candidates(rows[0].where("name IS NOT NULL"), rows[1]).count() < 0.05 * len(left) * len(right)
    assert namejoin.similar(rows[0].limit(0), rows[1]).count() == namejoin.similar(rows[0], rows[1].limit(0)).count() == 0


def test_fuzzy_links_equal_all_pairs(spark):
    fixtures = [(i, x, y) for i, (x, y) in enumerate(zip(ODD_NAMES, reversed(ODD_NAMES)))] + [(100 + i, "Titan", x) for i, x in enumerate(ODD_NAMES[:6])] + [(200, "Cloud9", "G2"), (201, "Titan", "Alpha")]
    predictions = [(i, x, y) for i, (x, y) in enumerate(zip(ODD_NAMES, reversed(ODD_NAMES)))] + [(50 + i, x, "Wuxi Titan Esports Club") for i, x in enumerate(ODD_NAMES[:6])] + [(300, "G2 Esports", "Cloud9"), (299, "G2 Esports", "Cloud9"), (301, "Titan Esports", "Alpha"), (302, "Titan Gaming", "Alpha")]
    schema = "{} long, {} string, {} string"
    f, p = spark.createDataFrame([*fixtures, (400, None, "x")], schema.format("fixture_id", "book_home", "book_away")), spark.createDataFrame([*predictions, (400, None, "x")], schema.format("match_id", "team1_name", "team2_name"))
    got = {r.fixture_id: (r.match_id, r.score, r.ambiguous_with) for r in linking.fuzzy_links(f, p).collect()}
    plain = lambda rows: [(i, x.replace("ß", "ss"), y.replace("ß", "ss")) for i, x, y in rows]
    assert got == plain_links(plain(fixtures), plain(predictions))
    assert linking.fuzzy_links(f.limit(0), p).count() == linking.fuzzy_links(f, p.limit(0)).count() == 0


def test_numbered_names_meet_few_others(spark):
    """300 fixtures against 300 predictions whose names all look alike: few of all pairs of names become candidates."""
    name = lambda k: f"Supplier#{k:09d}"
    fixtures = spark.createDataFrame([(k, f"Team {name(k)}", f"{name(k + 1)} Gaming") for k in range(1, 301)], "fixture_id long, book_home string, book_away string")
    predictions = spark.createDataFrame([(k, name(k), name(k + 1)) for k in range(1, 301)], "match_id long, team1_name string, team2_name string")
    got = linking.fuzzy_links(fixtures, predictions).collect()
    assert len(got) == 300 and all((r.fixture_id, r.score, r.book_home_is_team1, r.ambiguous_with) == (r.match_id, 1.0, True, None) for r in got)
    names = fixtures.select(F.col("book_home").alias("name"), F.lit(0.95).alias("least"))
    assert namejoin.candidates(names, predictions.select(F.col("team1_name").alias("name"))).count() <= 0.05 * 300 * 300


def test_ledger_rules(spark):
    led = spark.createDataFrame([(1, "tbd", "x", False, None, None), (2, "a", "b", True, 1, 2)], "match_id long, team1_name string, team2_name string, graded boolean, team1_won int, maps_played int")
    results = spark.createDataFrame([(1, 0, 3, "Real", "x"), (2, 0, 9, "z", "z")], "match_id long, team1_won int, maps_played int, team1_name string, team2_name string")
    got = {r.match_id: tuple(r)[1:] for r in ledger.grade(led, results).collect()}
    assert got == {1: ("Real", "x", True, 0, 3), 2: ("a", "b", True, 1, 2)}
    rows = spark.createDataFrame([("a", "b", "b", "a"), ("tbd", "b", "q", "b"), ("a", "tba", "a", "q"), ("tbd", "", "x", "y"), ("a", "b", "x", "y")], "team1 string, team2 string, l1 string, l2 string")
    assert [r.case for r in ledger.listed_names(rows).collect()] == ["swapped", "first_placeholder", "second_placeholder", "both_placeholders", "unmatched"]


def test_upsert_and_dedupe(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "match_id long, s string, n int")
    batch = spark.createDataFrame([(2, "x", 5, 1), (2, "b", 5, 2), (3, "c", 1, 3), (1, "z", None, 4)], "match_id long, s string, n int, position int")
    got = {r.match_id: (r.s, r.n, r.change) for r in store.upsert(old, batch).collect()}
    assert got == {1: ("z", None, "changed"), 2: ("b", 5, "same"), 3: ("c", 1, "new")}
    log = spark.createDataFrame([(1, None)], "k int, line double")
    new = spark.createDataFrame([(1, None), (1, 2.5), (1, 2.5)], "k int, line double")
    assert [tuple(r) for r in store.new_only(new, log, ("k", "line")).collect()] == [(1, 2.5)]


def test_files(spark, tmp_path):
    at = str(tmp_path)
    df = spark.createDataFrame([match(), match("n", start_ts=T0 - timedelta(days=1))], schemas.MATCH)
    store.publish(df, f"{at}/m", "json")
    store.publish(df, f"{at}/m", "json")
    back = records.read_matches(spark, f"{at}/m")
    assert records.count_lines(spark, f"{at}/m") == 2 and records.first_matches(back, 1).first().match_id == "n"
    assert records.read_matches(spark, f"{at}/none").count() == 0
    raw = spark.createDataFrame([(T0, "s", "u/matchups", 200, '{"a": 1}'), (T0, "s", "u/matchups", 500, "{}"), (T0, "s", "u/matchups", 200, "not json")], schemas.RAW)
    records.archive(raw, f"{at}/raw")
    assert records.replay(spark, f"{at}/raw", "s", "matchups").count() == 1
    (tmp_path / "aliases.json").write_text('{"Old Name": "New-Name"}')
    assert tuple(records.read_aliases(spark, f"{at}/aliases.json").first()) == ("oldname", "newname")


def test_payloads(spark):
    body = '{"events": [{"id": "7", "home": {"name": "A"}, "away": {"name": "B"}, "cutoffTime": "2024-01-01T00:00:00Z", "markets": {"esport.winner": {"submarkets": {"p": {"selections": [{"outcome": "home", "price": 1.5}, {"outcome": "away", "price": 2.5}]}}}, "esport.total_maps": {"submarkets": {"period=default": {"selections": [{"outcome": "over", "params": "total=2.5", "price": 1.9}, {"outcome": "under", "params": "total=2.5", "price": 1.8}, {"outcome": "over", "params": "total=5.5", "price": 9.0}, {"outcome": "under", "params": "total=5.5", "price": 1.01}]}}}}}]}'
    got = sorted((r.market, r.line, r.price_home, r.price_away) for r in payloads.feed_captures(spark.createDataFrame([(T0, "s", body)], "captured_at timestamp, source string, body string")).collect())
    assert got == [("maps_total", 2.5, 1.9, 1.8), ("series_moneyline", None, 1.5, 2.5)]
    bodies = [(0, T0, '[{"id": 5, "startTime": "2024-01-01T00:00:00Z", "participants": [{"name": "A", "alignment": "home"}, {"name": "B", "alignment": "away"}]}]'), (1, T0, '[{"matchupId": 5, "type": "moneyline", "period": 0, "prices": [{"designation": "home", "price": -200}, {"designation": "away", "price": 170}]}]')]
    r = payloads.intercepted(spark.createDataFrame(bodies, "position int, captured_at timestamp, body string")).first()
    assert (r.book_event_id, r.book_home, r.price_home, r.price_away) == ("5", "A", 1.5, 2.7)


def test_pages(spark):
    html = '<html><title>T &amp; x</title><script><a href="/9/no">n</a></script><h1>Main <b>it</b></h1><a href="/12/one">A <i>b</i></a><a href="/12/one">again</a><table><tr><td>X</td><td>14 (9)</td><td>3 (1)</td></tr></table></html>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = {r.page_id: r for r in pages.page_fields(df).collect()}
    assert (got[1].heading, got[1].n_links, got[2].title) == ("Main it", 2, "")
    assert [(r.id, r.text) for r in pages.cards(df).collect()] == [("12", "A b")]
    e = df.select(pages.economy(pages.table_cells(F.col("html"))).alias("e"), pages.own_text(F.lit('<div class="map">Haven <span>PICK</span></div>')).alias("o"), pages.best_of(F.lit("Bo5"), F.lit(1), F.lit(0)).alias("b"), pages.best_of(F.lit(None).cast("string"), F.lit(2), F.lit(1)).alias("c")).first()
    assert (e.e[0].lowbuy.n, e.e[0].fullbuy.won, e.o, e.b, e.c) == (14, 1, "Haven", 5, 3)


def test_models(spark):
    rows = spark.range(400).select(F.col("id").alias("match_id"), (F.rand(1) * 2 - 1).alias("d"), F.rand(2).alias("u")).withColumn("y", (F.col("u") < 1 / (1 + F.exp(-3 * F.col("d")))).cast("int")).drop("u").cache()
    train, val = rows.where("match_id < 250"), rows.where("match_id >= 250")
    model, loss = models.fit_logistic(evaluation.augment_swapped(train, ["d"], "y"), val, ["d"], grid=(0.1, 1.0))
    assert loss < 0.69
    scored = models.probability(model, val).cache()
    kind, fitted = models.calibrate(scored)
    assert kind == "platt"
    steps = models.fit_isotonic(scored)
    knots = models.fit_smooth(scored, steps)
    for fit, smooth in ((steps, False), (knots, True)):
        out = [r[0] for r in scored.orderBy("p").select(models.interpolated(F.col("p"), fit, smooth)).collect()]
        assert all(b >= a - 1e-9 for a, b in zip(out, out[1:])) and min(out) >= 0.005 and max(out) <= 0.995
    assert models.version({"a": 1, "b": 2}) == models.version({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        models.check_features(rows, ["d", "gone"])
    assert "map_x" in models.check_features(rows, ["d", "map_x"]).columns


def test_smooth_knots_are_mean_inputs_of_plateaus(spark):
    rows = spark.createDataFrame([(0.10, 0), (0.12, 0), (0.20, 1), (0.30, 0), (0.35, 1), (0.80, 1), (0.99, 1)], "p double, y int")
    xs, ys = models.fit_smooth(rows, models.fit_isotonic(rows))
    assert ys == pytest.approx([0, 0.5, 1]) and xs == pytest.approx([0.11, 0.25, (0.35 + 0.8 + 0.99) / 3])


def test_choice_of_family_is_paired_by_row(spark):
    def scores(shift, noise):
        base = [0.5 + 0.3 * (i % 7) for i in range(200)]
        return spark.createDataFrame([(i, f, x + (shift + noise * (-1) ** i if f == "b" else 0)) for i, x in enumerate(base) for f in ("a", "b")], "match_id int, family string, loss double")

    # the losses vary far more between rows than between families: only the paired error sees the difference
    assert models.choose_family(scores(-0.01, 0.02), "a") == "b" and models.choose_family(scores(-0.001, 0.05), "a") == "a"
    assert models.choose_family(scores(-0.001, 0.05), None) == "b" and models.choose_family(scores(0.01, 0.0), "gone") == "a"


def test_rolling_scores_pool_rows_of_all_folds(spark):
    rows = spark.range(120).select(F.col("id").alias("match_id"), (F.col("id") / 40).cast("int").alias("fold"), (F.rand(4) - 0.5).alias("d")).withColumn("y", (F.col("d") > 0).cast("int")).cache()
    out = models.rolling_scores(rows, ["d"], ["d"], grid=(0.1, 1.0)).collect()
    assert {r.family for r in out} == {"logistic"} and sorted(r.match_id for r in out) == list(range(40, 120)) and all(r.loss >= 0 for r in out)


def _plain_facts(spark, n):
    made = records.synthetic_contests(spark, n, teams=6).withColumn("end_ts", estimated_end("start_ts", "best_of"))
    rows = flatten.long_frame(made)
    none = F.lit(None).cast("int")
    return made, rows.withColumns({"atk_rw": F.col("rounds_won"), "atk_rl": F.col("rounds_lost"), "def_rw": F.col("rounds_won"), "def_rl": F.col("rounds_lost"), "fk": none, "fd": none, "pistols_won": F.col("won"), "pistols_played": F.lit(2), "fullbuy_n": none, "fullbuy_w": none, "lowbuy_n": none, "lowbuy_w": none, "clutch_wins": none, "multikills": none, "lineup": F.array(F.concat(F.lit("p"), F.pmod("match_id", F.lit(3)).cast("string")), F.col("team").cast("string"))}).cache()


def test_train_save_and_predict(spark, tmp_path):
    made, facts = _plain_facts(spark, 160)
    contests = made.where("team1_score <> team2_score").withColumn("y", (F.col("team1_score") > F.col("team2_score")).cast("int")).select("match_id", "start_ts", "end_ts", "team1", "team2", "map_name", "best_of", "y")
    elo = ratings.prematch(ratings.rating_log(ratings.single_map(contests.withColumn("won", F.col("y")))))
    maps = [f"map{i}" for i in range(5)]
    table = features.feature_rows(facts, contests, elo, maps).cache()
    assert table.count() == contests.count() and table.where("low_history").count() > 0
    first = table.orderBy("start_ts").first()
    assert (first.a_n_maps, first.b_n_maps, first.low_history, first.elo_diff, first.round_share_diff) == (0, 0, True, 0.0, 0.0)
    names, differences = features.names_of(table)
    assert "elo_diff" in differences and "newface_diff" in differences and "map_map3" in names
    usable = evaluation.chronological_split(table.na.fill(0.0, differences))
    trained = models.train(usable, names, differences, grid=(0.1, 1.0))
    assert (trained.family, trained.calibration[0]) == ("logistic", "platt")
    models.save(trained, str(tmp_path))
    again = models.load(spark, str(tmp_path))
    assert again.features == names and again.calibration[1] == pytest.approx(trained.calibration[1])
    late = F.lit("2024-03-01").cast("timestamp_ntz")
    upcoming = spark.createDataFrame([(9001, 1, 2, "One", "Two", 3), (9002, 3, 4, "TBD", "Four", 3), (9003, 5, 5, "Five", "Five", 5), (9004, 0, 77, "Zero", "New", 5)], "match_id long, team1 long, team2 long, team1_name string, team2_name string, best_of int").withColumn("start_ts", late)
    out = {r.match_id: r for r in predict.predict(again, facts, upcoming, maps[:3], ratings=elo, maps=maps).collect()}
    assert set(out) == {9001, 9004} and set(out[9001].p_by_map) == set(maps[:3])
    assert out[9004].low_history and out[9004].b_n_maps == 0 and not out[9001].low_history
    p = sum(out[9001].p_by_map.values()) / 3
    assert out[9001].p_map == pytest.approx(p, abs=2e-4) and out[9001].p_series == pytest.approx(p * p * (3 - 2 * p), abs=5e-4)
    assert sum(out[9004].p_maps_dist.values()) == pytest.approx(1) and set(out[9004].p_maps_dist) == {"3", "4", "5"}


def test_fallbacks_views_and_unknown_games(spark):
    new, held, before = (spark.createDataFrame(rows, "match_id int, p double") for rows in ([(1, 0.1), (2, 0.2), (3, 0.3)], [(1, 0.9)], [(1, 0.8), (2, 0.7)]))
    assert {r.match_id: r.p for r in predict.with_fallbacks(new, held, before, ["p"]).collect()} == {1: 0.9, 2: 0.7, 3: 0.3}
    rows = spark.createDataFrame([(1, "m", 2.5, None), (1, "m", None, T0), (1, "m", 1.5, T0 + timedelta(days=1))], "match_id int, market string, line double, start_ts timestamp_ntz")
    assert [r.line for r in views.by_line(rows).collect()] == [None, 1.5, 2.5]
    assert [r.line for r in views.by_start(rows).collect()] == [None, 1.5, 2.5] and [r.line for r in views.by_start(rows, True).collect()] == [1.5, None, 2.5]
    assert [(r.section, r.line) for r in views.schedule(rows, rows).collect()] == [(0, None), (0, 1.5), (0, 2.5), (1, 1.5), (1, None), (1, 2.5)]
    pools = [spark.createDataFrame([(x,) for x in names], "map_name string") for names in ("ab", "bc")]
    assert {tuple(r) for r in views.pool_changes(*pools).collect()} == {("c", "joined"), ("a", "dropped")}
    assert spark.sql("SELECT array(0.6D, NULL, 0.2D) AS p, array(CAST(NULL AS DOUBLE)) AS q").select(series.filled(F.col("p")), series.filled(F.col("q"))).first()[:] == ([0.6, 0.4, 0.2], [0.5])


def test_walk_forward_sees_only_the_past(spark):
    rows = spark.range(120).select(F.col("id").alias("match_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") * 6).cast("int"))).alias("start_ts"), (F.rand(3) - 0.5).alias("d")).withColumn("end_ts", F.col("start_ts") + F.expr("INTERVAL 3 HOUR")).withColumn("y", (F.col("d") > 0).cast("int")).cache()
    out, ticks = backtest.walk_forward(rows, ["d"], ["d"], warmup=40, grid=(0.1,))
    assert ticks.first().n_done >= 40 and out.count() == out.where("epoch >= 1 AND p_model BETWEEN 0 AND 1").count() > 0
    flipped = rows.withColumn("y", F.when(F.col("match_id") > 60, 1 - F.col("y")).otherwise(F.col("y")))
    again, _ = backtest.walk_forward(flipped, ["d"], ["d"], warmup=40, grid=(0.1,))
    first = lambda d: sorted((r.match_id, round(r.p_model, 9)) for r in d.where("epoch = 1").collect())
    assert first(out) == first(again)
    assert backtest.leakage_check(rows, rows, ["d"]).count() == 0 and backtest.leakage_check(rows, flipped.withColumn("d", F.col("d") + 1), ["d"]).count() == 120


def test_decay_far_from_any_fixed_moment(spark):
    """Short half-lives, dates of 1975 and 2070, and both in one table."""
    days = [datetime(1975, 1, 1) + timedelta(days=i) for i in range(6)] + [datetime(2070, 1, 1) + timedelta(days=3 * i) for i in range(6)]
    rows = spark.createDataFrame([("a", i, d, d + timedelta(hours=3)) for i, d in enumerate(days)], "team string, match_id int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    for part in (rows.where("match_id < 6"), rows.where("match_id >= 6"), rows):
        for half_life in (1.0, 14.0):
            known = part.collect()
            for r in asof.decayed_sweep(part, part.select("match_id", "team", "start_ts"), ["team"], {"w": F.lit(1.0)}, half_life, {"n": F.lit(1)}).collect():
                before = [f for f in known if f.end_ts <= r.start_ts]
                assert r.w == pytest.approx(sum(0.5 ** ((r.start_ts - f.start_ts).total_seconds() / 86400 / half_life) for f in before)) and r.n == len(before)


def test_latest_takes_what_has_an_order(spark):
    rows = games(spark)
    probes = rows.select("match_id", "team", "start_ts")
    got = {(r.match_id, r.team): r["last"] for r in asof.latest(rows, probes, ["team"], F.struct("end_ts", "match_id", F.array("opp").alias("o"))).collect()}
    known = rows.collect()
    for p in known:
        before = [(f.end_ts, f.match_id, [f.opp]) for f in known if f.team == p.team and f.end_ts <= p.start_ts]
        assert (tuple(got[p.match_id, p.team]) if before else got[p.match_id, p.team]) == (max(before) if before else None)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sweeps_join_nothing_and_leave_out_what_has_no_key(spark):
    at = lambda h: T0 + timedelta(hours=h)
    facts = spark.createDataFrame([("a", at(1), 1), ("a", at(30), 2), ("b", at(2), 4), (None, at(1), 8), ("a", None, 16)], "k string, end_ts timestamp, v int")
    probes = spark.createDataFrame([(1, "a", at(1)), (2, "a", at(29)), (3, "a", at(40)), (4, "c", at(9)), (5, None, at(9)), (6, "b", at(80))], "id int, k string, start_ts timestamp")
    swept = asof.sweep(facts, probes, ["k"], {"n": F.col("v")})
    assert {r.id: r.n for r in swept.collect()} == {1: 1, 2: 1, 3: 3, 4: 0, 6: 4}
    last = asof.latest(facts, probes, ["k"], F.col("v"))
    assert {r.id: r["last"] for r in last.collect()} == {1: 1, 2: 1, 3: 2, 4: None, 6: 4}
    assert "Join" not in plan_of(swept) and "Join" not in plan_of(last)


def test_membership_of_few_probes_equals_that_of_all(spark):
    rnd = random.Random(13)
    line = [(i, rnd.choice("xyz"), T0 + timedelta(hours=rnd.randrange(200)), rnd.sample(["a", "b", "c", "d", None], rnd.randrange(4))) for i in range(90)]
    facts = spark.createDataFrame([(m, t, s, s + timedelta(hours=1), p) for m, t, s, p in line], "match_id int, team string, start_ts timestamp, end_ts timestamp, lineup array<string>")
    probes = spark.createDataFrame([(m, t, s) for m, t, s, _ in line], "probe_id int, team string, at timestamp")
    whole = {r.probe_id: r for r in roster.membership(facts, probes).collect()}
    few = roster.membership(facts, probes.where("probe_id % 9 = 0")).collect()
    assert len(few) == 10 and all(r == whole[r.probe_id] for r in few)
    assert any(r.roster_coplay_log for r in few) and any(r.roster_ext_maps_log for r in few)


def test_picks_deal_captures_by_their_number(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("match_id"), F.col("id").cast("int").alias("seq"))
    assert markets.by_match(rows, 10).rdd.getNumPartitions() == 100 and markets.by_match(rows, 10).count() == 1000
    of = lambda n: [len(p) for p in markets.by_match(rows, n).rdd.glom().collect()]
    assert max(of(10)) <= 100 and sum(of(10)) == 1000
    caps = spark.createDataFrame([(1, i, T0, s, "freeze", "series_moneyline", None, p, 2.0, True) for i, (s, p) in enumerate([("zed", 1.9), ("abc", 1.9), ("mid", 1.8)])], "match_id int, seq int, captured_at timestamp, source string, capture_kind string, market string, line double, price_home double, price_away double, book_home_is_team1 boolean")
    led = spark.createDataFrame([(1, 0.6, False, None, None, None, "E", T0)], "match_id int, p_model double, graded boolean, team1_won int, maps_played int, p_maps_dist map<string,double>, event string, start_ts timestamp")
    picked = markets.picks(caps, led)
    assert "Window" not in plan_of(picked)
    r = picked.first()
    assert (r.source, r.n_books, r.side) == ("abc", 3, 0)


def test_of_prices_equal_in_all_order_the_first_in_the_log_is_taken(spark, tmp_path):
    rows = [(m, 1, T0, "abc", kind, "series_moneyline", None, 2.0, 1.8, first, place) for m, kind, first, place in ((1, "freeze", True, 0), (1, "freeze", False, 1), (2, "freeze", True, 1), (2, "freeze", False, 0), (3, "close", True, 0), (3, "close", False, 1), (4, "close", True, 1), (4, "close", False, 0))]
    caps = spark.createDataFrame(rows, CAPS + ", place long").coalesce(1)
    got = {r.match_id: r for r in markets.entry_close(caps).collect()}
    assert {m: got[m].entry.book_home_is_team1 for m in got} == {1: True, 2: False, 3: True, 4: False}
    assert (got[3].close.book_home_is_team1, got[4].close.book_home_is_team1) == (True, False)
    one, many = spark.range(20).coalesce(1), spark.range(20).repartition(3)
    for rows in (one, many):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/t")
        read = spark.read.parquet(f"{tmp_path}/t")
        told = read.select("id", fixtures.place(read).alias("place"), F.col("_metadata.file_name").alias("file")).collect()
        assert len({r.place for r in told}) == 20
        assert [r.file for r in sorted(told, key=lambda r: r.place)] == sorted(r.file for r in told)


def test_fixtures_are_sought_by_the_name_that_meets_fewer(spark, monkeypatch):
    """Visitors of 16 letters that are no more than 0.75 alike meet each other by the hundred, the numbers at home hardly."""
    rnd = random.Random(11)
    far = ["".join(rnd.choice("0123456789abcdef") for _ in range(16)) for _ in range(60)]
    fixtures = [(k, *((f"{far[k]} Gaming", f"{k:09d} FC") if k % 4 == 0 else (f"{k:09d} FC", f"{far[k]} Gaming"))) for k in range(60)]
    predictions = [(k, f"Supplier#{k:09d}", f"{far[k]} Esports") for k in range(60)]
    asked, rule = [], namejoin.by_rule
    monkeypatch.setattr(namejoin, "by_rule", lambda left, right: asked.extend(r.name for r in left.select("name").collect()) or rule(left, right))
    f, p = spark.createDataFrame(fixtures, "fixture_id long, book_home string, book_away string"), spark.createDataFrame(predictions, "match_id long, team1_name string, team2_name string")
    got = {r.fixture_id: (r.match_id, r.score, r.book_home_is_team1) for r in linking.fuzzy_links(f, p).collect()}
    assert got == {k: (k, 0.92, k % 4 != 0) for k in range(60)}
    assert sorted(asked) == sorted(f"{k:09d} FC" for k in range(60))


def test_feature_rows_meet_short_histories_and_sweep_what_is_latest_once(spark, monkeypatch):
    made, facts = _plain_facts(spark, 700)
    sizes = facts.groupBy("team").count().agg(F.min("count")).first()[0]
    assert sizes > 200
    swept, latest_of = [], asof.latest_of
    monkeypatch.setattr(asof, "latest_of", lambda *a, **k: swept.append(1) or latest_of(*a, **k))
    monkeypatch.setattr(asof, "_by_subset", None)
    contests = made.where("match_id % 50 = 0").select("match_id", "start_ts", "team1", "team2", "map_name", "best_of")
    assert features.feature_rows(facts, contests).count() == contests.count() and len(swept) == 1


def test_looks_of_two_k_come_from_one_replay(spark, monkeypatch):
    made = ratings.single_map(records.synthetic_contests(spark, 60, teams=6).withColumn("end_ts", estimated_end("start_ts", "best_of")).where("team1_score <> team2_score").withColumn("won", (F.col("team1_score") > F.col("team2_score")).cast("int"))).cache()
    coming = made.where("match_id % 10 = 0").withColumns({f"team{i}_name": F.concat(F.lit("T"), F.col(f"team{i}").cast("string")) for i in (1, 2)})
    played = made.where("match_id % 10 <> 0")
    facts = _plain_facts(spark, 60)[1]
    score = lambda rows: rows.withColumn("p", F.lit(0.5))
    one = {k: {r.match_id: r.rating for r in predict.looks_ahead(played, coming, ("map0",), k).collect()} for k in (32, 64)}
    both = predict.looks_ahead(played, coming, ("map0",), 32, 64).collect()
    assert len(both) == 2 * len(one[32]) and all(r.rating == one[int(r.k)][r.match_id] for r in both)
    replays, log = [], ratings.rating_log
    monkeypatch.setattr(ratings, "rating_log", lambda *a: replays.append(1) or log(*a))
    assert predict.predict(score, facts, coming, ("map0",), games=played, baseline_k=64).count() == coming.count() and len(replays) == 1


def _many_games(spark, teams: int):
    made = records.synthetic_contests(spark, 400, teams=teams).where("team1_score <> team2_score").withColumn("end_ts", estimated_end("start_ts", "best_of"))
    won = (F.col("team1_score") > F.col("team2_score")).cast("int")
    return made.withColumns({"won": won, "maps": F.array(F.struct("map_name", won.alias("won")), F.struct(F.lit("map1").alias("map_name"), (1 - won).alias("won")))})


def test_all_k_are_replayed_at_once_in_waves_as_game_by_game(spark, monkeypatch):
    rows = _many_games(spark, 90)
    held = ratings._standings(np.array([16.0, 32.0])).empty_table()
    games = ratings._games_of(ratings._in_order(ratings.events(rows).toArrow()))
    waits = games["waits"].to_numpy()
    assert waits.max() + 1 < len(waits) / 4
    left, plain = [], []
    monkeypatch.setattr(ratings, "_one_by_one", lambda *a, by=ratings._one_by_one: plain.append(1) or by(*a))
    for wide in (0, 10**9):
        monkeypatch.setattr(ratings, "WIDE", wide)
        book = ratings._Book(np.array([16.0, 32.0]), held, games, True)
        book.settle()
        left.append(book.left())
    assert left[0].equals(left[1]) and len(plain) == 1
    # all K of a contest are one row
    looks = ratings.rated(rows, ratings.K_GRID, tells=("snapshot",), on_maps=False)
    assert looks.count() == rows.count() and {r.n for r in looks.select(F.size("rated").alias("n")).distinct().collect()} == {len(ratings.K_GRID)}


def test_long_chains_are_split_into_lanes_and_tell_what_is_asked(spark, monkeypatch):
    copy = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("copy")
    rows = _many_games(spark, 12).select("*", copy).withColumns({c: F.col(c) + F.col("copy") * 1000 for c in ("match_id", "team1", "team2")})
    plain = lambda df: sorted(map(repr, df.collect()))
    whole = ratings.rating_log(rows, (32,))
    log = {kind: plain(whole.where(F.col("kind") == kind)) for kind in ratings.TELLS}
    monkeypatch.setattr(ratings, "LONG", 1)
    lanes, deal = [], ratings.in_lanes
    monkeypatch.setattr(ratings, "in_lanes", lambda *a: lanes.append(1) or deal(*a))
    assert all(plain(ratings.rating_log(rows, (32,), 150, (kind,))) == log[kind] for kind in ratings.TELLS) and len(lanes) == 2
    assert plain(ratings.rating_log(rows, (32,), 150, ("change",), False)) == log["change"]
