"""Queries on contests: long frames, form tables, as-of aggregates, ratings, rosters, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.functions.stats import expected_score, rounded, shrunk_rate
from tidemark.functions.time import days_between, half_year, zone_to_utc
from tidemark.operators import asof, evaluation, features, flatten, pool, predict, ratings, roster, trends, views
from tidemark.operators.intervals import phase_peaks
from tidemark.sources.fixtures import contests, ended, table, with_views

HALF_LIFE = 14.0
VETO_MAPS = ("Bind", "Split", "Haven", "Lotus")
#: Kinds of rows that a replay of ratings is asked for.
LOOKS, CHANGES = (ratings.SNAPSHOT,), (ratings.CHANGE,)


def long_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = flatten.long_frame(ended(spark, sf))
    return rows.withColumn("metric", F.when(F.col("match_id") % 7 != 0, F.col("rounds_won")))


def mirrored(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of all contests, drawn ones included, with the form table's columns."""
    c = contests(spark, sf)
    side = lambda me, you: F.struct(F.col(f"team{me}").alias("team"), F.col(f"team{me}_score").alias("own"), F.col(f"team{you}_score").alias("other"))
    rows = c.select("match_id", "start_ts", F.col("series").alias("event"), F.explode(F.array(side(1, 2), side(2, 1))).alias("s")).select("match_id", "start_ts", "event", "s.*")
    return rows.select("match_id", "start_ts", "event", "team", (F.col("own") > F.col("other")).cast("int").alias("won"), (F.col("own") - F.col("other")).alias("spread"), (F.col("own") + F.col("other")).alias("rounds"), F.when(F.col("match_id") % 7 != 0, F.col("own")).alias("metric"))


def moment(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz")


NOW = "2024-01-31"


def _shown(t: DataFrame) -> DataFrame:
    return t.select("team", "n_lifetime", "n_window", "last_ts", rounded(F.col("win_rate")).alias("win_rate"), rounded(F.col("spread_avg")).alias("spread_avg"), rounded(F.col("metric_share")).alias("metric_share"))


_FACTS = """facts AS (SELECT match_id, start_ts, series AS event, team, CAST(own > other AS INT) AS won, own - other AS spread, own + other AS rounds,
  CASE WHEN match_id % 7 <> 0 THEN own END AS metric FROM sides)"""


def _trends_sql(scope: str = "TRUE", window: int | None = None, least: int = 5, active: str = "TRUE") -> str:
    r4 = lambda x: f"floor(({x}) * 1e4 + 0.5) / 1e4"
    keep = f"WHERE r <= {window}" if window else ""
    return f"""{with_views("sides")}, {_FACTS},
life AS (SELECT team, count(*) AS n_lifetime, max(start_ts) AS last_any, count(*) FILTER ({scope}) AS n_scope FROM facts GROUP BY team),
used AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY start_ts DESC, match_id DESC) AS r FROM facts WHERE {scope}) {keep})
SELECT team, any_value(n_lifetime) AS n_lifetime, count(*) AS n_window, max(start_ts) AS last_ts, {r4("sum(won) / count(*)")} AS win_rate, {r4("sum(spread) / count(*)")} AS spread_avg,
       {r4("sum(metric)::DOUBLE / nullif(sum(rounds) FILTER (metric IS NOT NULL), 0)")} AS metric_share
FROM used JOIN life USING (team) WHERE n_scope >= {least} AND {active} GROUP BY team"""


def trends_all(spark, sf):
    return _shown(trends.trends(mirrored(spark, sf), min_maps=1))


def trends_current(spark, sf):
    return trends.ranked(_shown(trends.trends(mirrored(spark, sf), now=moment(NOW), **trends.CURRENT_FORM)))


def trends_scoped(spark, sf):
    return _shown(trends.trends(mirrored(spark, sf), min_maps=5, event="click", date_from=moment("2024-01-05"), date_to=moment("2024-01-20")))


def long_frame(spark, sf):
    return long_rows(spark, sf).select("match_id", "start_ts", "end_ts", "team", "opp", "is_team1", "won", "rounds_won", "rounds_lost", "metric")


def match_lite(spark, sf):
    rows = long_rows(spark, sf).withColumn("map_index", F.lit(0))
    lite = flatten.match_lite(rows)
    return lite.select("match_id", "start_ts", "a", "b", F.size("maps").cast("long").alias("n_maps"), F.get("maps", F.lit(0))["map_name"].alias("first_map"), F.get("maps", F.lit(0))["won"].alias("first_won"))


def match_table(spark, sf):
    rows = long_rows(spark, sf).withColumn("best_of", F.lit(1))
    return flatten.match_table(rows).select("match_id", "n_maps", "n_won", "team1_won")


def pool_table(spark, sf):
    out = pool.pool_table(long_rows(spark, sf), moment(NOW))
    return out.select("map_name", "plays", rounded(F.col("weighted")).alias("weighted"), "last_played")


def pool_top(spark, sf):
    return pool.current_pool(long_rows(spark, sf), moment(NOW), size=3).select("map_name", "plays")


def pool_fallback(spark, sf):
    late = moment("2025-01-31")
    return pool.pool_table(long_rows(spark, sf), late, half_life=None).select("map_name", "plays", rounded(F.col("weighted")).alias("weighted"))


def _pool_sql(now: str, days: int, weight: str, tail: str, shown: str) -> str:
    return f"""{with_views("long")}, done AS (SELECT *, {weight} AS w FROM long WHERE is_team1 AND end_ts <= {now}),
recent AS (SELECT * FROM done WHERE start_ts >= {now} - INTERVAL {days} DAY),
used AS (SELECT * FROM recent UNION ALL SELECT * FROM done WHERE NOT EXISTS (SELECT 1 FROM recent))
SELECT map_name, count(*) AS plays{shown} FROM used GROUP BY map_name {tail}"""


_AGE = "(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(start_ts)) / 86400000000.0::DOUBLE"


def asof_counts(spark, sf):
    rows = long_rows(spark, sf)
    return asof.sweep(rows, rows.select("match_id", "team", "start_ts"), ["team"], {"n": F.lit(1), "wins": F.col("won")}).select("match_id", "team", F.col("n").cast("long").alias("n"), F.col("wins").cast("long").alias("wins"))


def asof_decayed(spark, sf):
    rows = long_rows(spark, sf)
    sums = asof.decayed_sweep(rows, rows.select("match_id", "team", "start_ts"), ["team"], {"w": F.lit(1.0), "ww": F.col("won")}, HALF_LIFE)
    return sums.select("match_id", "team", rounded(F.col("w"), 3).alias("weight"), rounded(F.col("ww"), 3).alias("won"))


def asof_shrunk(spark, sf):
    rows = long_rows(spark, sf)
    sums = asof.sweep(rows, rows.select("match_id", "team", "start_ts"), ["team"], {"rw": F.col("rounds_won"), "rn": F.col("rounds_won") + F.col("rounds_lost")})
    return sums.select("match_id", "team", rounded(shrunk_rate(F.col("rw"), F.col("rn"), F.lit(0.5), 60.0)).alias("round_share"))


def asof_priors(spark, sf):
    rows = long_rows(spark, sf)
    has = F.col("metric").isNotNull()
    return asof.priors(rows, rows, {"m": F.when(has, F.col("metric")).otherwise(0), "n": F.when(has, F.col("rounds_won") + F.col("rounds_lost")).otherwise(0)}).select("start_ts", rounded(F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(0.5)).alias("prior"))


def asof_by_map(spark, sf):
    rows = long_rows(spark, sf)
    return asof.sweep(rows, rows.select("match_id", "team", "map_name", "start_ts"), ["team", "map_name"], {"n": F.lit(1)}).select("match_id", "team", F.col("n").cast("long").alias("n"))


def rest_days(spark, sf):
    rows = long_rows(spark, sf)
    last = asof.latest(rows, rows.select("match_id", "team", "start_ts"), ["team"], F.col("start_ts"))
    return last.select("match_id", "team", rounded(asof.rest_days(F.col("last"), "start_ts")).alias("rest_days"))


def range_join_counts(spark, sf):
    """The range-join form, for aggregates that depend on the probe (here on its side of the board)."""
    rows = long_rows(spark, sf)
    sums = asof.range_join(rows, rows.select("match_id", "team", "opp", "start_ts"), ["team"], [F.count("f_match_id").alias("n"), F.count(F.when(F.col("f_opp") == F.col("p.opp"), 1)).alias("n_same_opp")])
    return sums.select("match_id", "team", "n", "n_same_opp")


def lined_rows(spark, sf) -> DataFrame:
    """The long frame with line-ups that change with time, some of them unknown, and all statistics."""
    player = lambda i: F.concat(F.lit("p"), ((F.col("team") * 3 + i * 2 + F.floor(F.col("match_id") / 64)) % 400).cast("string"))
    lineup = F.when(F.col("match_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array(*(player(i) for i in range(3)))))
    shown = lambda k, c: F.when(F.col("match_id") % k != 0, c)
    own, other = F.col("rounds_won"), F.col("rounds_lost")
    return long_rows(spark, sf).withColumns({
        "lineup": lineup, "atk_rw": F.col("metric"), "atk_rl": F.when(F.col("metric").isNotNull(), other), "def_rw": own, "def_rl": other, "fk": F.col("metric"), "fd": other, "pistols_won": F.col("won"), "pistols_played": F.lit(2),
        "fullbuy_n": shown(5, own + 1), "fullbuy_w": shown(5, F.col("won")), "lowbuy_n": shown(3, other + 1), "lowbuy_w": shown(3, 1 - F.col("won")), "clutch_wins": F.col("metric"), "multikills": shown(7, own % 4),
    })


def roster_weighted(spark, sf):
    """Decayed sums in which facts weigh less the more of the probe's core they were played without."""
    rows = lined_rows(spark, sf)
    sums = asof.roster_sweep(rows, rows.select("match_id", "team", "start_ts"), roster.roster_states(rows), {"w": F.lit(1.0), "rw": F.col("rounds_won")}, HALF_LIFE, 0.8, {"n": F.lit(1)})
    return sums.select("match_id", "team", F.col("n").cast("long").alias("n"), rounded(F.col("w"), 3).alias("weight"), rounded(F.col("rw"), 3).alias("rounds"))


def stand_ins(spark, sf):
    return roster.stand_ins(lined_rows(spark, sf))


def snapshot(spark, sf):
    rows = long_rows(spark, sf)
    none = F.lit(None).cast("int")
    facts = rows.withColumns({"atk_rw": F.col("metric"), "atk_rl": F.when(F.col("metric").isNotNull(), F.col("rounds_lost")), "def_rw": F.col("rounds_won"), "def_rl": F.col("rounds_lost"), "fk": F.col("metric"), "fd": F.col("rounds_lost"), "pistols_won": F.col("won"), "pistols_played": F.lit(2), "fullbuy_n": none, "fullbuy_w": none, "lowbuy_n": none, "lowbuy_w": none, "clutch_wins": F.col("metric"), "multikills": none})
    out = asof.team_snapshot(facts, rows.select("match_id", "team", "start_ts"), half_life=90.0)
    return out.select("match_id", "team", "n_maps", *(rounded(F.col(c), 3).alias(c) for c in ("round_share", "atk_eff", "fk_diff12", "pistol_wr", "clutch_per_map")))


def _snapshot_sql() -> str:
    r3 = lambda x: f"floor(({x}) * 1e3 + 0.5) / 1e3"
    age = "(epoch_us(p.start_ts) - epoch_us(f.start_ts)) / 86400000000.0::DOUBLE"
    league = """league AS (SELECT m.start_ts, coalesce(sum(metric), 0) AS gw, coalesce(sum(metric + rounds_lost), 0) AS gn, coalesce(count(metric), 0) AS gc FROM (SELECT DISTINCT start_ts FROM long) m
  LEFT JOIN long f ON f.end_ts <= m.start_ts GROUP BY m.start_ts)"""
    return f"""{with_views("long")}, {league}, s AS (
  SELECT p.match_id, p.team, p.start_ts, count(f.match_id) AS n, coalesce(sum(w * f.rounds_won), 0) AS rw, coalesce(sum(w * (f.rounds_won + f.rounds_lost)), 0) AS rn, sum(w * f.metric) AS aw, sum(w * (f.metric + f.rounds_lost)) AS an,
         sum(w * (f.metric - f.rounds_lost)) AS fk, sum(w * (f.rounds_won + f.rounds_lost)) FILTER (f.metric IS NOT NULL) AS fn, coalesce(sum(w * f.won), 0) AS pw, coalesce(sum(w * 2), 0) AS pn, sum(w) FILTER (f.metric IS NOT NULL) AS cn, count(f.metric) AS na
  FROM long p LEFT JOIN (SELECT * FROM long) f ON f.team = p.team AND f.end_ts <= p.start_ts, LATERAL (SELECT pow(0.5, {age} / 90) AS w) GROUP BY ALL)
SELECT match_id, team, n AS n_maps, {r3("(rw + 30) / (rn + 60)")} AS round_share, CASE WHEN na > 0 THEN {r3("(aw + 30 * CASE WHEN gn > 0 THEN gw / gn ELSE 0.5 END) / (an + 30)")} END AS atk_eff,
       CASE WHEN fn > 0 THEN {r3("fk / (fn + 60) * 12")} END AS fk_diff12, {r3("(pw + 8) / (pn + 16)")} AS pistol_wr, CASE WHEN cn > 0 THEN {r3("(aw + 5 * CASE WHEN gc > 0 THEN gw / gc ELSE 0 END) / (cn + 5)")} END AS clutch_per_map
FROM s JOIN league USING (start_ts)"""


def _games(spark, sf):
    played = ended(spark, sf).where("team1_score <> team2_score").withColumn("won", (F.col("team1_score") > F.col("team2_score")).cast("int"))
    return ratings.single_map(played)


def elo_prematch(spark, sf):
    out = ratings.prematch(ratings.rating_log(_games(spark, sf), tells=LOOKS))
    return out.select("match_id", rounded(F.col("rating"), 3).alias("rating"), rounded(F.col("opp_rating"), 3).alias("opp_rating"), rounded(F.col("p")).alias("p"), rounded(F.get("maps", F.lit(0))["rating"], 3).alias("map_rating"))


def elo_tuned_k(spark, sf):
    games = _games(spark, sf)
    out = ratings.tune_k(ratings.rated(games, ratings.K_GRID, tells=LOOKS, on_maps=False), games.select("match_id", "won"))
    return out.select("k", rounded(F.col("loss")).alias("loss"), "best")


def elo_trajectory(spark, sf):
    return ratings.trajectory(ratings.rating_log(_games(spark, sf), tells=CHANGES, on_maps=False), 10).select("team", "step", "match_id", rounded(F.col("rating"), 3).alias("rating"))


def elo_at_cutoff(spark, sf):
    return ratings.ratings_at(ratings.rating_log(_games(spark, sf), tells=CHANGES, on_maps=False), moment("2024-01-20")).select("team", rounded(F.col("rating"), 3).alias("rating"))


def lineups(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate")
    made = rows.groupBy("l_orderkey", "l_suppkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 50)).alias("lineup"), F.max("l_shipdate").alias("start_ts"))
    return made.select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("team"), "start_ts", F.expr("start_ts + INTERVAL 3 HOUR").alias("end_ts"), "lineup")


def core_roster(spark, sf):
    out = roster.core_roster(lineups(spark, sf))
    return out.select("team", F.array_join(F.transform("core", lambda x: x.cast("string")), ",").alias("core"), rounded(F.col("stability")).alias("stability"), rounded(F.col("core_absent")).alias("core_absent"), rounded(F.col("newface")).alias("newface"))


def membership(spark, sf):
    probes = table(spark, sf, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("probe_id"), (F.col("o_custkey") % table(spark, sf, "supplier").count() + 1).alias("team"), F.col("o_orderdate").alias("at"))
    out = roster.membership(lineups(spark, sf), probes)
    return out.select("probe_id", "team", rounded(F.col("roster_ext_maps_log")).alias("ext"), rounded(F.col("roster_coplay_log")).alias("coplay"))


_LINEUPS = """lineups AS (SELECT l_orderkey AS match_id, l_suppkey AS team, max(l_shipdate) AS start_ts, max(l_shipdate) + INTERVAL 3 HOUR AS end_ts, list_sort(list(DISTINCT l_partkey % 50)) AS lineup FROM lineitem GROUP BY 1, 2)"""


def series_dp(spark, sf):
    p = (F.col("team1_score") + 1) / F.lit(16.0)
    probs = F.transform(F.sequence(F.lit(1), F.col("best_of")), lambda i: p + F.lit(0.0) * i)
    return contests(spark, sf).select("match_id", rounded(series.series_prob(probs)).alias("p_series"))


def maps_dist(spark, sf):
    p = (F.col("team1_score") + 1) / F.lit(16.0)
    probs = F.transform(F.sequence(F.lit(1), F.col("best_of")), lambda i: p + F.lit(0.0) * i)
    rows = contests(spark, sf).select("match_id", F.explode(series.length_distribution(probs)).alias("games", "p"))
    return rows.select("match_id", F.col("games").cast("int").alias("games"), rounded(F.col("p")).alias("p"))


def sequence_complete(spark, sf):
    """Role sequences of whole conversations as maps played, completed by two from a veto that every second one has."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("played"))
    rows = turns.withColumn("veto", F.concat("played", F.array_repeat(F.lit("decider"), 2)))
    done = rows.select("conv_id", series.complete_sequence(F.col("played"), F.when(F.col("conv_id") % 2 == 0, F.col("veto")), F.size("played") + 2).alias("s"))
    return done.select("conv_id", F.array_join("s.maps", ",", "?").alias("maps"), F.col("s.n_filled").alias("n_filled"), F.col("s.n_fallback").alias("n_fallback"), F.col("s.source").alias("source"))


def veto_parse(spark, sf):
    """Vetoes spelled from order keys: bans, picks in other cases, and what remains."""
    names = F.array(*map(F.lit, VETO_MAPS))
    at = lambda k: F.get(names, ((F.col("o_orderkey") + k) % 4).cast("int"))
    bans = F.concat(F.lit("A ban "), at(0), F.lit("; B ban "), at(1))
    full = F.concat(bans, F.lit(";  A pick "), F.lower(at(2)), F.lit(" ; B pick "), F.upper(at(3)), F.lit("; "), at(0), F.lit(" remains"))
    veto = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 0, bans).otherwise(full)
    parsed = series.parse_veto(veto, names)
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(parsed, ",").alias("maps"))


def schedule(spark, sf):
    rows = contests(spark, sf).select("match_id", "start_ts")
    cut = moment(NOW)
    out = views.schedule(rows.where(F.col("start_ts") >= cut), rows.where(F.col("start_ts") < cut))
    return out.select("match_id", "section", "position")


#: Columns of the feature row that are shown with three decimals.
SHOWN = tuple(f"{n}_diff" for n in ("elo", "map_elo", *features.STATISTICS, *features.ROSTER, *features.MEMBERSHIP)) + ("hist_min",)


def feature_rows(spark, sf):
    """The whole feature row of every contest: both ratings, nine statistics, rest, rosters, context and indicators."""
    looks = ratings.prematch(ratings.rating_log(_games(spark, sf), tells=LOOKS))
    asked = contests(spark, sf).select("match_id", "start_ts", "team1", "team2", "map_name", "best_of", "series")
    out = features.feature_rows(lined_rows(spark, sf), asked, looks, maps=("click", "view"))
    return out.select("match_id", "best_of", "playoff", "a_n_maps", "b_n_maps", "low_history", *(F.col(f"map_{m}").cast("int").alias(f"map_{m}") for m in ("click", "view")), *(rounded(F.col(c), 3).alias(c) for c in SHOWN))


#: Weights of a given model, so that its predictions have SQL.
MODEL = {"elo_diff": 0.004, "map_elo_diff": 0.003, "round_share_diff": 2.0, "core_absent_diff": -0.5, "roster_coplay_diff": 0.2, "hist_min": 0.01, "map_click": 0.1}
AHEAD = "2024-01-29"


def predict_rows(spark, sf):
    """Contests from the last days predicted from what was played before, by a given model and by ratings."""
    score = lambda rows: rows.withColumn("p", 1 / (1 + F.exp(-sum((F.col(c) * w for c, w in MODEL.items()), F.lit(0.0)))))
    cut = moment(AHEAD)
    names = {f"team{i}_name": F.concat(F.lit("T"), F.col(f"team{i}").cast("string")) for i in (1, 2)}
    upcoming = contests(spark, sf).where(F.col("start_ts") >= cut).withColumns(names).select("match_id", "start_ts", "team1", "team2", *names, "best_of")
    facts, games = lined_rows(spark, sf).where(F.col("start_ts") < cut), _games(spark, sf).where(F.col("start_ts") < cut)
    out = predict.predict(score, facts, upcoming, ("click", "view"), maps=("click", "view"), games=games, baseline_k=64)
    return out.select("match_id", "low_history", "p_map", "p_series", "p_elo", *(F.col(f"p_by_map.{m}").alias(f"p_{m}") for m in ("click", "view")), F.col("elo_by_map.click").alias("elo_click"))


def chrono_split(spark, sf):
    return evaluation.chronological_split(contests(spark, sf)).select("match_id", "part")


def folds(spark, sf):
    return evaluation.expanding_folds(contests(spark, sf)).select("match_id", "fold")


def augment(spark, sf):
    rows = contests(spark, sf).select("match_id", (F.col("team1_score") - F.col("team2_score")).alias("score_diff"), (F.col("team1_score") > F.col("team2_score")).cast("int").alias("y"), F.col("best_of"))
    return evaluation.augment_swapped(rows, ["score_diff"], "y")


def tz_shift(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", zone_to_utc(F.col("o_orderdate")).cast("timestamp_ntz").alias("utc"))


def periods(spark, sf):
    return table(spark, sf, "orders").groupBy(half_year("o_orderdate").alias("period")).agg(F.count("*").alias("n"))


def phase_peak(spark, sf):
    events = table(spark, sf, "events")
    phases = events.select(F.col("event_id").alias("phase_id"), F.col("ts").alias("begin"), F.expr("ts + INTERVAL 2 HOUR").alias("finish"))
    return phase_peaks(events.select("ts", "value"), phases)


def cadence(spark, sf):
    return evaluation.cadence_ticks(ended(spark, sf).select("match_id", "end_ts"), warmup=300)


def baselines(spark, sf):
    """Plain callers on the last part of the contests: ratings, ratings on the map, the favourite, and even odds."""
    test = evaluation.chronological_split(_games(spark, sf).select("match_id", "start_ts", "won")).where("part = 'test'")
    m = F.get("maps", F.lit(0))
    looks = ratings.prematch(ratings.rating_log(_games(spark, sf), tells=LOOKS)).select("match_id", "p", expected_score(m["rating"], m["opp_rating"]).alias("p_map"))
    out = evaluation.baselines(test.join(looks, "match_id"), {"ratings": "p", "ratings_on_map": "p_map"}, "won")
    return out.select("caller", "n", *(rounded(F.col(c)).alias(c) for c in ("log_loss", "brier", "accuracy")))


def _coordinates(spark, sf) -> tuple[DataFrame, list[str]]:
    e = table(spark, sf, "embeddings")
    names = [f"x{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return e.select(*(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names))), names


def corr_topk(spark, sf):
    rows, names = _coordinates(spark, sf)
    return evaluation.top_correlations(rows, names, 10).select("a", "b", rounded(F.abs(F.col("r"))).alias("r"))


def vif(spark, sf):
    return evaluation.vif(*_coordinates(spark, sf))


QUERIES = {f.__name__: f for f in (trends_all, trends_current, trends_scoped, long_frame, match_lite, match_table, pool_table, pool_top, pool_fallback, asof_counts, asof_decayed, asof_shrunk, asof_priors, asof_by_map, rest_days, range_join_counts, roster_weighted, stand_ins, snapshot, elo_prematch, elo_tuned_k, elo_trajectory, elo_at_cutoff, core_roster, membership, series_dp, maps_dist, sequence_complete, veto_parse, schedule, feature_rows, predict_rows, chrono_split, folds, augment, tz_shift, periods, phase_peak, cadence, baselines, corr_topk, vif)}

#: Looks and results in order of time, with teams and maps numbered from 1.
_EVENTS_SQL = """games AS (
  SELECT match_id, start_ts, end_ts, team1, team2, CAST(team1_score > team2_score AS INT) AS won,
         dense_rank() OVER (ORDER BY map_name) AS m FROM contests WHERE team1_score <> team2_score
), teams AS (
  SELECT team, row_number() OVER (ORDER BY team) AS u FROM (SELECT team1 AS team FROM games UNION SELECT team2 FROM games)
), ev AS (
  SELECT e.*, a.u AS ua, b.u AS ub, row_number() OVER (ORDER BY moment, look, start_ts, match_id) AS i
  FROM (SELECT *, end_ts AS moment, 0 AS look FROM games UNION ALL SELECT *, start_ts, 1 FROM games) e
  JOIN teams a ON a.team = team1 JOIN teams b ON b.team = team2
)"""
#: One row per event and K: the overall ratings of all teams after it.
_BOOK_SQL = """book(i, k, o) AS (
  SELECT 0::BIGINT, k, list_transform(range((SELECT count(*) FROM teams)), lambda x: 1500.0::DOUBLE) FROM ks
  UNION ALL
  SELECT e.i, k, CASE WHEN look = 1 THEN o ELSE list_transform(o, lambda x, j: x + CASE WHEN j = ua THEN 1 WHEN j = ub THEN -1 ELSE 0 END
         * k * (won - 1 / (1 + pow(10.0::DOUBLE, (o[ub] - o[ua]) / 400)))) END
  FROM book JOIN ev e ON e.i = book.i + 1
), log AS (
  SELECT k, look, match_id, moment, team1, team2, o[ua] AS ra, o[ub] AS rb FROM book JOIN ev USING (i)
), changes AS (
  SELECT k, match_id, moment, team1 AS team, ra AS rating FROM log WHERE look = 0 UNION ALL SELECT k, match_id, moment, team2, rb FROM log WHERE look = 0
)"""
#: The same for K = 32 with the ratings on five maps (r) and the games there (g), by team and map.
_MAP_BOOK_SQL = """book(i, o, r, g) AS (
  SELECT 0::BIGINT, list_transform(range(n), lambda x: 1500.0::DOUBLE), list_transform(range(n * 5), lambda x: NULL::DOUBLE), list_transform(range(n * 5), lambda x: 0::INT) FROM (SELECT count(*) AS n FROM teams)
  UNION ALL
  SELECT i1,
    CASE WHEN look = 1 THEN o ELSE list_transform(o, lambda x, j: x + CASE WHEN j = ua THEN 1 WHEN j = ub THEN -1 ELSE 0 END * 32 * (won - 1 / (1 + pow(10.0::DOUBLE, (o[ub] - o[ua]) / 400)))) END,
    CASE WHEN look = 1 THEN r ELSE list_transform(r, lambda x, j: CASE WHEN j = ca THEN ma + 32 * (won - 1 / (1 + pow(10.0::DOUBLE, (mb - ma) / 400))) WHEN j = cb THEN mb - 32 * (won - 1 / (1 + pow(10.0::DOUBLE, (mb - ma) / 400))) ELSE x END) END,
    CASE WHEN look = 1 THEN g ELSE list_transform(g, lambda x, j: x + CASE WHEN j = ca OR j = cb THEN 1 ELSE 0 END) END
  FROM (SELECT book.*, e.i AS i1, look, won, ua, ub, (ua - 1) * 5 + m AS ca, (ub - 1) * 5 + m AS cb, coalesce(r[(ua - 1) * 5 + m], o[ua]) AS ma, coalesce(r[(ub - 1) * 5 + m], o[ub]) AS mb FROM book JOIN ev e ON e.i = book.i + 1) e
)"""

_R4 = "floor(({}) * 1e4 + 0.5) / 1e4".format
_R3 = "floor(({}) * 1e3 + 0.5) / 1e3".format
_PAIRS = "FROM long p LEFT JOIN long f ON f.team = p.team AND f.end_ts <= p.start_ts"
_P = "((team1_score + 1) / 16.0::DOUBLE)"
_AT20 = "TIMESTAMP '2024-01-20'"
#: Facts with line-ups and all statistics, as ``lined_rows`` makes them.
_LINED_SQL = """facts AS (SELECT *, CASE WHEN match_id % 11 = 0 THEN []::VARCHAR[] ELSE list_sort(list_transform([0, 1, 2], lambda i: 'p' || CAST((team * 3 + i * 2 + match_id // 64) % 400 AS VARCHAR))) END AS lineup,
  CASE WHEN match_id % 5 <> 0 THEN rounds_won + 1 END AS fbn, CASE WHEN match_id % 5 <> 0 THEN won END AS fbw, CASE WHEN match_id % 3 <> 0 THEN rounds_lost + 1 END AS lbn, CASE WHEN match_id % 3 <> 0 THEN 1 - won END AS lbw,
  CASE WHEN match_id % 7 <> 0 THEN rounds_won % 4 END AS mk FROM long)"""
#: Each probe's eligible facts with their weight (half-life {h}): the core is counted anew from the last five of them.
_WEIGHED_SQL = """el AS (
  SELECT p.pm, p.moment, p.team, f.* EXCLUDE (team), row_number() OVER (PARTITION BY p.pm, p.team ORDER BY f.end_ts DESC, f.start_ts DESC, f.match_id DESC) AS back FROM probes p JOIN facts f ON f.team = p.team AND f.end_ts <= p.moment
), cores AS (
  SELECT pm, team, list(player ORDER BY n DESC, player)[1:5] AS core FROM (SELECT pm, team, player, count(*) AS n FROM (SELECT pm, team, unnest(lineup) AS player FROM el WHERE back <= 5) GROUP BY ALL) GROUP BY ALL
), weighed AS (
  SELECT el.*, core, len(list_intersect(lineup, core)) AS common, pow(0.5, (epoch_us(moment) - epoch_us(start_ts)) / 86400000000.0::DOUBLE / {h}) * CASE WHEN len(lineup) = 0 OR core IS NULL THEN 1 ELSE pow(0.8, 5 - len(list_intersect(lineup, core))) END AS w
  FROM el LEFT JOIN cores USING (pm, team)
)"""
#: Statistics of every probe.
_SIDES_SQL = """league AS (
  SELECT m.moment, coalesce(sum(metric), 0) AS gw, coalesce(sum(metric + rounds_lost), 0) AS gn, count(metric) AS gc, coalesce(sum(fbw), 0) AS bw, coalesce(sum(fbn), 0) AS bn, coalesce(sum(lbw), 0) AS lw, coalesce(sum(lbn), 0) AS ln, coalesce(sum(mk), 0) AS mw, count(mk) AS mc
  FROM (SELECT DISTINCT moment FROM probes) m LEFT JOIN facts f ON f.end_ts <= m.moment GROUP BY m.moment
), s AS (
  SELECT p.pm, p.team, p.moment, count(w) AS n, coalesce(sum(w * rounds_won), 0) AS rw, coalesce(sum(w * (rounds_won + rounds_lost)), 0) AS rn, sum(w * metric) AS aw, sum(w * (metric + rounds_lost)) AS an, sum(w * rounds_won) FILTER (metric IS NOT NULL) AS dw,
    sum(w * (rounds_won + rounds_lost)) FILTER (metric IS NOT NULL) AS dn, sum(w * (metric - rounds_lost)) AS fk, coalesce(sum(w * won), 0) AS pw, coalesce(sum(w * 2), 0) AS pn, sum(w * fbw) AS sbw, sum(w * fbn) AS sbn, sum(w * lbw) AS slw, sum(w * lbn) AS sln,
    sum(w) FILTER (metric IS NOT NULL) AS cn, sum(w * mk) AS smw, sum(w) FILTER (mk IS NOT NULL) AS smn, coalesce(least((epoch_us(p.moment) - epoch_us(max(start_ts))) / 86400000000.0::DOUBLE, 30), 30) AS rest,
    avg(common / 5.0::DOUBLE) FILTER (back <= 5 AND len(lineup) > 0) AS stability, arg_min({'l': lineup, 'c': common, 'm': len(core)}, back) FILTER (back <= 5 AND len(lineup) > 0) AS newest, arg_min(lineup, back) FILTER (len(lineup) > 0) AS own
  FROM probes p LEFT JOIN weighed USING (pm, team) GROUP BY p.pm, p.team, p.moment
), mine AS (SELECT pm, team, moment, unnest(own) AS player FROM s), played AS (SELECT match_id, team, end_ts, unnest(lineup) AS player FROM facts),
ext AS (SELECT pm, m.team, count(*) AS n FROM mine m JOIN played f ON f.player = m.player AND f.end_ts <= m.moment AND f.team <> m.team GROUP BY 1, 2),
two AS (SELECT a.pm, a.team, a.moment, a.player AS x, b.player AS y FROM mine a JOIN mine b ON a.pm = b.pm AND a.team = b.team AND a.player < b.player),
met AS (SELECT a.end_ts, a.player AS x, b.player AS y FROM played a JOIN played b ON a.match_id = b.match_id AND a.team = b.team AND a.player < b.player),
co AS (SELECT pm, team, avg(n) AS n FROM (SELECT pm, team, two.x, two.y, count(met.end_ts) FILTER (met.end_ts <= moment) AS n FROM two LEFT JOIN met ON met.x = two.x AND met.y = two.y GROUP BY ALL) GROUP BY 1, 2),
sided AS (
  SELECT s.pm, s.team, s.n, (rw + 30) / (rn + 60) AS round_share, CASE WHEN an IS NOT NULL THEN (aw + 30 * CASE WHEN gn > 0 THEN gw / gn ELSE 0.5 END) / (an + 30) END AS atk_eff, CASE WHEN an IS NOT NULL THEN (dw + 30 * (1 - CASE WHEN gn > 0 THEN gw / gn ELSE 0.5 END)) / (dn + 30) END AS def_eff,
    CASE WHEN dn > 0 THEN fk / (dn + 60) * 12 END AS fk_diff12, (pw + 8) / (pn + 16) AS pistol_wr, CASE WHEN sbn IS NOT NULL THEN (sbw + 30 * CASE WHEN bn > 0 THEN bw / bn ELSE 0.5 END) / (sbn + 30) END AS fullbuy_wr,
    CASE WHEN sln IS NOT NULL THEN (slw + 30 * CASE WHEN league.ln > 0 THEN lw / league.ln ELSE 0.15 END) / (sln + 30) END AS lowbuy_wr, CASE WHEN cn > 0 THEN (aw + 5 * CASE WHEN gc > 0 THEN gw / gc ELSE 0 END) / (cn + 5) END AS clutch_per_map,
    CASE WHEN smn > 0 THEN (smw + 5 * CASE WHEN mc > 0 THEN mw / mc ELSE 0 END) / (smn + 5) END AS multikill_per_map, rest, stability, (newest.m - newest.c) / 5.0::DOUBLE AS core_absent, (len(newest.l) - newest.c) / greatest(len(newest.l), 1)::DOUBLE AS newface,
    ln(1 + coalesce(ext.n, 0)::DOUBLE) AS ext, ln(1 + coalesce(co.n, 0)) AS coplay
  FROM s JOIN league USING (moment) LEFT JOIN ext ON ext.pm = s.pm AND ext.team = s.team LEFT JOIN co ON co.pm = s.pm AND co.team = s.team
)"""
_SIDE_OF = {n: n for n in (*features.STATISTICS, "core_absent", "newface")} | {"rest_days": "rest", "roster_stability": "stability", "roster_ext_maps": "ext", "roster_coplay": "coplay"}
_DIFFS_SQL = ", ".join(f"{_R3('ln(1 + a.rest) - ln(1 + b.rest)' if c == 'rest' else f'a.{c} - b.{c}')} AS {n}_diff" for n, c in _SIDE_OF.items())
#: Ratings of both sides on the maps of the pool before contests to come, for both K: what the last result before each left.
_AHEAD_SQL = f"""games AS (
  SELECT match_id, start_ts, end_ts, team1, team2, CAST(team1_score > team2_score AS INT) AS won, dense_rank() OVER (ORDER BY map_name) AS m, map_name FROM contests WHERE team1_score <> team2_score AND start_ts < TIMESTAMP '{AHEAD}'
), teams AS (SELECT team, row_number() OVER (ORDER BY team) AS u FROM (SELECT team1 AS team FROM contests UNION SELECT team2 FROM contests)), ks AS (SELECT unnest([32, 64])::DOUBLE AS k),
ev AS (SELECT g.*, a.u AS ua, b.u AS ub, row_number() OVER (ORDER BY end_ts, start_ts, match_id) AS i FROM games g JOIN teams a ON a.team = team1 JOIN teams b ON b.team = team2),
book(i, k, o, r, g) AS (
  SELECT 0::BIGINT, k, list_transform(range(n), lambda x: 1500.0::DOUBLE), list_transform(range(n * 5), lambda x: NULL::DOUBLE), list_transform(range(n * 5), lambda x: 0::INT) FROM ks, (SELECT count(*) AS n FROM teams)
  UNION ALL
  SELECT i1, k, list_transform(o, lambda x, j: x + CASE WHEN j = ua THEN 1 WHEN j = ub THEN -1 ELSE 0 END * k * (won - 1 / (1 + pow(10.0::DOUBLE, (o[ub] - o[ua]) / 400)))),
    list_transform(r, lambda x, j: CASE WHEN j = ca THEN ma + k * (won - 1 / (1 + pow(10.0::DOUBLE, (mb - ma) / 400))) WHEN j = cb THEN mb - k * (won - 1 / (1 + pow(10.0::DOUBLE, (mb - ma) / 400))) ELSE x END),
    list_transform(g, lambda x, j: x + CASE WHEN j = ca OR j = cb THEN 1 ELSE 0 END)
  FROM (SELECT book.*, e.i AS i1, won, ua, ub, (ua - 1) * 5 + m AS ca, (ub - 1) * 5 + m AS cb, coalesce(r[(ua - 1) * 5 + m], o[ua]) AS ma, coalesce(r[(ub - 1) * 5 + m], o[ub]) AS mb FROM book JOIN ev e ON e.i = book.i + 1) e
), maps AS (SELECT DISTINCT map_name, m FROM games WHERE map_name IN ('click', 'view')),
at_look AS (SELECT c.match_id, c.team1, c.team2, (SELECT count(*) FROM ev WHERE ev.end_ts <= c.start_ts) AS i FROM ahead c),
stood AS (
  SELECT l.match_id, k, map_name, o[a.u] AS oa, o[b.u] AS ob, (g[(a.u - 1) * 5 + m] * coalesce(r[(a.u - 1) * 5 + m], o[a.u]) + 10 * o[a.u]) / (g[(a.u - 1) * 5 + m] + 10.0::DOUBLE) AS ea,
         (g[(b.u - 1) * 5 + m] * coalesce(r[(b.u - 1) * 5 + m], o[b.u]) + 10 * o[b.u]) / (g[(b.u - 1) * 5 + m] + 10.0::DOUBLE) AS eb
  FROM at_look l JOIN book USING (i) JOIN teams a ON a.team = l.team1 JOIN teams b ON b.team = l.team2, maps
)"""
_PUB = "least(greatest(floor(({}) * 1e4 + 0.5) / 1e4, 1e-4), 1 - 1e-4)".format
_BEST = lambda p: f"CASE best_of WHEN 1 THEN {p} WHEN 3 THEN {p} * {p} * (3 - 2 * {p}) ELSE pow({p}, 3) * (10 - 15 * {p} + 6 * {p} * {p}) END"
ORACLES = {
    "trends_all": _trends_sql(least=1),
    "trends_current": _trends_sql(window=10, active="last_any >= TIMESTAMP '2024-01-31' - INTERVAL 60 DAY"),
    "trends_scoped": _trends_sql(scope=f"event = 'click' AND start_ts >= TIMESTAMP '2024-01-05' AND start_ts <= {_AT20}"),
    "long_frame": f"{with_views('long')} SELECT match_id, start_ts, end_ts, team, opp, is_team1, won, rounds_won, rounds_lost, metric FROM long",
    "match_lite": f"{with_views('long')} SELECT match_id, start_ts, team AS a, opp AS b, 1 AS n_maps, map_name AS first_map, won AS first_won FROM long WHERE is_team1",
    "match_table": f"{with_views('long')} SELECT match_id, count(*) AS n_maps, CAST(sum(won) AS BIGINT) AS n_won, CAST(sum(won) AS INT) AS team1_won FROM long WHERE is_team1 GROUP BY match_id",
    "pool_table": _pool_sql("TIMESTAMP '2024-01-31'", 60, f"pow(0.5, {_AGE} / 14)", "", f", {_R4('sum(w)')} AS weighted, max(start_ts) AS last_played"),
    "pool_top": _pool_sql("TIMESTAMP '2024-01-31'", 60, f"pow(0.5, {_AGE} / 14)", "ORDER BY sum(w) DESC, map_name LIMIT 3", ""),
    "pool_fallback": _pool_sql("TIMESTAMP '2025-01-31'", 60, "1.0::DOUBLE", "", f", {_R4('sum(w)')} AS weighted"),
    "asof_counts": f"{with_views('long')} SELECT p.match_id, p.team, count(f.match_id) AS n, CAST(coalesce(sum(f.won), 0) AS BIGINT) AS wins {_PAIRS} GROUP BY 1, 2",
    "asof_decayed": f"{with_views('long')} SELECT p.match_id, p.team, {_R3('coalesce(sum(pow(0.5, (epoch_us(p.start_ts) - epoch_us(f.start_ts)) / 86400000000.0::DOUBLE / 14)), 0)')} AS weight, {_R3('coalesce(sum(f.won * pow(0.5, (epoch_us(p.start_ts) - epoch_us(f.start_ts)) / 86400000000.0::DOUBLE / 14)), 0)')} AS won {_PAIRS} GROUP BY 1, 2",
    "asof_shrunk": f"{with_views('long')} SELECT p.match_id, p.team, {_R4('(coalesce(sum(f.rounds_won), 0) + 30)::DOUBLE / (coalesce(sum(f.rounds_won + f.rounds_lost), 0) + 60)')} AS round_share {_PAIRS} GROUP BY 1, 2",
    "asof_priors": f"{with_views('long')}, m AS (SELECT DISTINCT start_ts FROM long) SELECT m.start_ts, {_R4('CASE WHEN sum(rounds_won + rounds_lost) FILTER (metric IS NOT NULL) > 0 THEN sum(metric)::DOUBLE / sum(rounds_won + rounds_lost) FILTER (metric IS NOT NULL) ELSE 0.5 END')} AS prior FROM m LEFT JOIN long f ON f.end_ts <= m.start_ts GROUP BY 1",
    "asof_by_map": f"{with_views('long')} SELECT p.match_id, p.team, count(f.match_id) AS n {_PAIRS} AND f.map_name = p.map_name GROUP BY 1, 2",
    "rest_days": f"{with_views('long')} SELECT p.match_id, p.team, {_R4('coalesce(least((epoch_us(p.start_ts) - epoch_us(max(f.start_ts))) / 86400000000.0::DOUBLE, 30), 30)')} AS rest_days {_PAIRS} GROUP BY p.match_id, p.team, p.start_ts",
    "range_join_counts": f"{with_views('long')} SELECT p.match_id, p.team, count(f.match_id) AS n, count(*) FILTER (f.opp = p.opp) AS n_same_opp {_PAIRS} GROUP BY 1, 2",
    "roster_weighted": f"""{with_views("long")}, {_LINED_SQL}, probes AS (SELECT match_id AS pm, start_ts AS moment, team FROM long), {_WEIGHED_SQL.format(h=14)}
SELECT p.pm AS match_id, p.team, count(w) AS n, {_R3("coalesce(sum(w), 0)")} AS weight, {_R3("coalesce(sum(w * rounds_won), 0)")} AS rounds FROM probes p LEFT JOIN weighed USING (pm, team) GROUP BY 1, 2""",
    "stand_ins": f"""{with_views("long")}, {_LINED_SQL}, probes AS (SELECT match_id AS pm, start_ts AS moment, team FROM facts WHERE len(lineup) > 0), {_WEIGHED_SQL.format(h=90)}
SELECT f.match_id, f.team, len(core) - len(list_intersect(core, lineup)) AS n_absent, len(lineup) - CASE WHEN core IS NOT NULL THEN len(list_intersect(core, lineup)) END AS n_new FROM facts f LEFT JOIN cores c ON c.pm = f.match_id AND c.team = f.team WHERE len(lineup) > 0""",
    "snapshot": _snapshot_sql(),
    "elo_prematch": f"""{with_views("contests", recursive=True)}, {_EVENTS_SQL}, {_MAP_BOOK_SQL}, looks AS (
  SELECT match_id, o[ua] AS ra, o[ub] AS rb, g[(ua - 1) * 5 + m] AS n, coalesce(r[(ua - 1) * 5 + m], o[ua]) AS ma FROM book JOIN ev USING (i) WHERE look = 1
) SELECT match_id, {_R3("ra")} AS rating, {_R3("rb")} AS opp_rating, {_R4("1 / (1 + pow(10.0::DOUBLE, (rb - ra) / 400))")} AS p, {_R3("n / (n + 10.0::DOUBLE) * ma + (1 - n / (n + 10.0::DOUBLE)) * ra")} AS map_rating FROM looks""",
    "baselines": f"""{with_views("contests", recursive=True)}, {_EVENTS_SQL}, {_MAP_BOOK_SQL}, placed AS (SELECT match_id, row_number() OVER (ORDER BY start_ts, match_id) AS place, count(*) OVER () AS total FROM games),
p AS (SELECT match_id, won, 1 / (1 + pow(10.0::DOUBLE, (rb - ra) / 400)) AS p, 1 / (1 + pow(10.0::DOUBLE, ((nb * mb + 10 * rb) / (nb + 10.0::DOUBLE) - (na * ma + 10 * ra) / (na + 10.0::DOUBLE)) / 400)) AS q
  FROM (SELECT match_id, won, o[ua] AS ra, o[ub] AS rb, g[(ua - 1) * 5 + m] AS na, coalesce(r[(ua - 1) * 5 + m], o[ua]) AS ma, g[(ub - 1) * 5 + m] AS nb, coalesce(r[(ub - 1) * 5 + m], o[ub]) AS mb FROM book JOIN ev USING (i) WHERE look = 1) JOIN placed USING (match_id) WHERE place > floor(total * 0.85::DOUBLE)),
calls AS (SELECT won, unnest([{{'c': 'ratings', 'p': p}}, {{'c': 'ratings_on_map', 'p': q}}, {{'c': 'favourite', 'p': p}}, {{'c': 'even', 'p': 0.5::DOUBLE}}]) AS x FROM p)
SELECT x.c AS caller, count(*) AS n, {_R4("CASE WHEN x.c <> 'favourite' THEN avg(-ln(CASE WHEN won = 1 THEN x.p ELSE 1 - x.p END)) END")} AS log_loss, {_R4("CASE WHEN x.c <> 'favourite' THEN avg((x.p - won) * (x.p - won)) END")} AS brier,
       {_R4("CASE WHEN x.c <> 'even' THEN avg(CASE WHEN (x.p >= 0.5) = (won = 1) THEN 1.0::DOUBLE ELSE 0.0 END) END")} AS accuracy FROM calls GROUP BY 1""",
    "cadence": f"""{with_views("contests", recursive=True)}, placed AS (SELECT end_ts, row_number() OVER (ORDER BY end_ts, match_id) AS i FROM contests), begin AS (SELECT end_ts AS t0 FROM placed WHERE i = 300),
slots AS (SELECT greatest(0, ceil((epoch_us(end_ts) - epoch_us(t0)) / 21600000000.0::DOUBLE))::BIGINT AS s FROM contests, begin), ticks AS (SELECT t.s, (SELECT count(*) FROM slots WHERE slots.s <= t.s) AS done FROM (SELECT unnest(range(0, (SELECT max(s) FROM slots) + 1)) AS s) t),
later AS (SELECT a.s, min(b.s) AS s2 FROM ticks a JOIN ticks b ON b.s > a.s AND ((b.s - a.s) * 6 >= 168 OR b.done - a.done >= 100) GROUP BY a.s),
chosen(n, s, was) AS (SELECT 1, 0::BIGINT, NULL::BIGINT UNION ALL SELECT n + 1, s2, chosen.s FROM chosen JOIN later USING (s))
SELECT n AS index, t0 + to_hours(CAST(6 * s AS INT)) AS "at", done AS n_done, CASE WHEN was IS NULL THEN 'warmup' WHEN (s - was) * 6 >= 168 THEN 'age' ELSE 'new' END AS reason FROM chosen JOIN ticks USING (s), begin""",
    "elo_tuned_k": f"""{with_views("contests", recursive=True)}, {_EVENTS_SQL}, ks AS (SELECT unnest([16, 24, 32, 40, 50, 64, 80, 100, 128])::DOUBLE AS k), {_BOOK_SQL}, losses AS (
  SELECT k, avg(-ln(CASE WHEN won = 1 THEN p ELSE 1 - p END)) AS loss FROM (SELECT k, won, least(greatest(1 / (1 + pow(10.0::DOUBLE, (rb - ra) / 400)), 1e-6), 1 - 1e-6) AS p FROM log JOIN games USING (match_id) WHERE look = 1) GROUP BY k
) SELECT k, {_R4("loss")} AS loss, k = (SELECT k FROM losses ORDER BY loss, k LIMIT 1) AS best FROM losses""",
    "elo_trajectory": f"""{with_views("contests", recursive=True)}, {_EVENTS_SQL}, ks AS (SELECT 32.0::DOUBLE AS k), {_BOOK_SQL}, last AS (
  SELECT *, row_number() OVER (PARTITION BY team ORDER BY moment DESC, match_id DESC) AS back, count(*) OVER (PARTITION BY team) AS n FROM changes
) SELECT team, CAST(least(n, 10) - back + 1 AS INT) AS step, match_id, {_R3("rating")} AS rating FROM last WHERE back <= 10""",
    "elo_at_cutoff": f"""{with_views("contests", recursive=True)}, {_EVENTS_SQL}, ks AS (SELECT 32.0::DOUBLE AS k), {_BOOK_SQL}
SELECT team, {_R3("arg_max(rating, (moment, match_id))")} AS rating FROM changes WHERE moment <= {_AT20} GROUP BY team""",
    "core_roster": f"""WITH {_LINEUPS}, recent AS (SELECT team, lineup, back FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY end_ts DESC, start_ts DESC, match_id DESC) AS back FROM lineups) WHERE back <= 5),
counted AS (SELECT team, player, count(*) AS n FROM (SELECT team, unnest(lineup) AS player FROM recent) GROUP BY 1, 2),
core AS (SELECT team, list_sort(list(player)) AS core FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n DESC, player) AS r FROM counted) WHERE r <= 5 GROUP BY team),
j AS (SELECT team, core, lineup, back, len(list_intersect(lineup, core)) AS common FROM recent JOIN core USING (team))
SELECT team, array_to_string(any_value(core), ',') AS core, {_R4("avg(common / 5.0::DOUBLE)")} AS stability, {_R4("(len(any_value(core)) - min(common) FILTER (back = 1)) / 5.0::DOUBLE")} AS core_absent,
       {_R4("(min(len(lineup)) FILTER (back = 1) - min(common) FILTER (back = 1))::DOUBLE / greatest(min(len(lineup)) FILTER (back = 1), 1)")} AS newface FROM j GROUP BY team""",
    "membership": f"""WITH {_LINEUPS}, probes AS (SELECT o_orderkey AS probe_id, o_custkey % (SELECT count(*) FROM supplier) + 1 AS team, o_orderdate AS moment FROM orders WHERE o_orderkey % 20 = 0),
own AS (SELECT probe_id, p.team, moment, arg_max(lineup, (end_ts, start_ts, match_id)) AS lineup FROM probes p JOIN lineups l ON l.team = p.team AND end_ts <= moment GROUP BY 1, 2, 3),
pl AS (SELECT match_id, team, end_ts, unnest(lineup) AS player FROM lineups), mine AS (SELECT probe_id, team, moment, unnest(lineup) AS player FROM own),
ext AS (SELECT probe_id, count(*) AS n FROM mine m JOIN pl ON pl.player = m.player AND pl.end_ts <= moment AND pl.team <> m.team GROUP BY 1),
pairs AS (SELECT a.match_id, a.team, a.end_ts, a.player AS x, b.player AS y FROM pl a JOIN pl b ON a.match_id = b.match_id AND a.team = b.team AND a.player < b.player),
mp AS (SELECT a.probe_id, a.moment, a.player AS x, b.player AS y FROM mine a JOIN mine b ON a.probe_id = b.probe_id AND a.player < b.player),
met AS (SELECT probe_id, mp.x, mp.y, count(pairs.match_id) FILTER (pairs.end_ts <= moment) AS n FROM mp LEFT JOIN pairs ON pairs.x = mp.x AND pairs.y = mp.y GROUP BY 1, 2, 3),
co AS (SELECT probe_id, avg(n) AS n FROM met GROUP BY 1)
SELECT p.probe_id, p.team, {_R4("ln(1 + coalesce(ext.n, 0)::DOUBLE)")} AS ext, {_R4("ln(1 + coalesce(co.n, 0))")} AS coplay FROM probes p LEFT JOIN ext USING (probe_id) LEFT JOIN co USING (probe_id)""",
    "series_dp": f"{with_views('contests')} SELECT match_id, {_R4(f'CASE best_of WHEN 1 THEN {_P} WHEN 3 THEN {_P} * {_P} * (3 - 2 * {_P}) ELSE pow({_P}, 3) * (10 - 15 * {_P} + 6 * {_P} * {_P}) END')} AS p_series FROM contests",
    "maps_dist": f"""{with_views("contests")}, q AS (SELECT match_id, best_of, {_P} AS p FROM contests), d AS (
  SELECT match_id, 1 AS games, 1.0::DOUBLE AS p FROM q WHERE best_of = 1
  UNION ALL SELECT match_id, 2, p * p + (1 - p) * (1 - p) FROM q WHERE best_of = 3 UNION ALL SELECT match_id, 3, 2 * p * (1 - p) FROM q WHERE best_of = 3
  UNION ALL SELECT match_id, 3, pow(p, 3) + pow(1 - p, 3) FROM q WHERE best_of = 5 UNION ALL SELECT match_id, 4, 3 * p * (1 - p) * (pow(p, 3) + pow(1 - p, 3)) / 1 FROM q WHERE best_of = 5
  UNION ALL SELECT match_id, 5, 6 * p * p * (1 - p) * (1 - p) FROM q WHERE best_of = 5) SELECT match_id, games, {_R4("p")} AS p FROM d""".replace("3 * p * (1 - p) * (pow(p, 3) + pow(1 - p, 3)) / 1", "3 * pow(p, 3) * (1 - p) + 3 * pow(1 - p, 3) * p"),
    "sequence_complete": """WITH t AS (SELECT conv_id, list(role ORDER BY turn, role) AS played FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, played, len(played) AS n, conv_id % 2 = 0 AS fits FROM t)
SELECT conv_id, array_to_string(CASE WHEN fits THEN list_concat(played, ['decider', 'decider']) ELSE list_concat(played, ['?', '?']) END, ',') AS maps,
       CASE WHEN fits THEN 2 ELSE 0 END AS n_filled, CASE WHEN fits THEN 0 ELSE 2 END AS n_fallback, CASE WHEN fits THEN 'veto' ELSE 'fallback' END AS source FROM s""",
    "veto_parse": """WITH t AS (SELECT o_orderkey, ['Bind', 'Split', 'Haven', 'Lotus'] AS m FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN m[(o_orderkey + 2) % 4 + 1] || ',' || m[(o_orderkey + 3) % 4 + 1] || ',' || m[o_orderkey % 4 + 1] END AS maps FROM t""",
    "schedule": f"""{with_views("contests")} SELECT match_id, CASE WHEN start_ts >= TIMESTAMP '2024-01-31' THEN 0 ELSE 1 END AS section,
       CASE WHEN start_ts >= TIMESTAMP '2024-01-31' THEN epoch_us(start_ts) ELSE -epoch_us(start_ts) END AS position FROM contests""",
    "feature_rows": f"""{with_views("contests", "long", recursive=True)}, {_LINED_SQL}, probes AS (SELECT match_id AS pm, start_ts AS moment, unnest([team1, team2]) AS team FROM contests), {_WEIGHED_SQL.format(h=90)}, {_SIDES_SQL},
{_EVENTS_SQL}, {_MAP_BOOK_SQL}, looks AS (SELECT match_id, o[ua] AS ra, o[ub] AS rb, g[(ua - 1) * 5 + m] AS na, coalesce(r[(ua - 1) * 5 + m], o[ua]) AS ma, g[(ub - 1) * 5 + m] AS nb, coalesce(r[(ub - 1) * 5 + m], o[ub]) AS mb FROM book JOIN ev USING (i) WHERE look = 1)
SELECT c.match_id, best_of, CAST(FALSE AS INT) AS playoff, a.n AS a_n_maps, b.n AS b_n_maps, least(a.n, b.n) < 3 AS low_history, CAST(c.map_name = 'click' AS INT) AS map_click, CAST(c.map_name = 'view' AS INT) AS map_view,
       {_R3("ra - rb")} AS elo_diff, {_R3("(na * ma + 10 * ra) / (na + 10.0::DOUBLE) - (nb * mb + 10 * rb) / (nb + 10.0::DOUBLE)")} AS map_elo_diff, {_R3("ln(1 + least(a.n, b.n)::DOUBLE)")} AS hist_min, {_DIFFS_SQL}
FROM contests c JOIN sided a ON a.pm = c.match_id AND a.team = c.team1 JOIN sided b ON b.pm = c.match_id AND b.team = c.team2 LEFT JOIN looks l ON l.match_id = c.match_id""",
    "predict_rows": f"""{with_views("contests", "long", recursive=True)}, {_LINED_SQL.replace("FROM long", f"FROM long WHERE start_ts < TIMESTAMP '{AHEAD}'")},
ahead AS (SELECT * FROM contests WHERE start_ts >= TIMESTAMP '{AHEAD}'), probes AS (SELECT match_id AS pm, start_ts AS moment, unnest([team1, team2]) AS team FROM ahead), {_WEIGHED_SQL.format(h=90)}, {_SIDES_SQL},
{_AHEAD_SQL}, ms AS (SELECT match_id, map_name, max(CASE WHEN k = 32 THEN oa - ob END) AS elo, max(CASE WHEN k = 32 THEN ea - eb END) AS lean, max(CASE WHEN k = 64 THEN 1 / (1 + pow(10.0::DOUBLE, (eb - ea) / 400)) END) AS pe FROM stood GROUP BY ALL),
called AS (SELECT c.match_id, best_of, least(a.n, b.n) < 3 AS low_history, ms.map_name, lean, pe, 1 / (1 + exp(-(0.004 * elo + 0.003 * lean + 2.0 * (a.round_share - b.round_share) - 0.5 * coalesce(a.core_absent - b.core_absent, 0) + 0.2 * (a.coplay - b.coplay) + 0.01 * ln(1 + least(a.n, b.n)::DOUBLE) + 0.1 * CAST(ms.map_name = 'click' AS INT)))) AS p
  FROM ahead c JOIN sided a ON a.pm = c.match_id AND a.team = c.team1 JOIN sided b ON b.pm = c.match_id AND b.team = c.team2 JOIN ms USING (match_id)),
whole AS (SELECT match_id, best_of, low_history, avg(p) AS p, avg(pe) AS e, max(p) FILTER (map_name = 'click') AS pc, max(p) FILTER (map_name = 'view') AS pv, max(lean) FILTER (map_name = 'click') AS lean FROM called GROUP BY ALL)
SELECT match_id, low_history, {_PUB("p")} AS p_map, {_PUB(_BEST("p"))} AS p_series, {_PUB(_BEST("e"))} AS p_elo, {_PUB("pc")} AS p_click, {_PUB("pv")} AS p_view, floor(lean * 10 + 0.5) / 10 AS elo_click FROM whole""",
    "chrono_split": f"{with_views('contests')}, r AS (SELECT match_id, row_number() OVER (ORDER BY start_ts, match_id) AS i, count(*) OVER () AS n FROM contests) SELECT match_id, CASE WHEN i <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS part FROM r",
    "folds": f"{with_views('contests')}, r AS (SELECT match_id, row_number() OVER (ORDER BY start_ts, match_id) AS i, count(*) OVER () AS n FROM contests) SELECT match_id, " + " + ".join(f"CAST(i > round_even(n * {0.5 + 0.5 * k / 5}::DOUBLE, 0) AS INT)" for k in range(5)) + " AS fold FROM r",
    "augment": f"{with_views('contests')} SELECT match_id, team1_score - team2_score AS score_diff, CAST(team1_score > team2_score AS INT) AS y, best_of FROM contests UNION ALL SELECT match_id, team2_score - team1_score, 1 - CAST(team1_score > team2_score AS INT), best_of FROM contests",
    "periods": "SELECT year(o_orderdate) || 'H' || CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS period, count(*) AS n FROM orders GROUP BY 1",
    "tz_shift": "SELECT o_orderkey, timezone('UTC', timezone('America/New_York', o_orderdate)) AS utc FROM orders",
    "phase_peak": "WITH p AS (SELECT event_id AS phase_id, ts AS b, ts + INTERVAL 2 HOUR AS e FROM events) SELECT phase_id, max(value) AS peak, count(*) AS n FROM p JOIN events ON ts >= b AND ts <= e GROUP BY 1",
    "corr_topk": f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT 'x' || p.i AS a, 'x' || q.i AS b, corr(p.x, q.x) AS r FROM e p JOIN e q ON p.vec_id = q.vec_id AND p.i < q.i GROUP BY p.i, q.i)
SELECT a, b, {_R4("abs(r)")} AS r FROM c ORDER BY abs(c.r) DESC, a, b LIMIT 10""",
}
