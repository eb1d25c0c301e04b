"""Nested match documents to long fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import team_key, tournament
from tidemark.functions.time import estimated_end

PISTOL_ROUNDS = (1, 13)
METHODS = ("elim", "boom", "defuse", "time")


def long_frame(contests: DataFrame) -> DataFrame:
    """Two mirrored rows per decided contest of flat records (team1, team2, team1_score, team2_score, ...)."""
    decided = contests.where("team1_score <> team2_score")
    side = lambda me, you, first: F.struct(
        F.col(f"team{me}").alias("team"), F.col(f"team{you}").alias("opp"), F.lit(first).alias("is_team1"),
        (F.col(f"team{me}_score") > F.col(f"team{you}_score")).cast("int").alias("won"),
        F.col(f"team{me}_score").alias("rounds_won"), F.col(f"team{you}_score").alias("rounds_lost"))
    kept = [c for c in decided.columns if c not in ("team1", "team2", "team1_score", "team2_score")]
    return decided.select(*kept, F.explode(F.array(side(1, 2, True), side(2, 1, False))).alias("s")).select(*kept, "s.*")


def _all_or_nothing(xs: Column, field: str) -> Column:
    """The sum of a field, null unless every element has it (and there is one)."""
    known = (F.size(xs) > 0) & F.forall(xs, lambda p: p[field].isNotNull())
    return F.when(known, F.aggregate(xs, F.lit(0), lambda s, p: s + p[field]))


def _zero_for_missing(xs: Column, field: str) -> Column:
    return F.aggregate(xs, F.lit(0), lambda s, p: s + F.coalesce(p[field], F.lit(0)))


def maps_frame(matches: DataFrame) -> DataFrame:
    """Two rows per decided map of completed nested match documents (schema ``schemas.MATCH``).

    Own attack losses are the other side's defence wins, so the split columns swap for the second side.
    """
    played = matches.where("status = 'completed'").select("*", F.explode("maps").alias("mp")).where("mp.team1_score <> mp.team2_score")

    def side(me: int, you: int) -> Column:
        own, other = f"team{me}", f"team{you}"
        mp = F.col("mp")
        players = F.coalesce(mp[f"{own}_players"], F.array().cast("array<struct<name:string,agent:string,kills:int,fk:int,fd:int,multikills:int,clutches:int>>"))
        pistols = F.filter(F.coalesce(mp["rounds"], F.array().cast("array<struct<number:int,winner:string,win_method:string>>")), lambda r: r["number"].isin(*PISTOL_ROUNDS) & (r["winner"] != ""))
        econ = mp[f"{own}_econ"]
        return F.struct(
            team_key(f"{own}_id", f"{own}_name").alias("team"), F.col(f"{own}_name").alias("team_name"),
            team_key(f"{other}_id", f"{other}_name").alias("opp"), F.col(f"{other}_name").alias("opp_name"),
            F.lit(me == 1).alias("is_team1"), (mp[f"{own}_score"] > mp[f"{other}_score"]).cast("int").alias("won"),
            mp[f"{own}_score"].alias("rounds_won"), mp[f"{other}_score"].alias("rounds_lost"),
            mp[f"{own}_attack"].alias("atk_rw"), mp[f"{other}_defence"].alias("atk_rl"),
            mp[f"{own}_defence"].alias("def_rw"), mp[f"{other}_attack"].alias("def_rl"),
            F.when(F.size(players) > 0, _zero_for_missing(players, "fk")).alias("fk"),
            F.when(F.size(players) > 0, _zero_for_missing(players, "fd")).alias("fd"),
            F.size(F.filter(pistols, lambda r: r["winner"] == own)).alias("pistols_won"), F.size(pistols).alias("pistols_played"),
            F.array_sort(F.transform(players, lambda p: F.lower(p["name"]))).alias("lineup"),
            _all_or_nothing(players, "multikills").alias("multikills"), _all_or_nothing(players, "clutches").alias("clutch_wins"),
            econ["fullbuy"]["n"].alias("fullbuy_n"), econ["fullbuy"]["won"].alias("fullbuy_w"),
            econ["lowbuy"]["n"].alias("lowbuy_n"), econ["lowbuy"]["won"].alias("lowbuy_w"),
        )

    rows = played.select("match_id", "start_ts", "best_of", "event", "series", F.col("mp.map_name").alias("map_name"), F.col("mp.index").alias("map_index"), F.explode(F.array(side(1, 2), side(2, 1))).alias("s"))
    return rows.select("*", "s.*").drop("s").withColumn("end_ts", estimated_end("start_ts", "best_of"))


def matches_frame(matches: DataFrame) -> DataFrame:
    """One row per completed match with a winner."""
    kept = matches.where("status = 'completed' AND winner IN ('team1', 'team2')")
    return kept.select("match_id", "start_ts", "best_of", "event", "series", team_key("team1_id", "team1_name").alias("team1"), team_key("team2_id", "team2_name").alias("team2"), (F.col("winner") == "team1").cast("int").alias("team1_won"), maps_played().alias("maps_played"))


def maps_played() -> Column:
    """The series score if there is one, else the number of maps, else null."""
    return F.coalesce(F.col("team1_series_score") + F.col("team2_series_score"), F.when(F.size("maps") > 0, F.size("maps")))


def match_lite(rows: DataFrame) -> DataFrame:
    """Per match its sides and the ordered (index, map, won) of the first side."""
    first = rows.where("is_team1")
    return first.groupBy("match_id").agg(
        F.first("start_ts").alias("start_ts"), F.first("end_ts").alias("end_ts"), F.first("team").alias("a"), F.first("opp").alias("b"),
        F.sort_array(F.collect_list(F.struct("map_index", "map_name", "won"))).alias("maps"))


def match_table(rows: DataFrame) -> DataFrame:
    """Per match: games, games won by the first side, and who won by majority (null if nobody)."""
    out = rows.where("is_team1").groupBy("match_id").agg(F.count("*").alias("n_maps"), F.sum("won").alias("n_won"), F.min("start_ts").alias("start_ts"), F.max("best_of").alias("best_of"))
    need = F.floor(F.col("best_of") / 2) + 1
    decided = F.when(F.col("n_won") >= need, 1).when(F.col("n_maps") - F.col("n_won") >= need, 0)
    return out.withColumn("team1_won", decided)


def trends_facts(matches: DataFrame) -> DataFrame:
    """(team, map) rows of completed matches, drawn maps included; a side without an id is skipped."""
    played = matches.where("status = 'completed'").select("*", F.explode("maps").alias("mp"))

    def side(me: int, you: int) -> Column:
        own, other = f"team{me}", f"team{you}"
        mp = F.col("mp")
        rounds = F.coalesce(mp["rounds"], F.array().cast("array<struct<number:int,winner:string,win_method:string>>"))
        mine = F.coalesce(mp[f"{own}_players"], F.array().cast("array<struct<name:string,agent:string,kills:int,fk:int,fd:int,multikills:int,clutches:int>>"))
        theirs = F.coalesce(mp[f"{other}_players"], F.array().cast("array<struct<name:string,agent:string,kills:int,fk:int,fd:int,multikills:int,clutches:int>>"))
        pistols = F.filter(rounds, lambda r: r["number"].isin(*PISTOL_ROUNDS) & (r["winner"] != ""))
        won_by = lambda m: F.size(F.filter(rounds, lambda r: (r["winner"] == own) & (r["win_method"] == m)))
        known = (F.size(mine) > 0) & F.forall(mine, lambda p: p["fk"].isNotNull() & p["fd"].isNotNull())
        return F.struct(
            F.nullif(F.col(f"{own}_id"), F.lit("")).alias("team"), F.col(f"{own}_name").alias("name"),
            (mp[f"{own}_score"] > mp[f"{other}_score"]).cast("int").alias("won"), (mp[f"{own}_score"] - mp[f"{other}_score"]).alias("spread"),
            (mp[f"{own}_score"] + mp[f"{other}_score"]).alias("rounds"),
            F.size(pistols).alias("pistols_played"), F.size(F.filter(pistols, lambda r: r["winner"] == own)).alias("pistols_won"),
            _all_or_nothing(F.concat(mine, theirs), "kills").alias("kills"),
            F.when(known, _zero_for_missing(mine, "fk")).alias("fk"), F.when(known, _zero_for_missing(mine, "fd")).alias("fd"),
            F.array(*map(won_by, METHODS)).alias("methods"), F.filter(F.transform(mine, lambda p: p["agent"]), lambda a: a.isNotNull() & (a != "")).alias("agents"),
        )

    rows = played.select("match_id", "start_ts", tournament("event").alias("event"), F.col("mp.index").alias("map_index"), F.explode(F.array(side(1, 2), side(2, 1))).alias("s"))
    return rows.select("match_id", "start_ts", "event", "map_index", "s.*").where("team IS NOT NULL")


def tournament_index(matches: DataFrame) -> DataFrame:
    """Tournaments by first appearance, with their number of matches and dates."""
    used = matches.where("status = 'completed' AND size(maps) > 0").select(tournament("event").alias("name"), "start_ts", "match_id")
    found = used.groupBy("name").agg(F.count("*").alias("n_matches"), F.min("start_ts").alias("first"), F.max("start_ts").alias("last"), F.min(F.struct("start_ts", "match_id")).alias("at"))
    # one row per tournament: small, whatever the number of matches
    return found.select((F.expr("row_number() over (order by at, name)") - 1).alias("id"), "name", "n_matches", "first", "last")
