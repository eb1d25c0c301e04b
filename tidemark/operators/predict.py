"""Predictions of contests to come from a trained model: by map, for the series, and for its length."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.functions.stats import expected_score, published, rounded
from tidemark.operators import features, models
from tidemark.operators import ratings as ratings_
from tidemark.operators.ratings import DEFAULT_K, SNAPSHOT, STRETCH
from tidemark.tables import written


def looks_ahead(games: DataFrame, upcoming: DataFrame, pool: Sequence[str], *ks: float) -> DataFrame:
    """Both sides' ratings before each of ``upcoming``, overall and on every map of ``pool``, from ``games`` (as
    ``ratings.rating_log`` takes them): contests to come join the replay as looks that play nothing. One
    replay serves all of ``ks`` (by default the usual one)."""
    columns = ["match_id", "start_ts", "end_ts", "team1", "team2", "maps"]
    played = games.select(*columns, F.array().cast("array<string>").alias("extra_maps"), F.lit(False).alias("ahead"))
    kind = games.schema["maps"].dataType
    ahead = upcoming.select("match_id", "start_ts", F.col("start_ts").alias("end_ts"), "team1", "team2", F.array().cast(kind).alias("maps"), F.array(*map(F.lit, pool)).cast("array<string>").alias("extra_maps"), F.lit(True).alias("ahead"))
    looks = ratings_.prematch(ratings_.rating_log(played.unionByName(ahead), ks or (DEFAULT_K,), STRETCH, (SNAPSHOT,)))
    return looks.join(upcoming.select("match_id", F.col("team1").cast("long").alias("team")), ["match_id", "team"], "left_semi")


def series_chance(p: Column, best_of: Column | str) -> Column:
    games = F.transform(F.sequence(F.lit(1), F.col(best_of).cast("int")), lambda i: p + 0.0 * i)
    return series.series_prob(games)


def predict(trained: models.Trained | Callable[[DataFrame], DataFrame], facts: DataFrame, upcoming: DataFrame, pool: Sequence[str], ratings: DataFrame | None = None, maps: Sequence[str] = (), half_life: float = 90.0, games: DataFrame | None = None, elo_k: float = DEFAULT_K, baseline_k: float = DEFAULT_K, roster_factor: float = features.ROSTER_FACTOR) -> DataFrame:
    """One row per playable contest of ``upcoming`` (match_id, start_ts, team1, team2, team1_name, team2_name, best_of).

    Each contest is scored on every map of ``pool`` (a handful of names); the maps of a series are not known yet, so
    each of its games counts with the mean over the pool. Features that are unknown count as no difference. ``trained``
    may be a function that adds the column p. With ``games`` (their history) ratings come from the replay up to each
    contest: ``elo_k`` for features, ``baseline_k`` for p_elo, the series chance by ratings alone on the maps of the pool.
    Returns p_map, p_series, p_elo and elo_by_map (null without ``games``), p_by_map, p_maps_dist, and the prior maps and
    low-history mark of the feature row.
    """
    asked = features.playable(upcoming)
    looks = written(looks_ahead(games, asked, pool, *sorted({elo_k, baseline_k}))) if games is not None else None
    ahead, base = (looks.where(F.col("k") == float(k)) if looks is not None else None for k in (elo_k, baseline_k))
    rows = features.feature_rows(facts, asked, ahead.drop("maps") if ahead is not None else ratings, (), half_life, roster_factor)
    spread = rows.withColumn("map_name", F.explode(F.array(*map(F.lit, pool))))
    if ahead is not None:
        rated = lambda df, name: df.select("match_id", F.col("maps").alias(name))
        spread = spread.join(rated(ahead, "_ahead"), "match_id", "left").join(rated(base, "_base"), "match_id", "left")
        on = F.get(F.filter("_base", lambda m: m["map_name"] == F.col("map_name")), F.lit(0))
        spread = spread.withColumns({"map_elo_diff": features.map_lean(F.col("_ahead"), "map_name"), "_elo": expected_score(on["rating"], on["opp_rating"])})
    else:
        spread = spread.withColumn("_elo", F.lit(None).cast("double"))
    spread = spread.na.fill(0.0, features.names_of(spread)[1]).withColumns({f"map_{m}": (F.col("map_name") == m).cast("int") for m in maps})
    scored = trained(spread) if callable(trained) else models.calibrated(trained, spread)
    of_maps = lambda value: F.map_from_entries(F.sort_array(F.collect_list(F.struct("map_name", value.alias("v")))))
    lean = rounded(F.col("map_elo_diff"), 1) if ahead is not None else F.lit(None).cast("double")
    keep = ["match_id", "start_ts", "team1", "team2", "best_of", "a_n_maps", "b_n_maps", "low_history"]
    whole = scored.groupBy(*keep).agg(F.avg("p").alias("p"), F.avg("_elo").alias("e"), of_maps(published(F.col("p"))).alias("p_by_map"), of_maps(lean).alias("elo_by_map"))
    told = whole.withColumns({"p_series": published(series_chance(F.col("p"), "best_of")), "p_elo": F.when(F.col("e").isNotNull(), published(series_chance(F.col("e"), "best_of")))})
    games_ = F.transform(F.sequence(F.lit(1), F.col("best_of").cast("int")), lambda i: F.col("p") + 0.0 * i)
    told = told.withColumn("p_maps_dist", series.length_distribution(games_)).withColumn("p_map", published(F.col("p")))
    return told.select(*keep, "p_map", "p_series", "p_elo", "p_by_map", "elo_by_map", "p_maps_dist")


def with_fallbacks(predictions: DataFrame, ledger: DataFrame, previous: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of each prediction: the ledger's first written value, else the previous run's, else the new one."""
    held = ledger.select("match_id", *(F.col(c).alias(f"held_{c}") for c in columns))
    before = previous.select("match_id", *(F.col(c).alias(f"before_{c}") for c in columns))
    joined = predictions.join(held, "match_id", "left").join(before, "match_id", "left")
    return joined.select(*(F.coalesce(f"held_{c}", f"before_{c}", c).alias(c) if c in columns else F.col(c) for c in predictions.columns))
