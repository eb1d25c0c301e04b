"""Which maps are being played now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import decay
from tidemark.functions.time import days_between


def pool_table(plays: DataFrame, now: Column, window_days: int = 60, half_life: float | None = 14.0) -> DataFrame:
    """Per map: plays, plays decayed by age, and the last start, over finished plays of the window.

    ``plays`` is a long frame; each play counts once. If nothing finished started inside the window, the whole
    history counts instead.
    """
    done = plays.where(F.col("is_team1") & (F.col("end_ts") <= now)).withColumn("_in", F.col("start_ts") >= now - F.make_dt_interval(days=F.lit(window_days)))
    weight = decay(days_between(now, F.col("start_ts")), half_life) if half_life and half_life > 0 else F.lit(1.0)

    def part(only: Column | None) -> list[Column]:
        keep = (lambda x: F.when(only, x)) if only is not None else (lambda x: x)
        return [F.count(keep(F.lit(1))).alias("plays"), F.sum(keep(weight)).alias("weighted"), F.max(keep(F.col("start_ts"))).alias("last_played")]

    per_map = done.groupBy("map_name").agg(F.struct(*part(F.col("_in"))).alias("recent"), F.struct(*part(None)).alias("every"))
    # one row per map from here on
    any_recent = F.max(F.expr("recent.plays")).over(Window.partitionBy(F.lit(0))) > 0
    chosen = per_map.select("map_name", F.when(any_recent, F.col("recent")).otherwise(F.col("every")).alias("c"))
    return chosen.select("map_name", "c.*").where("plays > 0")


def current_pool(plays: DataFrame, now: Column, size: int = 7, window_days: int = 60, half_life: float | None = 14.0) -> DataFrame:
    """The ``size`` maps with most weight, ties in order of name."""
    return pool_table(plays, now, window_days, half_life).orderBy(F.desc("weighted"), "map_name").limit(size)
