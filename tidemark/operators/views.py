"""Orders and set views that users see. Each names all of its tie-breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_line(picks: DataFrame) -> DataFrame:
    """Picks of a contest in order of market and line; the one without a line comes first."""
    return picks.orderBy("match_id", "market", F.asc_nulls_first("line"))


def by_start(rows: DataFrame, newest_first: bool = False) -> DataFrame:
    """Rows in order of start, those without one last in either direction."""
    return rows.orderBy(F.desc_nulls_last("start_ts") if newest_first else F.asc_nulls_last("start_ts"), "match_id")


def schedule(upcoming: DataFrame, results: DataFrame) -> DataFrame:
    """What is to come, soonest first, then what is over, newest first, in one order: ``section`` and ``position``.

    ``position`` sorts within a section; rows without a start are last in theirs.
    """
    at = F.unix_micros(F.col("start_ts").cast("timestamp"))
    ahead = upcoming.withColumn("section", F.lit(0)).withColumn("position", at)
    over = results.withColumn("section", F.lit(1)).withColumn("position", -at)
    return ahead.unionByName(over, allowMissingColumns=True).orderBy("section", F.asc_nulls_last("position"), "match_id")


def pool_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Maps that joined or dropped out between two pools (map_name)."""
    joined = after.select("map_name").exceptAll(before.select("map_name")).withColumn("change", F.lit("joined"))
    return joined.unionByName(before.select("map_name").exceptAll(after.select("map_name")).withColumn("change", F.lit("dropped")))
