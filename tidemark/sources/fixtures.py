"""Views of the fixture tables in the shapes that the operators take, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import estimated_end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contest, from pairs of consecutive events of two users."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    a = events.where("event_id % 2 = 0").alias("a")
    b = events.where("event_id % 2 = 1").withColumn("event_id", F.col("event_id") - 1).alias("b")
    return a.join(b, "event_id").where("a.user_id <> b.user_id").select(
        F.col("event_id").alias("match_id"),
        F.col("a.ts").alias("start_ts"),
        F.expr("CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END").alias("best_of"),
        F.col("a.event_type").alias("map_name"),
        F.col("b.event_type").alias("series"),
        F.col("a.user_id").alias("team1"),
        F.col("b.user_id").alias("team2"),
        F.expr("CAST(floor(a.value) AS INT) % 14").alias("team1_score"),
        F.expr("CAST(floor(b.value) AS INT) % 14").alias("team2_score"),
    )


def ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contests(spark, sf_dir).withColumn("end_ts", estimated_end("start_ts", "best_of"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_id"),
        F.col("o_orderdate").alias("start_ts"),
        F.expr("o_orderdate - INTERVAL 1 DAY").alias("made_at"),
        F.col("o_orderpriority").alias("event"),
        F.expr("(o_custkey % 97 + 1) / 98.0D").alias("p_model"),
        F.expr("(o_custkey * 7 % 89 + 1) / 90.0D").alias("p_elo"),
        F.expr("o_orderstatus <> 'P'").alias("graded"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END").alias("team1_won"),
        F.expr("o_orderpriority = '5-LOW'").alias("low_history"),
        F.expr("CAST(2 + o_orderkey % 2 AS INT)").alias("maps_played"),
    )


def place(rows: DataFrame) -> Column:
    """Where a row stands in the files that ``rows`` are read from: by name of file, then by row."""
    files = sorted({f.rstrip("/").rsplit("/", 1)[-1] for f in rows.inputFiles()})
    row = F.col("_metadata.row_index")
    return row if len(files) < 2 else F.array_position(F.array(*map(F.lit, files)), F.element_at(F.split("_metadata.file_path", "/"), -1)) * F.lit(1 << 40) + row


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        place(rows).alias("place"),
        F.col("l_orderkey").alias("match_id"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_shipdate").alias("captured_at"),
        F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'pinnacle' WHEN 1 THEN 'cloudbet' ELSE 'other' END").alias("source"),
        F.expr("CASE WHEN l_returnflag = 'N' THEN 'close' ELSE 'freeze' END").alias("capture_kind"),
        F.expr("CASE WHEN l_partkey % 4 = 0 THEN 'maps_total' ELSE 'series_moneyline' END").alias("market"),
        F.expr("CASE WHEN l_partkey % 4 = 0 THEN 2.5D END").alias("line"),
        F.expr("CASE WHEN l_linenumber % 6 = 0 THEN 0.0D ELSE 1.0D + l_quantity / 25.0D END").alias("price_home"),
        F.expr("1.0D + (51.0D - l_quantity) / 25.0D").alias("price_away"),
        F.expr("CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END").alias("book_home_is_team1"),
    )


#: Common table expressions with the same rows, for DuckDB.
SQL = {
    "contests": """contests AS (
  SELECT a.event_id AS match_id, a.ts AS start_ts, CASE a.event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS best_of,
         a.event_type AS map_name, b.event_type AS series, a.user_id AS team1, b.user_id AS team2,
         CAST(floor(a.value) AS INT) % 14 AS team1_score, CAST(floor(b.value) AS INT) % 14 AS team2_score,
         a.ts + CASE a.event_id % 3 WHEN 0 THEN INTERVAL 90 MINUTE WHEN 1 THEN INTERVAL 3 HOUR ELSE INTERVAL 5 HOUR END AS end_ts
  FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0 AND a.user_id <> b.user_id
)""",
    "sides": """sides AS (
  SELECT match_id, start_ts, end_ts, best_of, map_name, series, team1 AS team, team2 AS opp, TRUE AS is_team1, team1_score AS own, team2_score AS other FROM contests
  UNION ALL SELECT match_id, start_ts, end_ts, best_of, map_name, series, team2, team1, FALSE, team2_score, team1_score FROM contests
)""",
    "long": """long AS (
  SELECT match_id, start_ts, end_ts, best_of, map_name, series, team, opp, is_team1, CAST(own > other AS INT) AS won, own AS rounds_won, other AS rounds_lost,
         CASE WHEN match_id % 7 <> 0 THEN own END AS metric FROM sides WHERE own <> other
)""",
    "ledger": """ledger AS (
  SELECT o_orderkey AS match_id, o_orderdate AS start_ts, o_orderdate - INTERVAL 1 DAY AS made_at, o_orderpriority AS event,
         (o_custkey % 97 + 1) / 98.0::DOUBLE AS p_model, (o_custkey * 7 % 89 + 1) / 90.0::DOUBLE AS p_elo, o_orderstatus <> 'P' AS graded,
         CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS team1_won,
         o_orderpriority = '5-LOW' AS low_history, 2 + o_orderkey % 2 AS maps_played FROM orders
)""",
    "captures": """captures AS (
  SELECT l_orderkey AS match_id, l_linenumber AS seq, l_shipdate AS captured_at,
         CASE l_suppkey % 3 WHEN 0 THEN 'pinnacle' WHEN 1 THEN 'cloudbet' ELSE 'other' END AS source,
         CASE WHEN l_returnflag = 'N' THEN 'close' ELSE 'freeze' END AS capture_kind,
         CASE WHEN l_partkey % 4 = 0 THEN 'maps_total' ELSE 'series_moneyline' END AS market,
         CASE WHEN l_partkey % 4 = 0 THEN 2.5::DOUBLE END AS line,
         CASE WHEN l_linenumber % 6 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE + l_quantity / 25.0::DOUBLE END AS price_home,
         1.0::DOUBLE + (51.0::DOUBLE - l_quantity) / 25.0::DOUBLE AS price_away,
         CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS book_home_is_team1 FROM lineitem
)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause of the named views and of those they need."""
    needs = {"sides": ("contests",), "long": ("contests", "sides")}
    order: list[str] = []
    for n in names:
        order += [x for x in (*needs.get(n, ()), n) if x not in order]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in order)
