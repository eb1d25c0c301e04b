"""Reading records that enter from outside: JSON lines, raw response archives, alias files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.text import normalize_name
from tidemark.functions.time import estimated_end, zone_to_utc
from tidemark.sources.store import exists


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Match documents, one per line (gzip by extension); a bad line fails the read, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.MATCH)
    return spark.read.schema(schemas.MATCH).option("mode", "FAILFAST").json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count() if exists(spark, path) else 0


def first_matches(matches: DataFrame, n: int) -> DataFrame:
    return matches.orderBy("start_ts", "match_id").limit(n)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.CAPTURE)
    return spark.read.schema(schemas.CAPTURE).json(path)


def archive(raw: DataFrame, path: str) -> None:
    """Append raw responses by source and UTC day."""
    raw.withColumn("day", F.to_date("fetched_at")).write.mode("append").partitionBy("source", "day").json(path)


def replay(spark: SparkSession, path: str, source: str, url_part: str = "") -> DataFrame:
    """Archived bodies that parse, of one source, status 200 and matching urls, in the order they came."""
    raw = spark.read.schema(schemas.RAW + ", day date").json(path).where((F.col("source") == source) & (F.col("status") == 200))
    raw = raw.where(F.col("url").contains(url_part)) if url_part else raw
    return raw.withColumn("json", F.try_parse_json("body")).where("json IS NOT NULL").orderBy("fetched_at", "url")


def inventory(captures: DataFrame) -> DataFrame:
    """Per source and match: rows by kind, first and last."""
    return captures.groupBy("source", "match_id").pivot("capture_kind", ["freeze", "close"]).agg(F.count("*").alias("n")).na.fill(0)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """A flat JSON object of name to name, both normalised."""
    if not exists(spark, path):
        return spark.createDataFrame([], "alias string, canonical string")
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")))
    return pairs.select(normalize_name("key").alias("alias"), normalize_name("value").alias("canonical"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    row = "struct<match_id:string,team1_name:string,team2_name:string,start_ts:timestamp>"
    return spark.read.schema(f"predictions array<{row}>").option("multiLine", "true").json(path).select(F.posexplode("predictions").alias("position", "p")).select("position", "p.*")


def shifted_times(rows: DataFrame, column: str = "start_ts", zone: str = "America/New_York") -> DataFrame:
    """A new version of a table whose wall-clock times become UTC."""
    return rows.withColumn(column, zone_to_utc(column, zone))


def stale(matches: DataFrame, now: Column, slack_hours: float = 2.0, lookback_days: int = 14) -> DataFrame:
    """Not completed although their end has passed, within the look-back."""
    end = estimated_end("start_ts", "best_of") + F.make_dt_interval(mins=F.lit(int(slack_hours * 60)))
    return matches.where((F.col("status") != "completed") & (end < now) & (F.col("start_ts") >= now - F.make_dt_interval(days=F.lit(lookback_days))))


def recent(rows: DataFrame, now: Column, hours: int = 24, column: str = "captured_at") -> DataFrame:
    return rows.where(F.col(column) >= now - F.make_dt_interval(hours=F.lit(hours)))


def before(rows: DataFrame, moment: Column, column: str = "captured_at") -> DataFrame:
    return rows.where(F.col(column) < moment)


def synthetic_contests(spark: SparkSession, n: int, teams: int = 12, seed: int = 7) -> DataFrame:
    """Repeatable contests for tests: sides, scores and times follow from the row number by hash."""
    h = lambda k: F.pmod(F.xxhash64("match_id", F.lit(seed), F.lit(k)), F.lit(1_000_003))
    rows = spark.range(n).withColumnRenamed("id", "match_id")
    one = F.pmod(h(1), F.lit(teams))
    return rows.select("match_id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("match_id") * 3).cast("int"))).alias("start_ts"), F.element_at(F.array(F.lit(1), F.lit(3), F.lit(5)), (h(2) % 3 + 1).cast("int")).alias("best_of"), F.concat(F.lit("map"), (h(3) % 5).cast("string")).alias("map_name"), one.alias("team1"), F.pmod(one + 1 + h(4) % (teams - 1), F.lit(teams)).alias("team2"), (h(5) % 14).cast("int").alias("team1_score"), (h(6) % 14).cast("int").alias("team2_score"))
