"""Prices out of nested feed bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.odds import price_to_decimal

SELECTION = "struct<outcome:string,params:string,price:double,status:string>"
EVENT = f"struct<id:string,home:struct<name:string>,away:struct<name:string>,cutoffTime:timestamp,markets:map<string,struct<submarkets:map<string,struct<selections:array<{SELECTION}>>>>>>"
#: Market keys that hold a winner, and submarkets that are not whole-match totals.
WINNER_HINTS = "winner|moneyline|match_odds"
NOT_TOTALS = "(?i)round|kill|map_?[0-9]|player|team_total"
LARGEST_LINE = 4.5


def feed_events(bodies: DataFrame) -> DataFrame:
    """One row per event of bodies (captured_at, source, body) that hold {"events": [...]}."""
    return bodies.select("captured_at", "source", F.explode(F.from_json("body", f"events array<{EVENT}>").getField("events")).alias("e"))


def _selections(events: DataFrame) -> DataFrame:
    markets = events.select("captured_at", "source", F.col("e.id").alias("book_event_id"), F.col("e.home.name").alias("book_home"), F.col("e.away.name").alias("book_away"), F.col("e.cutoffTime").alias("book_start_ts"), F.explode("e.markets").alias("market_key", "m"))
    subs = markets.select("*", F.explode("m.submarkets").alias("sub_key", "s")).drop("m")
    return subs.select("*", F.explode("s.selections").alias("x")).drop("s")


KEYS = ("captured_at", "source", "book_event_id", "book_home", "book_away", "book_start_ts")


def winner_prices(events: DataFrame) -> DataFrame:
    """The first winner market, by key, that has exactly a home and an away price."""
    rows = _selections(events).where(F.col("market_key").rlike(WINNER_HINTS))
    sides = rows.groupBy(*KEYS, "market_key", "sub_key").agg(F.count("*").alias("n"), F.max(F.when(F.col("x.outcome") == "home", F.col("x.price"))).alias("price_home"), F.max(F.when(F.col("x.outcome") == "away", F.col("x.price"))).alias("price_away"))
    whole = sides.where("n = 2 AND price_home IS NOT NULL AND price_away IS NOT NULL")
    best = whole.groupBy(*KEYS).agg(F.min_by(F.struct("price_home", "price_away"), F.struct("market_key", "sub_key")).alias("b"))
    return best.select(*KEYS, F.lit("series_moneyline").alias("market"), F.lit(None).cast("double").alias("line"), "b.*")


def total_prices(events: DataFrame) -> DataFrame:
    """Over and under prices of whole-match totals with a line of 4.5 at most, both sides priced."""
    rows = _selections(events).where(F.col("market_key").contains("total") & ~F.col("market_key").rlike(NOT_TOTALS) & ~F.col("sub_key").rlike(NOT_TOTALS))
    lined = rows.withColumn("line", F.regexp_extract(F.coalesce("x.params", F.lit("")), r"total=([0-9.]+)", 1).try_cast("double")).where(F.col("line") <= LARGEST_LINE)
    sides = lined.groupBy(*KEYS, "line").agg(F.max(F.when(F.col("x.outcome") == "over", F.col("x.price"))).alias("price_home"), F.max(F.when(F.col("x.outcome") == "under", F.col("x.price"))).alias("price_away"))
    return sides.where("price_home IS NOT NULL AND price_away IS NOT NULL").select(*KEYS, F.lit("maps_total").alias("market"), "line", "price_home", "price_away")


def feed_captures(bodies: DataFrame) -> DataFrame:
    events = feed_events(bodies)
    return winner_prices(events).unionByName(total_prices(events))


def intercepted(bodies: DataFrame) -> DataFrame:
    """Match-ups joined with prices from bodies of either shape: lists of {id, participants} or of {matchupId, prices}.

    Of several bodies about one match-up the last counts.
    """
    part = "array<struct<name:string,alignment:string>>"
    shape = f"array<struct<id:long,startTime:timestamp,participants:{part},matchupId:long,type:string,period:int,prices:array<struct<designation:string,price:double>>>>"
    rows = bodies.select("position", "captured_at", F.explode(F.from_json("body", shape)).alias("r"))
    name = lambda side: F.get(F.filter("r.participants", lambda p: p["alignment"] == side), F.lit(0))["name"]
    fixtures = rows.where("r.participants IS NOT NULL").groupBy(F.col("r.id").alias("id")).agg(F.max_by(F.struct(name("home").alias("book_home"), name("away").alias("book_away"), F.col("r.startTime").alias("book_start_ts")), "position").alias("f"))
    price = lambda side: price_to_decimal(F.get(F.filter("r.prices", lambda p: p["designation"] == side), F.lit(0))["price"])
    prices = rows.where("r.matchupId IS NOT NULL AND r.type = 'moneyline' AND r.period = 0").groupBy(F.col("r.matchupId").alias("id")).agg(F.max_by(F.struct("captured_at", price("home").alias("price_home"), price("away").alias("price_away")), "position").alias("p"))
    return fixtures.join(prices, "id").select(F.col("id").cast("string").alias("book_event_id"), "f.*", "p.*")
