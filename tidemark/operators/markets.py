"""Prices against predictions: entry and close, picks, aggregates, stakes.

Sides are canonical: 0 is the first team or over, 1 the second team or under. Every price row is read through
its own orientation. Rows that cannot be used are counted, never dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import odds
from tidemark.functions.stats import BUCKET_HIGH, BUCKET_LOW

MONEYLINE, TOTALS = "series_moneyline", "maps_total"
#: Books by priority; others follow by name.
PRIORITY = ("pinnacle", "cloudbet")
GROUP = ("match_id", "market", "line")
#: Captures that a task groups at a time.
TASK_ROWS = 100_000


def usable(captures: DataFrame) -> DataFrame:
    return captures.withColumn("priceable", odds.priceable(F.col("price_home"), F.col("price_away"))).withColumn("orientable", (F.col("market") != MONEYLINE) | F.col("book_home_is_team1").isNotNull())


def side_price(c: Column, side: int, market: Column) -> Column:
    """The price of a canonical side in a capture; null if a moneyline has no orientation."""
    home_first = F.when(market != MONEYLINE, True).otherwise(c["book_home_is_team1"])
    first, second = c["price_home"], c["price_away"]
    return F.when(home_first, first if side == 0 else second).when(~home_first, second if side == 0 else first)


def by_match(captures: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``captures`` dealt by match to as many tasks as give each ``rows`` of them on average, whatever the input: what is
    sorted and grouped by match, or by more than that, needs no other shuffle and no larger task."""
    return captures.repartition(max(captures.sparkSession.sparkContext.defaultParallelism, -(-captures.count() // rows)), "match_id")


def entry_close(captures: DataFrame) -> DataFrame:
    """Per (match, market, line, source): entry, close, and how many rows could not be oriented.

    Entry is the earliest oriented freeze, else the earliest oriented capture; close is the latest close. Ties
    in time are broken by ``seq``, then by the prices; of rows equal in all of that the one first in the log is taken, if
    the captures tell their ``place`` in it.
    """
    order, placed = ("captured_at", "seq", "price_home", "price_away"), "place" in captures.columns
    at = F.struct(*order, *(["place"] if placed else []))
    late = F.struct(*order, *([-F.col("place")] if placed else []))
    row = F.struct("captured_at", "capture_kind", "price_home", "price_away", "book_home_is_team1")
    oriented, freeze = F.col("orientable"), F.col("capture_kind") == "freeze"
    good = usable(captures).where("priceable")
    out = good.groupBy(*GROUP, "source").agg(
        F.min_by(F.when(oriented & freeze, row), F.when(oriented & freeze, at)).alias("frozen"),
        F.min_by(F.when(oriented, row), F.when(oriented, at)).alias("earliest"),
        F.max_by(F.when(~freeze, row), F.when(~freeze, late)).alias("close"),
        F.count(F.when(~oriented, 1)).alias("n_unorientable"),
    )
    return out.select(*GROUP, "source", F.coalesce("frozen", "earliest").alias("entry"), "close", "n_unorientable")


def model_probability(market: Column, line: Column) -> Column:
    """Chance of side 0 from the frozen record; null where it cannot price the market."""
    over = odds.over_probability(F.col("p_maps_dist"), line)
    return F.when(market == MONEYLINE, F.col("p_model")).when((market == TOTALS) & line.isNotNull() & F.col("p_maps_dist").isNotNull(), over)


def picks(captures: DataFrame, ledger: DataFrame, era: Column | None = None) -> DataFrame:
    """One pick per (match, market, line): the side with the larger expected value at its best entry price.

    Ledger: match_id, p_model, graded, team1_won, maps_played, p_maps_dist, event, start_ts. Captures and ledger are
    shuffled once, by match; the null line of moneylines groups with itself.
    """
    rank = F.coalesce(*(F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(PRIORITY)), F.lit(len(PRIORITY)))
    priced = entry_close(by_match(captures)).where("entry IS NOT NULL").join(ledger, "match_id").withColumn("p0", model_probability(F.col("market"), F.col("line"))).where("p0 IS NOT NULL")
    e, m = F.col("entry"), F.col("market")
    own, other = side_price(e, 0, m), side_price(e, 1, m)
    # the largest price; at equal prices the first in priority, and of the others the first by name
    best = lambda p: F.min_by(F.struct(p.alias("price"), "source", "entry", "close"), F.when(p.isNotNull(), F.struct(-p, rank, "source")))
    names = [c for c in ledger.columns if c != "match_id"]
    grouped = priced.groupBy(*GROUP).agg(
        best(own).alias("b0"), best(other).alias("b1"), F.count("*").alias("n_books"),
        F.percentile(odds.shin(own, other), F.lit(0.5)).alias("fair0"), F.first("p0").alias("p0"), *(F.first(c).alias(c) for c in names))
    ev0, ev1 = F.col("p0") * F.col("b0.price") - 1, (1 - F.col("p0")) * F.col("b1.price") - 1
    side = F.when(ev0 >= ev1, 0).otherwise(1)
    chosen = grouped.withColumn("side", side).withColumn("b", F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1")))
    by_side = lambda a, b: F.when(F.col("side") == 0, a).otherwise(b)
    entry, close = F.col("b.entry"), F.col("b.close")
    close_price = by_side(side_price(close, 0, m), side_price(close, 1, m))
    entry_own, entry_other = by_side(side_price(entry, 0, m), side_price(entry, 1, m)), by_side(side_price(entry, 1, m), side_price(entry, 0, m))
    p = by_side(F.col("p0"), 1 - F.col("p0"))
    price = F.col("b.price")
    over_won = F.when(m == MONEYLINE, F.col("team1_won") == 1).otherwise(F.col("maps_played") > F.col("line"))
    won = F.when(F.col("graded"), by_side(over_won, ~over_won))
    out = chosen.select(
        *GROUP, "side", F.col("b.source").alias("source"), "n_books", p.alias("p"), price.alias("price_entry"), (1 / price).alias("implied"),
        odds.shin(entry_own, entry_other).alias("shin"), by_side(F.col("fair0"), 1 - F.col("fair0")).alias("shin_consensus"),
        odds.multiplicative(entry_own, entry_other).alias("multiplicative"), odds.overround(entry_own, entry_other).alias("overround"),
        (p * price - 1).alias("ev"), F.when(entry["capture_kind"] == "freeze", price / close_price - 1).alias("clv"),
        (~p.between(BUCKET_LOW, BUCKET_HIGH)).alias("extrapolated"), won.alias("won"), entry["captured_at"].alias("entry_at"), close.isNotNull().alias("close_captured"), "event", "start_ts",
    )
    early = F.col("entry_at") < era if era is not None else F.lit(False)
    return out.withColumn("ev_excluded", excluded(early))


def excluded(pre_era: Column) -> Column:
    """Why a pick stays out of the averages; the first reason that applies."""
    return F.when(F.col("extrapolated"), "extrapolation").when(F.col("market") == TOTALS, "totals_independence_bias").when(pre_era, "pre_markets_era")


def skipped(captures: DataFrame, ledger: DataFrame) -> DataFrame:
    """(counter, n) of what the picks could not use: unpriceable rows that would have joined, rows without an
    orientation, and groups without a price."""
    rows = usable(captures).join(ledger, "match_id")
    group = rows.where("priceable").groupBy(*GROUP).agg(F.max(F.col("orientable") & model_probability(F.col("market"), F.col("line")).isNotNull()).alias("ok"))
    a = rows.agg(F.count(F.when(~F.col("priceable"), 1)).alias("n_unpriceable"), F.count(F.when(F.col("priceable") & ~F.col("orientable"), 1)).alias("n_unorientable"))
    b = group.agg(F.count(F.when(~F.col("ok"), 1)).alias("n_groups_unpriced"))
    told = lambda df: df.unpivot([], df.columns, "counter", "n")
    return told(a).unionByName(told(b))


def market_aggregates(picked: DataFrame) -> DataFrame:
    """Coverage, win rate, mean value and closing-line value: overall, by tier and by market."""
    graded = F.col("won").isNotNull()
    core = graded & F.col("ev_excluded").isNull()
    known = core & F.col("clv").isNotNull()
    rows = picked.groupingSets([[], ["tier"], ["market"]], "tier", "market").agg(
        F.grouping_id("tier", "market").alias("level"), F.count("*").alias("n_covered"), F.count(F.when(graded, 1)).alias("n_graded"),
        F.count(F.when(F.col("extrapolated"), 1)).alias("n_extrapolated"), F.count("ev_excluded").alias("n_ev_excluded"),
        F.avg(F.col("won").cast("double")).alias("win_rate"), F.avg(F.when(core, F.col("ev"))).alias("avg_ev"),
        F.avg(F.when(known, F.col("clv"))).alias("avg_clv"), F.avg(F.when(known, (F.col("clv") > 0).cast("double"))).alias("beat_close_rate"),
        F.count(F.when(core, 1)).alias("n_core"))
    return rows.withColumn("ev_validated", F.col("n_core") >= 100)


def unit_tracker(picked: DataFrame, since: Column | None = None) -> DataFrame:
    """Stakes and results of graded moneyline picks in the averages."""
    rows = picked.where((F.col("market") == MONEYLINE) & F.col("won").isNotNull() & F.col("ev_excluded").isNull())
    if since is not None:
        rows = rows.where(F.col("start_ts") >= since)
    staked = rows.withColumn("stake", odds.stake_units(F.col("ev"), F.col("price_entry"))).where("stake > 0")
    gain = F.when(F.col("won"), F.col("price_entry") - 1).otherwise(-1.0)
    return staked.agg(F.count("*").alias("n_staked"), F.count(F.when(F.col("won"), 1)).alias("n_wins"), F.sum("stake").alias("units_staked"), F.sum(F.col("stake") * gain).alias("units_pnl"), (F.sum(F.col("stake") * gain) / F.nullif(F.sum("stake"), F.lit(0.0))).alias("roi"), F.sum(gain).alias("flat_pnl"))


def capture_state(captures: DataFrame) -> DataFrame:
    """Which slots have a freeze and a close; unlinked fixtures are known by their book's id."""
    slot = F.coalesce(F.col("match_id").cast("string"), F.concat(F.lit("book:"), F.col("book_event_id").cast("string")))
    return captures.groupBy("source", slot.alias("slot"), "market", "line").agg(F.bool_or(F.col("capture_kind") == "freeze").alias("freeze"), F.bool_or(F.col("capture_kind") == "close").alias("close"))


def next_kind(start: Column, freeze: Column, close: Column, now: Column, window_min: int = 20) -> Column:
    """What to capture next: freeze, then close near the start, then nothing."""
    near = now >= start - F.make_dt_interval(mins=F.lit(window_min))
    return F.when(now >= start, None).when(~freeze, "freeze").when(near & ~close, "close")
