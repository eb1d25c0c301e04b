"""Fixtures of books to predictions, by names and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import canonical_pair, core_tokens, normalize_name
from tidemark.functions.time import micros
from tidemark.operators import namejoin
from tidemark.tables import written

HOUR = 3_600_000_000
GATE_HOURS = 6
#: Without a start of its own, a capture fits from 14 days before the contest to 3 hours after its start.
BACK_DAYS, FORWARD_HOURS = 14, 3


def aliased(name: Column, aliases: DataFrame | None, df: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: the canonical name of ``name`` if it has an alias, else itself."""
    if aliases is None:
        return df.withColumn(out, name)
    mapped = aliases.select(normalize_name("alias").alias("_alias"), normalize_name("canonical").alias("_canonical")).dropDuplicates(["_alias"])
    return df.join(mapped, name == F.col("_alias"), "left").withColumn(out, F.coalesce("_canonical", name)).drop("_alias", "_canonical")


def keyed_fixtures(fixtures: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Each fixture under its raw pair of names and, where an alias changes it, under the aliased pair."""
    raw = fixtures.withColumn("_h", normalize_name("book_home")).withColumn("_a", normalize_name("book_away"))
    both = aliased(F.col("_a"), aliases, aliased(F.col("_h"), aliases, raw, "_h2"), "_a2")
    forms = F.array(F.struct(F.lit(0).alias("m"), F.col("_h").alias("h"), F.col("_a").alias("a")), F.struct(F.lit(1).alias("m"), F.col("_h2").alias("h"), F.col("_a2").alias("a")))
    changed = (F.col("_h") != F.col("_h2")) | (F.col("_a") != F.col("_a2"))
    return both.select(*fixtures.columns, F.explode(F.when(changed, forms).otherwise(F.slice(forms, 1, 1))).alias("_f"))


def link_fixtures(fixtures: DataFrame, predictions: DataFrame, aliases: DataFrame | None = None, hours: float = GATE_HOURS) -> DataFrame:
    """Each fixture (fixture_id, book_home, book_away, book_start_ts) with match_id, book_home_is_team1 and method.

    Names equal as given beat names equal by alias; of several predictions (match_id, team1_name, team2_name,
    start_ts, position) the first in the list wins. Known starts must lie within ``hours``. What nothing fits
    keeps nulls. The join is on the unordered pair of names.
    """
    keyed = keyed_fixtures(fixtures, aliases).withColumn("_pair", canonical_pair(F.col("_f.h"), F.col("_f.a")))
    known = predictions.select("match_id", F.col("start_ts").alias("_start"), "position", normalize_name("team1_name").alias("_t1"), normalize_name("team2_name").alias("_t2"))
    known = known.withColumn("_pair", canonical_pair(F.col("_t1"), F.col("_t2")))
    apart = F.abs(micros("_start") - micros("book_start_ts"))
    hit = keyed.join(known, "_pair").where(apart.isNull() | (apart <= int(hours * HOUR)))
    first = F.row_number().over(W.partitionBy("fixture_id").orderBy("_f.m", "position", "match_id"))
    best = hit.withColumn("_r", first).where("_r = 1").select("fixture_id", "match_id", (F.col("_f.h") == F.col("_t1")).alias("book_home_is_team1"), F.when(F.col("_f.m") == 0, "exact").otherwise("alias").alias("method"))
    return fixtures.join(best, "fixture_id", "left")


def dedupe_unlinked(captures: DataFrame) -> DataFrame:
    """The earliest capture of each unlinked (source, event, market, line)."""
    order = W.partitionBy("source", "book_event_id", "market", "line").orderBy("captured_at", "seq")
    return captures.where("match_id IS NULL").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def retro_match(unlinked: DataFrame, graded: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Graded rows that an unlinked capture would have fitted, with the first such capture and how it fits."""
    keyed = keyed_fixtures(unlinked, aliases).withColumn("_pair", canonical_pair(F.col("_f.h"), F.col("_f.a")))
    rows = graded.select("match_id", F.col("start_ts").alias("_start"), canonical_pair(normalize_name("team1_name"), normalize_name("team2_name")).alias("_pair"))
    by_start = F.abs(micros("book_start_ts") - micros("_start")) <= GATE_HOURS * HOUR
    since = micros("captured_at") - micros("_start")
    by_capture = since.between(-BACK_DAYS * 24 * HOUR, FORWARD_HOURS * HOUR)
    hit = keyed.drop("match_id").join(rows, "_pair").where(F.when(F.col("book_start_ts").isNotNull(), by_start).otherwise(by_capture))
    first = F.row_number().over(W.partitionBy("match_id").orderBy("captured_at", "fixture_id", "_f.m"))
    return hit.withColumn("_r", first).where("_r = 1").select("match_id", "fixture_id", F.when(F.col("_f.m") == 0, "raw").otherwise("alias").alias("method"), F.when(F.col("book_start_ts").isNotNull(), "book_start").otherwise("captured_at").alias("rule"))


def fuzzy_links(fixtures: DataFrame, predictions: DataFrame, threshold: float = 0.75, margin: float = 0.05) -> DataFrame:
    """The best prediction of each fixture by the weaker of its two name similarities, and whether a runner-up
    is nearly as good; ties go to the smaller match_id.

    Both names must be alike, so the similarity join seeks a fixture by the one of its names that meets fewer others, and
    the second is compared only with those beside what was found. Names are compared once each, and pairs of names once each:
    fixtures and predictions that share theirs meet at the end. A fixture whose names both stand in a prediction scores 1, so its names need only be
    compared with those that can come within ``margin`` of that.
    """
    asked = fixtures.select("book_home", "book_away").where("book_home IS NOT NULL AND book_away IS NOT NULL").distinct()
    sides = predictions.where("team1_name IS NOT NULL AND team2_name IS NOT NULL").select("match_id", "team1_name", "team2_name").distinct()
    nth = F.row_number().over(W.partitionBy("team1_name", "team2_name").orderBy("match_id"))
    first = sides.withColumn("n", nth).where("n <= 2").groupBy("team1_name", "team2_name").agg(F.sort_array(F.collect_list("match_id")).alias("ids"))
    known = written(first)
    core = lambda c: F.array_join(core_tokens(c), " ")
    there = known.select(canonical_pair(core("team1_name"), core("team2_name")).alias("pair")).distinct().withColumn("found", F.lit(True))
    exact = asked.withColumn("pair", canonical_pair(core("book_home"), core("book_away"))).join(there, "pair", "left")
    asked = written(exact.select("book_home", "book_away", F.when(F.col("found"), F.lit(1.0 - margin)).otherwise(F.lit(float(threshold))).alias("least")))
    names = asked.select(F.explode(F.array("book_home", "book_away")).alias("name"), "least")
    index = namejoin.index(names, known.select(F.explode(F.array("team1_name", "team2_name")).alias("name")))
    met = written(namejoin.meetings(index))
    of = lambda x: met.select(F.col("name").alias(f"book_{x}"), F.col("met").alias(f"met_{x}"))
    fewer = F.coalesce("met_home", F.lit(0)) <= F.coalesce("met_away", F.lit(0))
    told = asked.join(of("home"), "book_home", "left").join(of("away"), "book_away", "left").withColumn("by_home", fewer)
    either = lambda a, b: F.when(F.col("by_home"), F.col(a)).otherwise(F.col(b))
    sought = written(told.select("book_home", "book_away", "least", "by_home", either("book_home", "book_away").alias("a"), either("book_away", "book_home").alias("beside")))
    alike = namejoin.found(index, sought.select(F.col("a").alias("name")))
    side = lambda b, d, first: known.select("team1_name", "team2_name", "ids", F.col(b).alias("b"), F.col(d).alias("d"), F.lit(first).alias("first"))
    sides = side("team1_name", "team2_name", True).unionByName(side("team2_name", "team1_name", False))
    near = written(sought.join(alike, "a").where("s >= least").join(sides, "b").withColumn("straight", F.col("by_home") == F.col("first")))
    spoken = lambda c: F.size(core_tokens(c)) > 0
    second = near.select("beside", "d").distinct().where(spoken("beside") & spoken("d")).withColumn("s_beside", namejoin.similarity("beside", "d"))
    both = near.join(second, ["beside", "d"]).withColumn("s", F.least("s", "s_beside")).where("s >= least")
    met = both.groupBy("book_home", "book_away", "team1_name", "team2_name", "ids").agg(F.max(F.struct("s", "straight")).alias("best"))
    order = W.partitionBy("book_home", "book_away").orderBy(F.desc("score"), "match_id")
    rows = met.select("book_home", "book_away", F.col("best.s").alias("score"), F.col("best.straight").alias("book_home_is_team1"), F.explode("ids").alias("match_id"))
    ranked = rows.groupBy("book_home", "book_away", "match_id").agg(F.max(F.struct("score", "book_home_is_team1")).alias("b")).select("book_home", "book_away", "match_id", "b.*")
    ranked = ranked.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order)).withColumn("_other", F.lead("match_id").over(order))
    near = (F.col("_next") >= threshold) & (F.col("score") - F.col("_next") < margin)
    best = ranked.where((F.col("_r") == 1) & (F.col("score") >= threshold)).select("book_home", "book_away", "match_id", "score", "book_home_is_team1", F.when(near, F.col("_other")).alias("ambiguous_with"))
    return fixtures.join(best, ["book_home", "book_away"]).select("fixture_id", "match_id", "score", "book_home_is_team1", "ambiguous_with")


def crosscheck(captures: DataFrame, ledger: DataFrame) -> DataFrame:
    """How far the books' first known start of each match is from the ledger's: count, largest and mean hours."""
    first = captures.where("match_id IS NOT NULL AND book_start_ts IS NOT NULL").groupBy("match_id").agg(F.min_by("book_start_ts", F.struct("captured_at", "seq")).alias("_book"))
    off = F.abs(micros("_book") - micros("start_ts")) / F.lit(float(HOUR))
    return first.join(ledger.select("match_id", "start_ts"), "match_id").agg(F.count("*").alias("n"), F.max(off).alias("max_hours"), F.avg(off).alias("mean_hours"))
