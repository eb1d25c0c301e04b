"""The prediction ledger: first write wins, results are filled in later, metrics score what was frozen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import BUCKET_HIGH, BUCKET_LOW, brier, log_loss, probability_bucket, right_call, wilson
from tidemark.functions.text import is_placeholder
from tidemark.functions.time import half_year, micros
from tidemark.operators.evaluation import numbered

FREEZE_MARGIN_S = 300
REPORT_MIN, ACT_MIN = 30, 100


def insert_status(new: DataFrame, ledger: DataFrame, now: Column, position: str = "position") -> DataFrame:
    """Each new prediction with its status: too_late inside the margin, frozen if the match is there already or
    earlier in the batch, else inserted."""
    late = micros("start_ts") - F.unix_micros(now.cast("timestamp")) < FREEZE_MARGIN_S * 1_000_000
    there = ledger.select("match_id", F.lit(True).alias("_there")).distinct()
    order = W.partitionBy("match_id", "_late").orderBy(position)
    marked = new.withColumn("_late", late).withColumn("_r", F.row_number().over(order)).join(there, "match_id", "left")
    status = F.when(F.col("_late"), "too_late").when(F.col("_there") | (F.col("_r") > 1), "frozen").otherwise("inserted")
    return marked.withColumn("status", status).drop("_late", "_r", "_there")


def insert(new: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """The rows to append."""
    return insert_status(new, ledger, now).where("status = 'inserted'").drop("status", "position")


def grade(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """Fill team1_won and maps_played of ungraded rows from ``results`` (match_id, team1_won, maps_played, team1_name,
    team2_name); names follow only where the ledger has a placeholder and the result a name."""
    found = results.dropDuplicates(["match_id"]).select("match_id", *(F.col(c).alias(f"_{c}") for c in results.columns if c != "match_id"))
    hit = ~F.col("graded") & F.col("_team1_won").isNotNull()
    out = ledger.join(found, "match_id", "left")
    for c in ("team1_won", "maps_played"):
        if c in ledger.columns:
            out = out.withColumn(c, F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)))
    if "team1_name" in ledger.columns and "team1_name" in results.columns:
        blank = is_placeholder("team1_name", True) | is_placeholder("team2_name", True)
        named = hit & blank & ~(is_placeholder("_team1_name", True) & is_placeholder("_team2_name", True))
        out = out.withColumns({c: F.when(named, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("team1_name", "team2_name")})
    return out.withColumn("graded", F.col("graded") | hit).select(*ledger.columns)


def backfill(ledger: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Fill nulls of ``column`` from ``values`` (match_id, column); what is there stays."""
    new = values.dropDuplicates(["match_id"]).select("match_id", F.col(column).alias("_v"))
    return ledger.join(new, "match_id", "left").withColumn(column, F.coalesce(column, "_v")).select(*ledger.columns)


def heal_names(ledger: DataFrame, resolved: DataFrame) -> DataFrame:
    """Placeholder sides take the resolved key and name; real keys are never overwritten."""
    new = resolved.dropDuplicates(["match_id"]).select("match_id", *(F.col(c).alias(f"_{c}") for c in ("team1", "team2", "team1_name", "team2_name")))
    out = ledger.join(new, "match_id", "left")
    for side in ("team1", "team2"):
        take = is_placeholder(side, True) & F.col(f"_{side}").isNotNull() & ~is_placeholder(f"_{side}", True)
        out = out.withColumn(f"{side}_name", F.when(take, F.col(f"_{side}_name")).otherwise(F.col(f"{side}_name"))).withColumn(side, F.when(take, F.col(f"_{side}")).otherwise(F.col(side)))
    return out.select(*ledger.columns)


def listed_names(rows: DataFrame) -> DataFrame:
    """How a listing's sides (l1, l2) map onto frozen keys (team1, team2): aligned, swapped, one or both sides
    placeholders, or unmatched."""
    p1, p2 = is_placeholder("team1", True), is_placeholder("team2", True)
    a, b, c, d = (F.col(x) == F.col(y) for x, y in (("l1", "team1"), ("l2", "team2"), ("l1", "team2"), ("l2", "team1")))
    case = (
        F.when(a & b, "aligned").when(c & d, "swapped").when(p1 & p2, "both_placeholders")
        .when(p1 & b, "first_placeholder").when(p1 & c, "first_placeholder_swapped")
        .when(p2 & a, "second_placeholder").when(p2 & d, "second_placeholder_swapped").otherwise("unmatched")
    )
    return rows.withColumn("case", case).withColumn("flip", case.endswith("swapped"))


def metric_columns(p: str, suffix: str, strict: bool = False) -> list[Column]:
    y, q = F.col("team1_won"), F.col(p)
    return [F.avg(log_loss(q, y)).alias(f"log_loss_{suffix}"), F.avg(brier(q, y)).alias(f"brier_{suffix}"), F.avg(right_call(q, y, strict)).alias(f"accuracy_{suffix}")]


def scored(ledger: DataFrame) -> DataFrame:
    return ledger.where("graded AND NOT low_history AND team1_won IS NOT NULL")


def summary(ledger: DataFrame) -> DataFrame:
    """Counts of all rows, and metrics of both predictors over graded rows with enough history."""
    ok = F.col("graded") & ~F.col("low_history")
    y = F.when(ok, F.col("team1_won"))
    parts = []
    for p, name in (("p_model", "model"), ("p_elo", "elo")):
        q = F.col(p)
        parts += [F.avg(log_loss(q, y)).alias(f"log_loss_{name}"), F.avg(brier(q, y)).alias(f"brier_{name}"), F.avg(F.when(y.isNotNull(), right_call(q, y))).alias(f"accuracy_{name}")]
    return ledger.agg(F.count(F.when(~F.col("graded"), 1)).alias("n_pending"), F.count(F.when(F.col("graded"), 1)).alias("n_graded"), F.count(F.when(F.col("graded") & F.col("low_history"), 1)).alias("n_low_history"), F.count(y).alias("n_scored"), *parts)


def tier_metrics(ledger: DataFrame, by: str = "tier") -> DataFrame:
    """Backtest metrics by tier and, within it, by half-year; a favourite needs more than even odds here."""
    rows = scored(ledger).withColumn("period", half_year("made_at"))
    return rows.groupingSets([[by], [by, "period"]], by, "period").agg(F.grouping("period").cast("int").alias("whole"), F.count("*").alias("n_scored"), *metric_columns("p_model", "model", True), *metric_columns("p_elo", "elo", True))


def checkpoint(ledger: DataFrame, since: Column, first_n: int = 30, decision_n: int = 50) -> DataFrame:
    """Low-history rows since a moment, withheld until there are ``first_n``, with a verdict from ``decision_n`` on."""
    era = ledger.where("graded AND team1_won IS NOT NULL").where(F.col("made_at") >= since)
    low, y = F.col("low_history"), F.col("team1_won")
    n = F.count(F.when(low, 1))
    loss = {name: F.avg(F.when(low, log_loss(F.col(p), y))) for p, name in (("p_model", "model"), ("p_elo", "elo"))}
    phase = F.when(F.col("n") < first_n, "accumulating").when(F.col("n") < decision_n, "directional").otherwise("decision")
    out = era.agg(n.alias("n"), F.count(F.when(~low, 1)).alias("n_established"), loss["model"].alias("_m"), loss["elo"].alias("_e"))
    shown = F.col("n") >= first_n
    return out.select("n", "n_established", phase.alias("phase"), F.when(shown, F.col("_m")).alias("ll_model"), F.when(shown, F.col("_e")).alias("ll_elo"), F.when(F.col("n") >= decision_n, F.col("_m") < F.col("_e")).alias("primary_met"))


def calibration_cells(ledger: DataFrame, by: str | None = None) -> DataFrame:
    """Cells of stated probability: count, mean, observed share with its 95 % interval, and a status."""
    rows = ledger.where("graded AND team1_won IS NOT NULL").withColumn("bucket", probability_bucket(F.col("p_model")))
    keys = [by, "bucket"] if by else ["bucket"]
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("p_model").alias("mean_p"), F.sum("team1_won").alias("_k"))
    lo, hi = wilson(F.col("_k"), F.col("n"))
    inside = F.col("mean_p").between(lo, hi)
    status = F.when(F.col("n") < REPORT_MIN, "insufficient").when(F.col("n") < ACT_MIN, "reported").when(~inside, "DRIFT").otherwise("ok")
    return cells.select(*keys, "n", "mean_p", (F.col("_k") / F.col("n")).alias("observed"), lo.alias("low"), hi.alias("high"), status.alias("status"))


def spiegelhalter(ledger: DataFrame) -> DataFrame:
    """The calibration Z statistic; null where its variance is not positive."""
    p, y = F.col("p_model"), F.col("team1_won")
    rows = ledger.where("graded AND team1_won IS NOT NULL")
    top, under = F.sum((y - p) * (1 - 2 * p)), F.sum((1 - 2 * p) * (1 - 2 * p) * p * (1 - p))
    return rows.agg(F.count("*").alias("n"), F.when(under > 0, top / F.sqrt(under)).alias("z"), F.count(F.when((p < BUCKET_LOW) | (p > BUCKET_HIGH), 1)).alias("extrapolated"))


def quantile_edges(rows: DataFrame, p: str, bins: int) -> list[float]:
    """Distinct quantiles of ``p`` with linear interpolation, from the few rows at their places in the whole order."""
    known = numbered(rows.where(F.col(p).isNotNull()).select(F.col(p).cast("double").alias("p")), ["p"])
    place = lambda i: F.lit(i / bins) * (F.col("_n") - 1)
    needed = F.array(*(f(place(i)) + 1 for i in range(bins + 1) for f in (F.floor, F.ceil)))
    at = {r["_i"]: r for r in known.where(F.array_contains(needed, F.col("_i"))).collect()}
    if not at:
        return []
    places = [i / bins * (next(iter(at.values()))["_n"] - 1) for i in range(bins + 1)]
    low, high = ([at[f(x) + 1]["p"] for x in places] for f in (math.floor, math.ceil))
    return sorted({a + (b - a) * (x - math.floor(x)) for a, b, x in zip(low, high, places)})


def calibration_curve(rows: DataFrame, p: str = "p_model", y: str = "team1_won", bins: int = 10) -> DataFrame:
    """Mean stated and observed share by quantile bin, bins closed on the right."""
    edges = quantile_edges(rows, p, bins)
    place = F.lit(0)
    for i, e in enumerate(edges[1:-1]):
        place = F.when(F.col(p) > e, i + 1).otherwise(place)
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"))


def expected_calibration_error(curve: DataFrame) -> DataFrame:
    return curve.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))) / F.sum("n")).alias("ece"))


def leaders(per_tier: DataFrame) -> DataFrame:
    """How many tiers each predictor leads on log loss; ties count for nobody."""
    m, e = F.col("log_loss_model"), F.col("log_loss_elo")
    return per_tier.agg(F.count_if(m < e).alias("model_leads"), F.count_if(e < m).alias("elo_leads"), F.count("*").alias("n"))


def standing(ll_model: Column, ll_elo: Column, acc_model: Column, acc_elo: Column) -> Column:
    """Two metrics as ahead, behind, mixed or unknown."""
    known = ll_model.isNotNull() & ll_elo.isNotNull() & acc_model.isNotNull() & acc_elo.isNotNull()
    return F.when(~known, "unknown").when((ll_model <= ll_elo) & (acc_model >= acc_elo) & ((ll_model < ll_elo) | (acc_model > acc_elo)), "ahead").when((ll_model >= ll_elo) & (acc_model <= acc_elo) & ((ll_model > ll_elo) | (acc_model < acc_elo)), "behind").otherwise("mixed")


def validate_summary(report: DataFrame) -> DataFrame:
    """``reasons`` for which a summary must not be published; empty if none."""
    checks = [(F.col("n_scored") <= 0, "nothing scored"), (F.col("log_loss_model").isNull(), "no log loss"), (~F.col("log_loss_model").between(0, 5), "log loss out of range"), (~F.col("accuracy_model").between(0, 1), "accuracy out of range")]
    return report.withColumn("reasons", F.filter(F.array(*(F.when(c, r) for c, r in checks)), lambda x: x.isNotNull()))


def scoreboard(ledger: DataFrame, graded: int = 300, pending: int = 500) -> tuple[DataFrame, DataFrame]:
    """Newest graded rows, and pending rows soonest first; each limit follows its own order."""
    return (ledger.where("graded").orderBy(F.desc("start_ts"), "match_id").limit(graded), ledger.where("NOT graded").orderBy("start_ts", "match_id").limit(pending))
