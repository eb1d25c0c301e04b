"""Walk-forward replay: every contest is called by the model that would have been current.

A feature table built once and cut at a moment equals one built at that moment, so retraining epochs are
independent given the family chosen before; the driver walks the few epochs and each is scored as one batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import micros
from tidemark.operators import ledger, models
from tidemark.operators.evaluation import assign_epochs, cadence_ticks, chronological_split


def walk_forward(features: DataFrame, names: Sequence[str], differences: Sequence[str], label: str = "y", warmup: int = 300, grid: Sequence[float] = models.C_GRID, **cadence: int) -> tuple[DataFrame, DataFrame]:
    """(rows, ticks): each feature row (match_id, start_ts, end_ts, label, names) with epoch and p_model; rows before
    the first model are dropped. An epoch's model comes from ``models.train`` (menu, choice and calibration) on
    contests that ended by its tick, the latest 15 % of them held out for validation."""
    ticks = cadence_ticks(features.select("match_id", "end_ts"), warmup, **cadence)
    moments = ticks.select("index", micros("at").alias("t")).orderBy("index").collect()
    placed = assign_epochs(features, ticks)
    out = []
    for r in moments:
        parts = chronological_split(features.where(micros("end_ts") <= r["t"]), train=0.85, validation=0.15)
        trained = models.train(parts.withColumn("part", F.when(F.col("part") == "test", "validation").otherwise(F.col("part"))), names, differences, label, grid=grid)
        out.append(models.calibrated(trained, placed.where(F.col("epoch") == r["index"]), "p_model"))
    return reduce(DataFrame.unionByName, out) if out else placed.where("false").withColumn("p_model", F.lit(None).cast("double")), ticks


def report(rows: DataFrame) -> DataFrame:
    """Metrics by tier and half-year, recomputed from saved rows; nothing is scored again."""
    return ledger.tier_metrics(rows)


def replace_allowed(existing: str | None, shipped: str | None, replace: bool) -> bool:
    """A report is written once; again only on request and if the shipped version has changed."""
    return existing is None or (replace and shipped != existing)


def retrain_due(age_days: float | None, new_matches: int, behaviour_changed: bool, max_days: int = 7, many: int = 100) -> bool:
    return age_days is None or behaviour_changed or age_days >= max_days or new_matches >= many


def leakage_check(features: DataFrame, recomputed: DataFrame, names: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows whose features, recomputed from truncated history, differ: (match_id, feature). Empty if nothing leaks."""
    again = recomputed.select("match_id", *(F.col(c).alias(f"_{c}") for c in names))
    both = features.join(again, "match_id")
    differ = F.array(*(F.when(~F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.col(c).isNull() & F.col(f"_{c}").isNull()), F.lit(c)) for c in names))
    return both.select("match_id", F.explode(F.filter(differ, lambda x: x.isNotNull())).alias("feature"))
