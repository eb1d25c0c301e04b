"""Where every graded match stands against the price log: one bucket each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.markets import MONEYLINE, usable


def partition(graded: DataFrame, captures: DataFrame, picked: DataFrame, retro: DataFrame | None = None, first_capture: Column | None = None) -> DataFrame:
    """match_id and bucket of every graded row. Buckets exclude each other and are tried in order."""
    rows = usable(captures.where("match_id IS NOT NULL"))
    money = F.col("priceable") & (F.col("market") == MONEYLINE)
    seen = rows.groupBy("match_id").agg(F.count("*").alias("_n"), F.count(F.when(F.col("priceable"), 1)).alias("_ok"), F.count(F.when(money, 1)).alias("_money"), F.count(F.when(money & F.col("book_home_is_team1").isNotNull(), 1)).alias("_oriented"))
    covered = picked.select("match_id", F.lit(True).alias("_covered")).distinct()
    out = graded.join(seen, "match_id", "left").join(covered, "match_id", "left")
    if retro is not None:
        out = out.join(retro.select("match_id", F.lit(True).alias("_retro")).distinct(), "match_id", "left")
    else:
        out = out.withColumn("_retro", F.lit(None).cast("boolean"))
    has_distribution = F.col("p_maps_dist").isNotNull() if "p_maps_dist" in graded.columns else F.lit(False)
    early = F.col("start_ts") < first_capture if first_capture is not None else F.lit(False)
    bucket = (
        F.when(F.col("_covered"), "1_covered")
        .when((F.col("_n") > 0) & (F.col("_ok") == 0), "3_linked_unpriceable")
        .when((F.col("_ok") > 0) & (F.col("_money") == 0) & has_distribution, "2c_unexplained")
        .when((F.col("_ok") > 0) & (F.col("_money") == 0), "2a_totals_only_no_dist")
        .when((F.col("_ok") > 0) & (F.col("_oriented") == 0), "2b_orientation_missing")
        .when(F.col("_ok") > 0, "2c_unexplained")
        .when(F.col("_retro"), "4_captured_never_linked")
        .when(early, "5a_pre_capture_era")
        .otherwise("5b_never_listed")
    )
    return out.select("match_id", bucket.alias("bucket"))


def counts(parted: DataFrame) -> DataFrame:
    """Rows by bucket, with the total, so that the sum can be checked against the graded rows."""
    return parted.groupBy("bucket").agg(F.count("*").alias("n"))


def log_statistics(captures: DataFrame) -> DataFrame:
    """Per source: first and last capture, rows and distinct linked matches."""
    return captures.groupBy("source").agg(F.min("captured_at").alias("first"), F.max("captured_at").alias("last"), F.count("*").alias("n"), F.countDistinct("match_id").alias("n_matches"))
