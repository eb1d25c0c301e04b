"""Summaries that are kept by day and merged: counts, distinct counts and frequent values.

Counts are exact. Distinct values of a day go into a sketch of bounded size, and sketches of any days merge into one
whose estimate has a relative standard error of about 1.04 / sqrt(2**precision). Frequent values go into a sketch of
``slots`` counters a day; an estimate from merged ones is off by n / slots at most, so every value with more rows
than that is among them. ``value_counts`` and ``distinct_values`` are the exact forms, which have to read the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION, SLOTS = 12, 1024


def standard_error(precision: int = PRECISION) -> float:
    return 1.04 / sqrt(2**precision)


def by_day(rows: DataFrame, at: str, value: str, precision: int = PRECISION, slots: int = SLOTS) -> DataFrame:
    """One row per day: rows, rows with a value, the sketch of distinct values and that of frequent ones."""
    return rows.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"), F.count(value).alias("n_known"), F.hll_sketch_agg(value, F.lit(precision)).alias("distinct"), F.expr(f"approx_top_k_accumulate(`{value}`, {slots})").alias("frequent"))


def merged(days: DataFrame, *keys: Column | str, top: int = 10) -> DataFrame:
    """Summaries of all days, or of groups of them: rows, estimated distinct values, and the ``top`` values with their counts."""
    union = days.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_known").alias("n_known"), F.hll_union_agg("distinct").alias("d"), F.expr("approx_top_k_combine(frequent)").alias("f"))
    return union.withColumns({"n_distinct": F.hll_sketch_estimate("d"), "top": F.expr(f"approx_top_k_estimate(f, {top})")}).drop("d", "f")


def distinct_values(rows: DataFrame, value: str, *keys: Column | str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(value).alias("n_distinct"))


def value_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of every value, nulls too: one pass for all columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def linear_fit(rows: DataFrame, x: str, y: str, limit: float | None = None, *keys: str) -> DataFrame:
    """Least squares of y on x: n, slope, intercept and the x at which y reaches ``limit``. Rows without one of them are
    left out; without two different x there is no line, and where y does not rise there is no crossing."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = known.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    crossing = F.when(F.col("slope") > 0, (F.lit(limit).cast("double") - F.col("intercept")) / F.col("slope"))
    return fit.withColumn("crossing", crossing)
