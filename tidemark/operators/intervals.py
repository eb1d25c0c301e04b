"""Samples inside intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.time import micros
from tidemark.tables import written

MINUTE = 60_000_000
BEGIN, SAMPLE, END = 0, 1, 2


def phase_peaks(samples: DataFrame, phases: DataFrame, bin_minutes: int = 60) -> DataFrame:
    """Largest value and number of samples (ts, value) inside each phase (phase_id, begin, finish), ends included.

    No sample meets its phases one by one. Time is cut into bins of a size for each phase: the largest power of two
    microseconds that is no longer than the phase, ``bin_minutes`` at most. So a phase begins and ends in different bins, and has
    the samples of its first bin from its begin on, those of its last up to its end, and all of the bins between. The
    first two are running maxima and counts in order of time, the last are totals of bins; samples are entered once for
    each size that occurs, and work grows with samples, phases and the bins that phases touch.
    """
    length = F.col("_e") - F.col("_b")
    fitting = F.pow(F.lit(2.0), F.length(F.bin(F.greatest(length, F.lit(1)))) - 1).cast("long")
    spread = phases.select("phase_id", micros("begin").alias("_b"), micros("finish").alias("_e")).where("_b <= _e")
    spread = written(spread.withColumn("_size", F.least(fitting, F.lit(bin_minutes * MINUTE))).withColumns({"_first": F.floor(F.col("_b") / F.col("_size")), "_last": F.floor(F.col("_e") / F.col("_size"))}))
    kind = phases.schema["phase_id"].dataType
    dated = samples.where("ts IS NOT NULL").select(micros("ts").alias("_t"), "value").join(F.broadcast(spread.select("_size").distinct()))
    dated = written(dated.withColumn("_bin", F.floor(F.col("_t") / F.col("_size"))))
    of_bin = dated.groupBy("_size", "_bin").agg(F.max("value").alias("peak"), F.count("*").alias("n"))
    none = F.lit(None).cast(samples.schema["value"].dataType).alias("value")
    ask = lambda rows, at, bin_, o: rows.select("_size", F.col(bin_).alias("_bin"), F.col(at).alias("_t"), F.lit(o).alias("_o"), "phase_id", none)
    # a phase of one moment lies in one bin of one microsecond, all of which counts from its begin on
    asked = ask(spread, "_b", "_first", BEGIN).unionByName(ask(spread.where("_first < _last"), "_e", "_last", END))
    both = asked.unionByName(dated.select("_size", "_bin", "_t", F.lit(SAMPLE).alias("_o"), F.lit(None).cast(kind).alias("phase_id"), "value"))
    run = W.partitionBy("_size", "_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    up, down = run.orderBy("_t", "_o"), run.orderBy(F.desc("_t"), F.desc("_o"))
    told = lambda w: F.struct(F.max("value").over(w).alias("peak"), F.count(F.when(F.col("_o") == SAMPLE, 1)).over(w).alias("n"))
    ends = both.select("_o", "phase_id", told(up).alias("up"), told(down).alias("down")).where(F.col("_o") != SAMPLE)
    ends = ends.select("phase_id", F.when(F.col("_o") == BEGIN, F.col("down")).otherwise(F.col("up")).alias("s")).select("phase_id", "s.*")
    between = spread.where("_last - _first > 1").select("phase_id", "_size", F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1)).alias("_bin"))
    whole = between.join(of_bin, ["_size", "_bin"]).select("phase_id", "peak", "n")
    return ends.unionByName(whole).groupBy("phase_id").agg(F.max("peak").alias("peak"), F.sum("n").alias("n")).where("n > 0")
