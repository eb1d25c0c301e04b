"""Price captures as a stream: slot state, exactly-once append, late predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.sources.store import exists, new_only


def dedupe_stream(rows: DataFrame, keys: tuple[str, ...], at: str = "captured_at", delay: str = "1 day") -> DataFrame:
    """Each identity once, as long as its repeats come within ``delay``."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def append_new(path: str, keys: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds what the log does not hold yet; running a batch again adds nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        log = spark.read.schema(batch.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], batch.schema)
        new_only(batch, log, keys).write.mode("append").parquet(path)

    return sink


def ingest(rows: DataFrame, path: str, keys: tuple[str, ...], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(append_new(path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frozen_or_late(rows: DataFrame, margin_s: int = 300) -> DataFrame:
    """Predictions against the time they arrive at: a margin before the start, not a watermark, decides."""
    late = F.col("start_ts").cast("timestamp") - F.make_dt_interval(secs=F.lit(margin_s)) < F.col("made_at").cast("timestamp")
    return rows.withColumn("status", F.when(late, "too_late").otherwise("open"))


class _Slots(StatefulProcessor):
    """Remembers per slot whether a freeze and a close were taken; emits every first of either."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", StructType([StructField("mask", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mask = self.taken.get()[0] if self.taken.exists() else 0
        out = []
        for batch in rows:
            for kind in batch["capture_kind"]:
                bit = 1 if kind == "freeze" else 2
                if not mask & bit:
                    mask |= bit
                    out.append((key[0], kind))
        self.taken.update((mask,))
        if out:
            yield pd.DataFrame(out, columns=["slot", "capture_kind"])

    def close(self) -> None:
        pass


def slot_changes(rows: DataFrame, slot: Column) -> DataFrame:
    """(slot, capture_kind) when a slot takes its first freeze or close; state is one number a slot."""
    schema = StructType([StructField("slot", StringType()), StructField("capture_kind", StringType())])
    keyed = rows.select(slot.alias("slot"), "capture_kind")
    return keyed.groupBy("slot").transformWithStateInPandas(statefulProcessor=_Slots(), outputStructType=schema, outputMode="Append", timeMode="None")


def windowed_counts(rows: DataFrame, at: str = "captured_at", every: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Captures per source and hour, final once the watermark has passed."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, every), "source").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "source", "n")
