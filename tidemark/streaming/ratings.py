"""Ratings on a stream: results wait in state until their contest's estimated end has passed.

The state of one universe is a map from team and scope to rating and games; a result reads and writes the entries
of its two teams alone. A result is held back with an event-time timer at its end, under that moment; when the
watermark passes it, the results held there apply in order of (end, start, id), as in the batch pass.
The watermark must trail by the longest duration, or contests would be rated before their predecessors end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.operators.ratings import DEFAULT_K, settle, standing

CHANGES = StructType([StructField("universe", StringType()), StructField("match_id", LongType()), StructField("team", StringType()), StructField("rating", DoubleType())])


class _Standings(MutableMapping):
    """The map state of a universe as the table that the batch pass works on."""

    def __init__(self, state) -> None:
        self.state = state

    def __getitem__(self, key):
        if not self.state.containsKey(key):
            raise KeyError(key)
        return self.state.getValue(key)

    def __setitem__(self, key, value) -> None:
        self.state.updateValue(key, value)

    def __delitem__(self, key) -> None:
        self.state.removeKey(key)

    def __iter__(self):
        return self.state.keys()

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())


class _Ratings(StatefulProcessor):
    def __init__(self, k: float) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "end_ms long", "results string")
        self.table = _Standings(handle.getMapState("standings", "team string, scope string", "rating double, games long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples(index=False):
                due = (int(r.end_us) // 1000,)
                held = json.loads(self.waiting.getValue(due)[0]) if self.waiting.containsKey(due) else []
                held.append([int(r.end_us), int(r.start_us), int(r.match_id), r.team1, r.team2, r.map_name, int(r.won)])
                self.waiting.updateValue(due, (json.dumps(held),))
                self.handle.registerTimer(due[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = (expiredTimerInfo.getExpiryTimeInMs(),)
        out = []
        if self.waiting.containsKey(due):
            for _, _, match_id, a, b, name, won in sorted(json.loads(self.waiting.getValue(due)[0])):
                settle(self.table, a, b, [(name, won)], self.k)
                out += [(key[0], match_id, t, standing(self.table, t)[0]) for t in (a, b)]
            self.waiting.removeKey(due)
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in CHANGES])

    def close(self) -> None:
        pass


def rating_changes(results: DataFrame, k: float = DEFAULT_K, delay: str = "5 hours") -> DataFrame:
    """Changes over a stream of results (universe, match_id, start_ts, end_ts, team1, team2, map_name, won)."""
    rows = results.withColumn("start_ts", F.col("start_ts").cast("timestamp")).withWatermark("start_ts", delay)
    rows = rows.select("universe", "start_ts", "match_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros(F.col("end_ts").cast("timestamp")).alias("end_us"), F.col("team1").cast("string").alias("team1"), F.col("team2").cast("string").alias("team2"), "map_name", "won")
    return rows.groupBy("universe").transformWithStateInPandas(statefulProcessor=_Ratings(k), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
