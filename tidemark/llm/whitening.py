"""Embedding whitening: covariance by pairwise merging of centred moments.

Each partition keeps count, mean and centred scatter of the rows it has seen: an Arrow batch is centred by its own
mean and merged into the state by Chan's formula. ``treeReduce`` merges the partitions' states the same way, so
no sum of uncentred squares is ever formed and what reaches the driver is one state: a vector and a square matrix of
the dimension. The driver solves the symmetric eigenproblem; the components, at most as large again, go back with the
second and third pass, of which the second merges the moments of the whitened rows to verify that their covariance is
the identity.

Entries become integers before anything else (``floor(scale * c) + shift``), whose sums over all rows stay exact in any
order.

Defined results: a vector that is null, empty, or holds an entry that is null, not finite or, scaled, beyond 2**49 takes no
part; of vectors of several lengths those of the most frequent one take part (of equally frequent ones the longest); zero vectors and
repeated rows count like others; a null id stays; an empty table, or one without a usable vector, gives no rows; extra
columns are ignored. A component without variance (up to rounding) has ``whitened`` 0 and is left out of the
identity; ``deviation`` is null where it is beyond 64 bits. A task holds one Arrow batch and a square matrix of the
dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

SCALE, SHIFT = 64, 1_000_000
#: With scaled entries up to this, the sum of a chunk stays within 64 bits.
MOST = float(2**49)
#: Rows that are centred at once.
CHUNK = 4096
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Moments(NamedTuple):
    """Count, exact sums (Python integers, which don't overflow), mean and centred scatter."""

    n: int
    total: list[int]
    mean: np.ndarray
    scatter: np.ndarray


def measured(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    centred = x - mean
    whole = [int(v) for v in x.sum(axis=0, dtype=np.int64)] if x.dtype == np.int64 else []
    return Moments(len(x), whole, mean, centred.T @ centred)


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """Chan's pairwise formula."""
    if a is None or b is None:
        return a if b is None else b
    n = a.n + b.n
    apart = b.mean - a.mean
    scatter = a.scatter + b.scatter + np.outer(apart, apart) * (a.n * (b.n / n))
    return Moments(n, [x + y for x, y in zip(a.total, b.total)], a.mean + apart * (b.n / n), scatter)


class Whitening(NamedTuple):
    """What the driver keeps: components in columns, their standard deviations (0 for none) and shares of variance."""

    n: int
    total: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        # n * x - S, exactly, before the division, so that centring loses nothing
        if self.n * float(np.abs(x).max(initial=0)) < 2**61:
            centred = (x * self.n - np.array(self.total, dtype=np.int64)) / self.n
        else:
            centred = np.array([[(int(v) * self.n - s) / self.n for v, s in zip(row, self.total)] for row in x]).reshape(x.shape)
        spread = np.where(self.deviations > 0, self.deviations, 1.0)
        return np.where(self.deviations > 0, (centred @ self.components) / spread, 0.0)


def scaled(df: DataFrame, key: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x) of the usable rows, x an array of longs, all of one length."""
    entry = lambda c: F.floor(c.cast("double") * F.lit(float(scale)))
    # array functions see a null entry as null, hence the coalesce; NaN is greater than all numbers in Spark
    ok = F.forall(F.col("v"), lambda c: F.coalesce(F.abs(c.cast("double") * F.lit(float(scale))) < F.lit(MOST), F.lit(False)))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where((F.size("v") > 0) & ok)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("held")).orderBy(F.desc("held"), F.desc("d")).first()
    return rows.where(F.size("v") == (lengths.d if lengths else 0)).select("id", F.transform("v", lambda c: entry(c) + F.lit(shift)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64, copy=False)


def gathered(rows: DataFrame, apply: Whitening | None = None) -> Moments | None:
    """The moments of all rows, or of what ``apply`` makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                x = _matrix(batch.column(0).slice(begin, CHUNK))
                state = merged(state, measured(apply.apply(x) if apply else x))
        if state is not None:
            out = [[state.n], [[str(v) for v in state.total]], [state.mean], [state.scatter.ravel()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64())))], ["n", "total", "mean", "scatter"])

    states = rows.select("x").mapInArrow(run, "n long, total array<string>, mean array<double>, scatter array<double>").rdd
    # one state a partition, merged by partitions and then in a tree; None stands for partitions without rows
    made = states.map(lambda r: Moments(r.n, [int(v) for v in r.total], np.array(r.mean), np.array(r.scatter).reshape(len(r.mean), -1)))
    return made.treeReduce(merged) if not rows.isEmpty() else None


def solved(m: Moments, keep: int) -> Whitening:
    """The leading eigenvectors of scatter / n. Variance below rounding counts as none."""
    values, vectors = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(-values, kind="stable")[:keep]
    top, trace = values[order], max(float(np.trace(m.scatter / m.n)), 0.0)
    there = top > trace * len(values) * np.finfo(float).eps
    return Whitening(m.n, m.total, vectors[:, order], np.where(there, np.sqrt(np.maximum(top, 0)), 0.0), np.where(there, top, 0.0) / trace if trace else np.zeros(len(top)))


def identity_error(m: Moments, w: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity, over components with variance."""
    there = w.deviations > 0
    apart = (m.scatter / m.n)[np.ix_(there, there)] - np.eye(int(there.sum()))
    return float(np.abs(apart).max(initial=0.0))


def whiten(df: DataFrame, key: str, vector: str, keep: int = 32, most_error: float | None = None) -> DataFrame:
    """One row for each usable row and component. ``most_error`` raises if the identity is missed by more."""
    rows = scaled(df, key, vector)
    first = gathered(rows)
    if first is None:
        return df.sparkSession.createDataFrame([], RESULT)
    w = solved(first, keep)
    error = identity_error(gathered(rows, w), w)
    if most_error is not None and error > most_error:
        raise ArithmeticError(f"the whitened covariance misses the identity by {error}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, total = len(w.deviations), np.array(w.total, dtype=object)
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                ids, x = batch.column(0).slice(begin, CHUNK), _matrix(batch.column(1).slice(begin, CHUNK))
                apart = np.abs(x.astype(float) * w.n - total.astype(float))
                if (apart * apart).sum(axis=1).max(initial=0) < 2**62 and w.n * float(np.abs(x).max(initial=0)) < 2**62:
                    d = x * w.n - np.array(w.total, dtype=np.int64)
                    away = (d * d).sum(axis=1).tolist()
                else:  # beyond 64 bits on the way
                    away = [v if (v := sum((int(c) * w.n - s) ** 2 for c, s in zip(row, w.total))) < 2**63 else None for row in x]
                made = len(x) * k
                cells = [
                    ids.take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(made, w.n)),
                    pa.array(away, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(w.apply(x).ravel()),
                    pa.array(np.tile(w.explained, len(x))),
                    pa.array(np.full(made, error)),
                ]
                yield pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in RESULT.split(", ")])

    return rows.select("id", "x").mapInArrow(run, RESULT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", most_error=1e-4)


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
