"""Probability models on Spark ML, calibrators, and how one is chosen over another."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.stats import clipped, log_loss
from tidemark.operators.evaluation import augment_swapped

#: Inverse regularisation grid, output clip, rows below which isotonic is not tried.
C_GRID = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0)
OUTPUT_CLIP = 0.005
ISOTONIC_MIN = 800
GBT_FROM = 500


def assembled(features: Sequence[str]) -> list:
    return [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]


def probability(model: PipelineModel, rows: DataFrame, out: str = "p") -> DataFrame:
    scored = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("_raw", "_x", "rawPrediction", "probability", "prediction")


def mean_log_loss(rows: DataFrame, p: str, y: str) -> float:
    return rows.agg(F.avg(log_loss(F.col(p), F.col(y)))).first()[0]


def fit_logistic(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str = "y", grid: Sequence[float] = C_GRID) -> tuple[PipelineModel, float]:
    """L2 logistic regression, the grid point with the least validation loss; ties go to the earlier."""
    n, best = train.count(), None
    for c in grid:
        stages = [*assembled(features), LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=200)]
        model = Pipeline(stages=stages).fit(train)
        loss = mean_log_loss(probability(model, validation), "p", label)
        if best is None or loss < best[1]:
            best = (model, loss)
    return best


def fit_boosted(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str = "y", rounds: int = 40) -> tuple[PipelineModel, float]:
    """Boosted trees that stop when validation no longer improves."""
    both = train.withColumn("_val", F.lit(False)).unionByName(validation.withColumn("_val", F.lit(True)))
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=label, validationIndicatorCol="_val", maxIter=rounds, maxDepth=3, stepSize=0.1, seed=7)]
    model = Pipeline(stages=stages).fit(both)
    return model, mean_log_loss(probability(model, validation), "p", label)


def logit(p: Column) -> Column:
    q = clipped(p)
    return F.log(q / (1 - q))


def fit_platt(rows: DataFrame, p: str = "p", label: str = "y") -> tuple[float, float]:
    """Slope and intercept on the log-odds."""
    x = rows.select(logit(F.col(p)).alias("z"), F.col(label).cast("double").alias("y"))
    model = LogisticRegression(featuresCol="v", labelCol="y", regParam=0.0).fit(VectorAssembler(inputCols=["z"], outputCol="v").transform(x))
    return float(model.coefficients[0]), float(model.intercept)


def platt(p: Column, fitted: tuple[float, float]) -> Column:
    return output_clip(1 / (1 + F.exp(-(F.lit(fitted[0]) * logit(p) + F.lit(fitted[1])))))


def output_clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(OUTPUT_CLIP)), F.lit(1 - OUTPUT_CLIP))


def fit_isotonic(rows: DataFrame, p: str = "p", label: str = "y") -> tuple[list[float], list[float]]:
    """Boundaries and values of the monotone fit: as many as the fit has steps."""
    model = IsotonicRegression(featuresCol="x", labelCol="y").fit(rows.select(F.col(p).alias("x"), F.col(label).cast("double").alias("y")))
    return list(model.boundaries), list(model.predictions)


def fit_smooth(rows: DataFrame, steps: tuple[list[float], list[float]], p: str = "p") -> tuple[list[float], list[float]]:
    """Knots of the smooth reading: of each level stretch of a monotone fit, the mean input of the rows on it."""
    xs, ys = (np.asarray(v, float) for v in steps)

    @F.pandas_udf(DoubleType())
    def level(v: pd.Series) -> pd.Series:
        return pd.Series(np.interp(v.to_numpy(dtype=float, na_value=np.nan), xs, ys))

    knots = rows.groupBy(level(F.col(p)).alias("y")).agg(F.avg(p).alias("x")).orderBy("y").collect()
    return [r["x"] for r in knots], [r["y"] for r in knots]


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shape-preserving cubic through the knots, level outside them."""
    if len(x) == 1:
        return np.full(len(at), y[0])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    m[0], m[-1] = d[0], d[-1]
    inner = d[:-1] * d[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    m[1:-1][inner] = ((w1 + w2) / (w1 / np.where(d[:-1] == 0, 1, d[:-1]) + w2 / np.where(d[1:] == 0, 1, d[1:])))[inner]
    at = np.clip(at, x[0], x[-1])
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    t = (at - x[i]) / h[i]
    return (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h[i] * m[i] + t * t * (3 - 2 * t) * y[i + 1] + t * t * (t - 1) * h[i] * m[i + 1]


def interpolated(p: Column, fitted: tuple[Sequence[float], Sequence[float]], smooth: bool = False) -> Column:
    """Piecewise linear reading of a monotone fit, or the smooth one of its knots; clipped."""
    xs, ys = (np.asarray(v, float) for v in fitted)

    @F.pandas_udf(DoubleType())
    def read(v: pd.Series) -> pd.Series:
        v = v.to_numpy(dtype=float, na_value=np.nan)
        return pd.Series(monotone_cubic(xs, ys, v) if smooth else np.interp(v, xs, ys))

    return output_clip(read(p))


def calibrate(validation: DataFrame, p: str = "p", label: str = "y") -> tuple[str, object]:
    """Platt or, from ``ISOTONIC_MIN`` rows on, whichever of the three has the least loss; ties go to Platt."""
    fitted = [("platt", fit_platt(validation, p, label))]
    if validation.count() >= ISOTONIC_MIN:
        steps = fit_isotonic(validation, p, label)
        fitted += [("isotonic", steps), ("smooth", fit_smooth(validation, steps, p))]
    scored = validation.select(F.col(label).alias("y"), *(apply_calibration(F.col(p), f).alias(f[0]) for f in fitted))
    losses = scored.agg(*(F.avg(log_loss(F.col(k), F.col("y"))).alias(k) for k, _ in fitted)).first()
    return min(fitted, key=lambda f: losses[f[0]])


def apply_calibration(p: Column, fitted: tuple[str, object]) -> Column:
    kind, values = fitted
    return platt(p, values) if kind == "platt" else interpolated(p, values, kind == "smooth")


def rolling_scores(rows: DataFrame, features: Sequence[str], differences: Sequence[str], label: str = "y", fold: str = "fold", key: str = "match_id", grid: Sequence[float] = C_GRID) -> DataFrame:
    """(key, fold, family, loss) of every row from fold 1 on: the loss of each family when it is trained on the folds before.

    Each family's whole procedure runs again on every fold (the grid picks its C anew, boosting stops anew, both by
    the fold); training rows come with their mirror images. The driver walks the few folds.
    """
    parts = []
    for k in range(1, (rows.agg(F.max(fold)).first()[0] or 0) + 1):
        past, now = rows.where(F.col(fold) < k), rows.where(F.col(fold) == k)
        train = augment_swapped(past, differences, label)
        fitters = {"logistic": partial(fit_logistic, grid=grid), "boosted": fit_boosted}
        for family in menu(past.count()):
            scored = probability(fitters[family](train, now, features, label)[0], now)
            parts.append(scored.select(key, fold, F.lit(family).alias("family"), log_loss(F.col("p"), F.col(label)).alias("loss")))
    empty = rows.where("false").select(key, fold, F.lit("").alias("family"), F.lit(0.0).alias("loss"))
    return reduce(DataFrame.unionByName, parts, empty)


def choose_family(scores: DataFrame, incumbent: str | None, key: str = "match_id") -> str:
    """The family with the least mean loss over all scored rows; an incumbent goes only if it is beaten by more than one
    standard error of the paired differences, row by row."""
    means = {r["family"]: r["loss"] for r in scored_means(scores).collect()}
    best = min(means, key=lambda f: (means[f], f))
    if incumbent not in means or incumbent == best:
        return best
    sides = [scores.where(F.col("family") == f).select(key, F.col("loss").alias(name)) for f, name in ((incumbent, "held"), (best, "challenger"))]
    gain = F.col("held") - F.col("challenger")
    r = sides[0].join(sides[1], key).agg(F.avg(gain).alias("mean"), (F.stddev_samp(gain) / F.sqrt(F.count("*"))).alias("error")).first()
    return best if r["error"] is not None and r["error"] > 0 and r["mean"] / r["error"] > 1 else incumbent


def scored_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("family").agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))


def menu(n_matches: int) -> list[str]:
    return ["logistic"] + (["boosted"] if n_matches >= GBT_FROM else [])


class Trained(NamedTuple):
    """What serving needs: the model, its calibration, the feature names in order, and how it was chosen."""

    model: PipelineModel
    calibration: tuple[str, object]
    features: list[str]
    family: str
    loss: float


def train(rows: DataFrame, features: Sequence[str], differences: Sequence[str], label: str = "y", families: Sequence[str] | None = None, grid: Sequence[float] = C_GRID) -> Trained:
    """End to end on chronological parts (``part``: train, validation; test rows are never read): the gated menu is
    fitted on mirrored training rows, validation picks one, and it is calibrated on validation."""
    past, held = rows.where("part = 'train'"), rows.where("part = 'validation'")
    mirrored = augment_swapped(past, differences, label)
    fitters = {"logistic": partial(fit_logistic, grid=grid), "boosted": fit_boosted}
    offered = [f for f in menu(past.count()) if families is None or f in families] or ["logistic"]
    fitted = {f: fitters[f](mirrored, held, features, label) for f in offered}
    family = min(fitted, key=lambda f: fitted[f][1])
    model, loss = fitted[family]
    return Trained(model, calibrate(probability(model, held), "p", label), list(features), family, loss)


def calibrated(trained: Trained, rows: DataFrame, out: str = "p") -> DataFrame:
    """Rows with the calibrated probability; only map indicators may be missing from them."""
    scored = probability(trained.model, check_features(rows, trained.features), out)
    return scored.withColumn(out, apply_calibration(F.col(out), trained.calibration))


def version(parameters: dict) -> str:
    """A short hash of parameters that ignores the order of keys."""
    return hashlib.sha1(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:10]


def save(trained: Trained, path: str) -> None:
    """The model with the rest beside it."""
    trained.model.write().overwrite().save(f"{path}/model")
    meta = trained._replace(model=None)._asdict()
    SparkSession.active().createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Trained:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Trained(**meta | {"model": PipelineModel.load(f"{path}/model"), "calibration": tuple(meta["calibration"])})


def check_features(rows: DataFrame, expected: Sequence[str], fill_prefix: str = "map_") -> DataFrame:
    """Rows with exactly the model's features: only map indicators may be missing, and count as 0."""
    missing = [c for c in expected if c not in rows.columns]
    bad = [c for c in missing if not c.startswith(fill_prefix)]
    if bad:
        raise ValueError(f"features the model needs are missing: {bad}")
    return rows.withColumns({c: F.lit(0) for c in missing})


def blend(rows: DataFrame, a: str, b: str, label: str = "y", group: str | None = None, least: int = 200) -> DataFrame:
    """Stacked probability of two predictors, per group with ``least`` rows, else over all."""
    z = rows.withColumn("_a", logit(F.col(a))).withColumn("_b", logit(F.col(b)))

    def coefficients(part: DataFrame) -> tuple[float, float, float]:
        m = LogisticRegression(featuresCol="v", labelCol=label).fit(VectorAssembler(inputCols=["_a", "_b"], outputCol="v").transform(part))
        return float(m.coefficients[0]), float(m.coefficients[1]), float(m.intercept)

    whole = coefficients(z)
    score = lambda c: 1 / (1 + F.exp(-(F.lit(c[0]) * F.col("_a") + F.lit(c[1]) * F.col("_b") + F.lit(c[2]))))
    out = score(whole)
    if group:
        for r in z.groupBy(group).count().where(F.col("count") >= least).collect():
            out = F.when(F.col(group) == r[group], score(coefficients(z.where(F.col(group) == r[group])))).otherwise(out)
    return z.withColumn("p_blend", out).drop("_a", "_b")
