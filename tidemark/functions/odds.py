"""Prices and probabilities. Prices are decimal odds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Fixed values of the stake rule.
KELLY, NOTIONAL, EV_CLIP, STAKE_CAP = 0.25, 100.0, 0.10, 3.0


def is_price(p: Column) -> Column:
    """Finite and above 1. NaN and infinity compare as larger than any number, so both are named."""
    return F.coalesce((p > 1) & (p < float("inf")) & ~F.isnan(p), F.lit(False))


def priceable(home: Column, away: Column) -> Column:
    return is_price(home) & is_price(away)


def american_to_decimal(a: Column) -> Column:
    return F.when(a >= 100, 1.0 + a / 100.0).when(a <= -100, 1.0 + 100.0 / -a)


def price_to_decimal(v: Column) -> Column:
    """American prices, and decimal ones where the value cannot be American."""
    return F.when((v > 1) & (v < 100), v).otherwise(american_to_decimal(v))


def implied(p: Column) -> Column:
    return F.when(is_price(p), 1.0 / p)


def overround(a: Column, b: Column) -> Column:
    return implied(a) + implied(b) - 1


def multiplicative(a: Column, b: Column) -> Column:
    return implied(a) / (implied(a) + implied(b))


def shin(a: Column, b: Column) -> Column:
    """Fair probability of the first of two outcomes. For two outcomes the insider model's solution is
    the implied probability less half the margin; without a margin it is the proportional share."""
    qa, qb = implied(a), implied(b)
    return F.when(qa + qb <= 1 + 1e-12, qa / (qa + qb)).otherwise(qa - (qa + qb - 1) / 2)


def devig(a: Column, b: Column) -> Column:
    return F.struct(implied(a).alias("implied"), overround(a, b).alias("overround"), shin(a, b).alias("shin"), multiplicative(a, b).alias("multiplicative"))


@F.pandas_udf(ArrayType(DoubleType()))
def shin_many(prices: pd.Series) -> pd.Series:
    """The insider model for any number of outcomes. The share z of insiders is a fixed point: fair chances sum to one where
    z = (sum of sqrt(z * z + 4 * (1 - z) * q * q / book) - 2) / (n - 2), which is iterated from 0; two outcomes have the
    closed form of ``shin``, and one is certain."""

    def solve(odds: np.ndarray | None) -> list[float] | None:
        if odds is None or len(odds) == 0 or not np.all(np.isfinite(odds)) or np.any(odds <= 1):
            return None
        q = 1 / np.asarray(odds, dtype=float)
        n, book = len(q), q.sum()
        if n == 1:
            return [1.0]
        if book <= 1 + 1e-12:
            return (q / book).tolist()
        if n == 2:
            return (q - (book - 1) / 2).tolist()
        root = lambda z: np.sqrt(z * z + 4 * (1 - z) * q * q / book)
        z = 0.0
        for _ in range(1000):
            z, before = (root(z).sum() - 2) / (n - 2), z
            if abs(z - before) < 1e-13:
                break
        return ((root(z) - z) / (2 * (1 - z))).tolist()

    return prices.map(solve)


def stake_units(ev: Column, price: Column) -> Column:
    """A quarter of the Kelly stake on a clipped edge, capped; nothing without an edge or a price."""
    raw = F.lit(KELLY * NOTIONAL) * F.least(ev, F.lit(EV_CLIP)) / (price - 1)
    return F.when((price > 1) & (ev > 0), F.least(raw, F.lit(STAKE_CAP))).otherwise(0.0)


def over_probability(distribution: Column, line: Column) -> Column:
    """Mass strictly above ``line`` of a map from counts (as text) to probabilities."""
    above = F.map_values(F.map_filter(distribution, lambda k, _: k.cast("double") > line))
    return F.aggregate(above, F.lit(0.0), lambda s, x: s + x)
