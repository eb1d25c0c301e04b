"""Scores, intervals and shrinkage as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CLIP = 1e-6
BUCKET_LOW, BUCKET_HIGH = 0.15, 0.88
BUCKET_EDGES = (0.15, 0.35, 0.50, 0.65, 0.88)
Z95 = 1.96


def rounded(x: Column, places: int = 4) -> Column:
    """Half up by the same operations in every engine."""
    scale = F.lit(float(10**places))
    return F.floor(x * scale + F.lit(0.5)) / scale


def clipped(p: Column, eps: float = CLIP) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def log_loss(p: Column, y: Column) -> Column:
    q = clipped(p)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def right_call(p: Column, y: Column, strict: bool = False) -> Column:
    """1.0 where the favoured side won; even odds favour the first side unless ``strict``."""
    return F.when(((p > 0.5) if strict else (p >= 0.5)) == (y == 1), 1.0).otherwise(0.0)


def published(p: Column) -> Column:
    """Four decimals, never 0 or 1."""
    return F.least(F.greatest(rounded(p), F.lit(1e-4)), F.lit(1 - 1e-4))


def shrunk_rate(success: Column, total: Column, prior: Column, m: float) -> Column:
    """A rate pulled towards ``prior`` with the weight of ``m`` observations; the prior without any."""
    return F.when(total + F.lit(float(m)) > 0, (success + F.lit(float(m)) * prior) / (total + F.lit(float(m)))).otherwise(prior)


def decay(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / F.lit(float(half_life)))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the score interval; 0 and 1 without observations."""
    share, zz = hits / n, F.lit(z * z)
    denominator = 1 + zz / n
    centre = (share + zz / (2 * n)) / denominator
    half = F.lit(z) * F.sqrt(share * (1 - share) / n + zz / (4 * n * n)) / denominator
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def probability_bucket(p: Column) -> Column:
    """Cells closed on the right, with a tail on either side."""
    out = F.when(p < BUCKET_LOW, "extrapolation_low").when(p > BUCKET_HIGH, "extrapolation_high")
    for lo, hi in zip(BUCKET_EDGES, BUCKET_EDGES[1:]):
        out = out.when(p <= hi, f"[{lo:.2f},{hi:.2f}]")
    return out


def expected_score(ra: Column, rb: Column, scale: float = 400.0) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (rb - ra) / F.lit(scale)))


def blended(raw: Column, overall: Column, n: Column, m: float = 10.0) -> Column:
    """A rating on few games, drawn towards the overall one."""
    w = n / (n + F.lit(m))
    return w * raw + (1 - w) * overall
