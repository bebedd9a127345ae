"""Arrays of numbers as vectors: distances, cosine, blends, and the response of eight-part qualia vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUALIA = ("activation", "valence", "tension", "certainty", "agency", "temporality", "sociality", "novelty")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    sizes = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(sizes < 1e-12, 0.0).otherwise(dot(a, b) / sizes)


METRICS = {"cosine": cosine, "dot": dot, "l2": l2}


def vector_similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    return 1.0 / (1.0 + l2(a, b)) if metric == "l2" else METRICS[metric](a, b)


def vector_distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    return {"cosine": lambda: 1.0 - cosine(a, b), "l2": lambda: l2(a, b), "dot": lambda: -dot(a, b)}[metric]()


def blend(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * (1.0 - weight) + y * weight)


def resonance(a: Column, b: Column, excite: float = 0.3, inhibit: float = 0.8) -> Column:
    d = l2(a, b)
    around = -0.5 * (1.0 - (d - excite) / (inhibit - excite))
    return F.when(d < excite, 1.0 - d / excite).when(d < inhibit, around).otherwise(0.0)
