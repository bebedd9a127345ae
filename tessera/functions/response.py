"""Responses and statistics of distances, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: z of the quartile, 95th and 99th percentile of a normal distribution. Fixed values.
Z25, Z95, Z99 = 0.6745, 1.6449, 2.3263


def mexican_hat(d: Column, excite: float, inhibit: float, strength: float = 0.5) -> Column:
    """From 1 at 0 down to 0 at excite; from -strength back to 0 at inhibit; 0 beyond."""
    around = -strength * (1.0 - (d - excite) / float(inhibit - excite))
    return F.when(d < excite, 1.0 - d / float(excite)).when(d < inhibit, around).otherwise(0.0)


def percentiles(mean: Column, sd: Column) -> dict[str, Column]:
    """Normal approximations of p25, p50, p75, p95, p99."""
    return {
        "p25": F.greatest(mean - Z25 * sd, F.lit(0.0)), "p50": mean, "p75": mean + Z25 * sd, "p95": mean + Z95 * sd,
        "p99": mean + Z99 * sd,
    }


def percentile_hat(d: Column, mean: Column, sd: Column) -> Column:
    p = percentiles(mean, sd)
    return (
        F.when(d < p["p25"], 1.0).when(d < p["p75"], 0.5).when(d < p["p95"], 0.0).when(d < p["p99"], -0.5).otherwise(-1.0)
    )


def wavelet(d: Column, center: float, width: float) -> Column:
    x2 = F.pow((d - center) / width, 2)
    return (1.0 - x2) * F.exp(-x2 / 2.0)


def z_score(d: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (d - mean) / sd).otherwise(0.0)


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution at abs(z), by the five-term polynomial approximation."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(z))
    poly = t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274))))
    return 0.3989423 * F.exp(-z * z / 2.0) * poly


def p_value(z: Column) -> Column:
    return 2.0 * tail(z)


def percentile_rank(z: Column) -> Column:
    return F.when(z >= 0, (1.0 - tail(z)) * 100.0).otherwise(tail(z) * 100.0)


def cohens_d(mean: Column, sd: Column, other_mean: Column, other_sd: Column) -> Column:
    pooled = F.sqrt((sd * sd + other_sd * other_sd) / 2.0)
    return F.when(pooled > 0, F.abs(mean - other_mean) / pooled).otherwise(0.0)


def effect(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def drift(d: Column, mean: Column, sd: Column, width: float) -> Column:
    """struct<loss, ratio, z, significant>: loss beyond the noise floor, distance relative to the mean."""
    z = z_score(d, mean, sd)
    return F.struct(
        (F.greatest(d - 0.004 * sd, F.lit(0.0)) / width).alias("loss"),
        F.when(mean > 0, d / mean).otherwise(0.0).alias("ratio"), z.alias("z"), (F.abs(z) > 2.0).alias("significant"),
    )


def signal_class(mean: Column, sd: Column, d: Column) -> Column:
    return (
        F.when((mean <= 2) & (sd <= 31) & (d <= 2047), "strong")
        .when(mean.between(3, 4) & sd.between(32, 63) & d.between(2048, 4095), "moderate")
        .when((sd >= 48) & d.between(4096, 8191), "weak but stackable")
        .otherwise("noise")
    )


def allen(start, end, other_start, other_end) -> Column:
    """Which of Allen's thirteen relations two intervals are in."""
    return (
        F.when(end < other_start, "before").when(end == other_start, "meets")
        .when(start > other_end, "after").when(start == other_end, "met by")
        .when((start == other_start) & (end == other_end), "equals")
        .when((start == other_start) & (end < other_end), "starts").when(start == other_start, "started by")
        .when((end == other_end) & (start > other_start), "finishes").when(end == other_end, "finished by")
        .when((start > other_start) & (end < other_end), "during").when((start < other_start) & (end > other_end), "contains")
        .when(start < other_start, "overlaps").otherwise("overlapped by")
    )


def decay(x: Column, t: Column, rate: float, form: str = "exponential") -> Column:
    forms = {
        "exponential": x * F.exp(-rate * t), "linear": F.greatest(x * (1.0 - rate * t), F.lit(0.0)),
        "power": x * F.pow(t + 1.0, F.lit(-rate)), "logarithmic": x / (1.0 + rate * F.log1p(t)),
    }
    return forms[form]


def activation(n: Column, seconds: Column, rate: float = 0.5) -> Column:
    """Base-level activation of n uses, the first so many seconds ago."""
    return F.log(n) - rate * F.log(seconds + 1.0)
