"""Circular statistics and trend expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helmtrace.functions.geo import col


def circular_aggregates(angle, prefix: str) -> list[Column]:
    """Aggregates ``<prefix>_sin``/``<prefix>_cos`` that ``circular_columns`` turns into statistics."""
    turn = F.radians(col(angle))
    return [F.avg(F.sin(turn)).alias(f"{prefix}_sin"), F.avg(F.cos(turn)).alias(f"{prefix}_cos")]


def circular_columns(prefix: str, sin_col=None, cos_col=None) -> list[Column]:
    """Mean in [0, 360), variance, consistency and standard deviation (degrees)."""
    s = col(sin_col or f"{prefix}_sin")
    c = col(cos_col or f"{prefix}_cos")
    mean = F.degrees(F.atan2(s, c))
    length = F.sqrt(s * s + c * c)
    return [
        F.when(mean < 0, mean + 360).otherwise(mean).alias(f"{prefix}_mean"),
        (1 - length).alias(f"{prefix}_variance"),
        length.alias(f"{prefix}_consistency"),
        F.when(length > 0, F.degrees(F.sqrt(F.greatest(F.log(length) * -2, F.lit(0.0)))))
        .when(length == 0, F.lit(float("inf")))
        .alias(f"{prefix}_std"),
    ]


# Z-scores by confidence level.
Z_SCORES = {0.68: 1.0, 0.90: 1.645, 0.95: 2.0, 0.99: 2.576}


def z_score(confidence) -> Column:
    """Table value where there is one, else the line through the 68 % and 95 % levels."""
    level = col(confidence)
    out = None
    for key, z in Z_SCORES.items():
        out = F.when(level == key, F.lit(z)) if out is None else out.when(level == key, F.lit(z))
    return out.otherwise((level - 0.68) / (0.95 - 0.68) + 1.0)


def confidence_interval(mean, std, confidence=0.68) -> Column:
    half = z_score(confidence) * col(std)
    return F.struct((col(mean) - half).alias("lower"), (col(mean) + half).alias("upper"))
