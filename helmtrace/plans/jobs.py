"""The nine second-stage jobs, as named result tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from helmtrace.operators import anomalies as A
from helmtrace.operators import layers as L
from helmtrace.operators import vessels as V

Job = Callable[[DataFrame, DataFrame], dict[str, DataFrame]]


def _summary(pings: DataFrame, anomalies: DataFrame) -> dict[str, DataFrame]:
    return {
        "overview": V.summary_overview(pings),
        "anomalies": A.anomaly_overview(anomalies),
        "vessel_types": V.top_vessel_types(pings),
        "top_vessels": A.top_vessels(anomalies),
        "top_vessels_by_type": A.top_per_type(anomalies),
        "repeat_vessels": V.multi_anomaly_vessels(pings, anomalies),
    }


def _statistics(pings: DataFrame, anomalies: DataFrame) -> dict[str, DataFrame]:
    stats = V.vessel_stats(pings, anomalies)
    return {"vessels": stats, "summary": V.vessel_stats_summary(stats)}


def _temporal(pings: DataFrame, anomalies: DataFrame) -> dict[str, DataFrame]:
    return {
        "hours": A.hourly_distribution(anomalies),
        "days": A.daily_distribution(anomalies),
        "weekdays": A.weekday_distribution(anomalies),
        "hours_by_type": A.hour_type_crosstab(anomalies),
    }


# Job names.
JOBS: dict[str, Job] = {
    "export-full-dataset": lambda p, a: {"pings": p},
    "summary-report": _summary,
    "vessel-statistics": _statistics,
    "anomaly-timeline": lambda p, a: {"timeline": A.anomaly_timeline(a)},
    "temporal-patterns": _temporal,
    "vessel-clustering": lambda p, a: {"clusters": V.cluster_vessels(p)},
    "anomaly-frequency": lambda p, a: {"frequency": A.anomaly_frequency(a)},
    "full-spectrum-map": lambda p, a: {"heat": L.heat_grid(p), "pins": L.anomaly_pins(a, p)},
    "vessel-map": lambda p, a: {"paths": L.vessel_paths(p), "points": L.path_points(p)},
}


def run_job(name: str, pings: DataFrame, anomalies: DataFrame) -> dict[str, DataFrame]:
    """Result tables of a job; nothing runs until one of them is used."""
    return JOBS[name](pings, anomalies)
