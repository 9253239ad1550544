"""Distance-to-score conversions and metric rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DISTANCES = ("l2", "euclid")        # smaller is better
SIMILARITIES = ("cosine", "dot")    # larger is better
METRICS = DISTANCES + SIMILARITIES

SCORES = ("inverse", "one_minus", "identity")


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")


def distance(metric: str, cost: Column) -> Column:
    """The distance column: what the search minimised, or null for a similarity metric."""
    return cost if metric in DISTANCES else F.lit(None).cast("double")


def score(metric: str, kind: str, cost: Column) -> Column:
    """The score column of a hit, larger is better for every metric but identity on a distance."""
    if kind not in SCORES:
        raise ValueError(f"unknown score {kind!r}; use one of {SCORES}")
    if metric in SIMILARITIES:
        return F.lit(0.0) - cost
    if kind == "inverse":
        return F.lit(1.0) / (F.lit(1.0) + cost)
    if kind == "one_minus":
        return F.lit(1.0) - cost
    return cost
