"""The blend of distance and text relevance, and the bounds that follow from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def combined_cost(dist: Column, relevance: Column, alpha: float, max_distance: float) -> Column:
    """alpha * dist / max_distance + (1 - alpha) * (1 - relevance); lower is better, and nothing is clamped.

    Without a positive max_distance only the text counts.
    """
    if not max_distance > 0:
        return 1 - relevance
    return F.lit(float(alpha)) * (dist / F.lit(float(max_distance))) + F.lit(1.0 - alpha) * (1 - relevance)


def relevance_floor(cost: float, alpha: float) -> float:
    """The relevance that a pair of at most this cost must reach, within 0 and 1."""
    return 0.0 if alpha >= 1 else min(1.0, max(0.0, 1 - cost / (1 - alpha)))


def distance_ceiling(cost: float, alpha: float, max_distance: float, best: float = 1.0) -> float:
    """The distance that a pair of at most this cost can have, if relevance is at most ``best``."""
    if alpha <= 0 or not max_distance > 0:
        return float("inf")
    return max(0.0, (cost - (1 - alpha) * (1 - best)) * max_distance / alpha)


def set_distance(a: Column, b: Column) -> Column:
    """Jaccard distance of two arrays as sets: both empty 0, one empty 1."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / both)
