"""Samplers over rows in a given order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .objects import line_index


def target_size(n: int, share: float) -> int:
    """Rows to keep: the share rounded up; shares of 1 and more keep all."""
    return n if share >= 1 else math.ceil(n * share)


def systematic(rows: DataFrame, order: list[str], share: float) -> DataFrame:
    """Every row at which floor((i + 1) * m / n) grows, so that m of n rows are kept evenly."""
    n = rows.count()
    m = target_size(n, share)
    kept = F.expr(f"((_i + 1) * {m}L) div {max(n, 1)}L > (_i * {m}L) div {max(n, 1)}L")
    return line_index(rows, order).where(kept).drop("_i")


def contiguous(rows: DataFrame, order: list[str], share: float, start: int) -> DataFrame:
    """m rows in sequence from ``start``, which is held within 0 and n - m."""
    n = rows.count()
    m = target_size(n, share)
    first = min(max(0, start), n - m)
    return line_index(rows, order).where(F.col("_i").between(first, first + m - 1)).drop("_i")


def randomised(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Each row with probability ``share``, decided by a seeded hash of its key: the same rows on any layout."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))
