"""Checks and repairs of a data set in two tables, and what its collection looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .objects import line_index


def validate(places: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row: line counts, repeated ids, and ids that only one side has. ``places(id)``, ``keywords(id)``, a row per line."""
    count = lambda df, name: df.groupBy("id").agg(F.count(F.lit(1)).alias(name))
    both = count(places, "p").join(count(keywords, "k"), "id", "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = both.agg(
        total("p").alias("place_lines"),
        total("k").alias("keyword_lines"),
        total(F.coalesce(F.col("p") - 1, F.lit(0))).alias("repeated_places"),
        total(F.coalesce(F.col("k") - 1, F.lit(0))).alias("repeated_keywords"),
        total(F.col("k").isNull().cast("int")).alias("only_places"),
        total(F.col("p").isNull().cast("int")).alias("only_keywords"),
    )
    good = (F.col("place_lines") == F.col("keyword_lines")) & (F.col("repeated_places") + F.col("repeated_keywords") + F.col("only_places") + F.col("only_keywords") == 0)
    return out.withColumn("valid", good)


def repair(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with new_id: the first row of an id keeps it, later ones get the ids after the largest, in order.

    The repeated rows are numbered in ranges of ``order``, a numeric column. The rows of one id are told
    apart by their place against its least one, which is an aggregate.
    """
    first = rows.groupBy("id").agg(F.min(order).alias("_first"))
    seen = rows.join(first, "id")
    again = line_index(seen.where(F.col(order) > F.col("_first")), [order, "id"])
    top = rows.agg(F.max("id").alias("_top"))
    again = again.crossJoin(F.broadcast(top)).withColumn("new_id", F.col("_top") + F.col("_i") + 1).drop("_i", "_top")
    kept = seen.where(F.col(order) == F.col("_first")).withColumn("new_id", F.col("id"))
    return kept.unionByName(again).drop("_first")


def extent(objects: DataFrame) -> DataFrame:
    return objects.agg(*G.bounding_box(G.point_box(G.point())), F.count(F.lit(1)).alias("n"))


def dense_regions(objects: DataFrame, side: int = 20, top: int = 10) -> DataFrame:
    """The fullest cells of a side x side grid over the extent: cell, centre and count, ties by cell."""
    box = extent(objects).drop("n")
    step = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(v) - F.col(lo)) / ((F.col(hi) - F.col(lo)) / side)), F.lit(side - 1))).otherwise(0).cast("int")
    cells = objects.crossJoin(F.broadcast(box)).withColumns({"cx": step("x", "xlo", "xhi"), "cy": step("y", "ylo", "yhi")})
    full = cells.groupBy("cx", "cy", "xlo", "ylo", "xhi", "yhi").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cx", "cy").limit(top)
    middle = lambda c, lo, hi: F.col(lo) + (F.col(c) + 0.5) * (F.col(hi) - F.col(lo)) / side
    return full.select("cx", "cy", middle("cx", "xlo", "xhi").alias("x"), middle("cy", "ylo", "yhi").alias("y"), "n")


def grid_cells(objects: DataFrame, size: float) -> DataFrame:
    """(id, cell): the grid cell of each object, as text."""
    return objects.select("id", F.concat_ws(":", F.floor(F.col("x") / size), F.floor(F.col("y") / size)).alias("cell"))
