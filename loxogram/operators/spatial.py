"""Spatial queries over boxes ``regions(id, xlo, ylo, xhi, yhi)`` and points ``objects(id, x, y)``."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def containment(regions: DataFrame, window: G.Box) -> DataFrame:
    return regions.where(G.contains(window, G.box()))


def intersection(regions: DataFrame, window: G.Box) -> DataFrame:
    return regions.where(G.intersects(window, G.box()))


def point_location(regions: DataFrame, p: G.Point) -> DataFrame:
    return regions.where(G.intersects(G.point_box(p), G.box()))


def nearest(regions: DataFrame, target: G.Box, k: int, cost: Callable[[G.Box, G.Box], Column] = G.min_distance, digits: int = 9) -> DataFrame:
    """The k nearest and whatever ties with the k-th; ``cost`` may be any function of two boxes.

    The k-th distance comes from a bounded sort; one more pass keeps what is as near.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    near = regions.withColumn("dist", F.round(cost(target, G.box()), digits))
    edge = near.select("dist").orderBy("dist").limit(k).agg(F.max("dist").alias("edge"))
    return near.join(F.broadcast(edge), F.col("dist") <= F.col("edge")).drop("edge")


def _cells(df: DataFrame, b: G.Box, size: float) -> DataFrame:
    """A row for each grid cell that the box meets."""
    at = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    return df.withColumn("_cx", F.explode(at(b.xlo, b.xhi))).withColumn("_cy", F.explode(at(b.ylo, b.yhi)))


def _pairs(regions: DataFrame, reach: float, size: float) -> DataFrame:
    """Pairs id1 < id2 of boxes that come within ``reach`` of one another's grid cells, each pair once.

    The first is widened by the reach. A pair meets in every cell that both cover; it counts in the one
    that holds the lower corner of what they have in common.
    """
    a = regions.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "xlo", "ylo", "xhi", "yhi")])
    b = regions.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "xlo", "ylo", "xhi", "yhi")])
    wide = G.expand(G.box("a_"), reach)
    met = _cells(a, wide, size).join(_cells(b, G.box("b_"), size), ["_cx", "_cy"]).where("a_id < b_id")
    corner = (F.floor(F.greatest(wide.xlo, F.col("b_xlo")) / size) == F.col("_cx")) & (F.floor(F.greatest(wide.ylo, F.col("b_ylo")) / size) == F.col("_cy"))
    return met.where(corner).drop("_cx", "_cy")


def grid_size(regions: DataFrame, reach: float = 0.0) -> float:
    """A cell about as large as the mean box plus the reach (one aggregate), so that a box meets few cells."""
    row = regions.agg(F.avg(G.longest_side(G.box())), F.max(F.abs(F.col("xhi"))), F.max(F.abs(F.col("yhi")))).first()
    return max(2 * (row[0] or 0.0) + 2 * reach, max(row[1] or 1.0, row[2] or 1.0) * 1e-4, 1e-9)


def self_join_intersection(regions: DataFrame, window: G.Box, size: float | None = None) -> DataFrame:
    """(id1, id2): pairs that intersect each other and the window in common."""
    inside = intersection(regions, window)
    pairs = _pairs(inside, 2 * G.EPSILON, size or grid_size(regions))
    a, b = G.box("a_"), G.box("b_")
    meet = G.Box(F.greatest(a.xlo, b.xlo), F.greatest(a.ylo, b.ylo), F.least(a.xhi, b.xhi), F.least(a.yhi, b.yhi))
    return pairs.where(G.intersects(a, b) & G.intersects(meet, window)).select(F.col("a_id").alias("id1"), F.col("b_id").alias("id2"))


def self_join_distance(regions: DataFrame, window: G.Box, reach: float, size: float | None = None) -> DataFrame:
    """(id1, id2, dist): pairs at most ``reach`` apart, both as near to the window."""
    close = regions.where(G.min_distance(window, G.box()) <= reach)
    dist = G.min_distance(G.box("a_"), G.box("b_"))
    pairs = _pairs(close, reach * (1 + 1e-12) + 1e-9, size or grid_size(regions, reach))
    return pairs.where(dist <= reach).select(F.col("a_id").alias("id1"), F.col("b_id").alias("id2"), dist.alias("dist"))


def insert(regions: DataFrame, more: DataFrame) -> DataFrame:
    return regions.unionByName(more)


def delete(regions: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows that equal one of ``gone`` in id and box go."""
    return regions.join(gone, ["id", "xlo", "ylo", "xhi", "yhi"], "left_anti")


#: Ids in one row of gathered points; more at a place go on in further rows.
GATHERED = 1024
#: Tiles of the nested plan on either axis.
TILES = 64


def gathered(points: DataFrame, *more: str) -> DataFrame:
    """(x, y, *more, ids, key): a row for the points of a place that agree in ``more``, or several of ``GATHERED`` ids each; key is the least."""
    same = Window.partitionBy("x", "y", *more).orderBy("id")
    rows = points.select("id", "x", "y", *more).withColumn("_block", F.floor((F.row_number().over(same) - 1) / GATHERED))
    return rows.groupBy("x", "y", *more, "_block").agg(F.collect_list("id").alias("ids"), F.min("id").alias("key")).drop("_block")


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*[F.col(c).alias(f"{c}{i}") for c in rows.columns]) for i, rows in ((1, left), (2, right)))


def _near(met: DataFrame, reach: float, self_join: bool) -> DataFrame:
    dist = G.distance(G.Point(F.col("x1"), F.col("y1")), G.Point(F.col("x2"), F.col("y2")))
    met = met.where(F.col("key1") <= F.col("key2")) if self_join else met
    return met.withColumn("dist", dist).where(F.col("dist") <= reach)


def place_pairs(left: DataFrame, right: DataFrame, reach: float, self_join: bool) -> DataFrame:
    """Gathered rows at most ``reach`` apart, all columns of the left with 1 and of the right with 2 at their names, by a grid of that cell size.

    Each right row is dealt to its cell and the eight around it, so a left one finds all partners in its own
    cell and each pair once. A reach of 0 joins equal places. The nine-fold side is never broadcast (its size is
    estimated from one column of a packed file); adaptive execution splits the cells that hold most.
    """
    a, b = _sides(left, right)
    if reach < 0 or math.isnan(reach):
        return _near(a.crossJoin(b.limit(0)), 0.0, self_join)
    if reach == 0:
        return _near(a.hint("merge").join(b, (F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))), reach, self_join)
    size = reach * (1 + 1e-9)
    around = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    near = b.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    near = near.select(*b.columns, (F.floor(F.col("x2") / size) + F.col("_dx")).alias("_cx"), (F.floor(F.col("y2") / size) + F.col("_dy")).alias("_cy"))
    cells = a.withColumns({"_cx": F.floor(F.col("x1") / size), "_cy": F.floor(F.col("y1") / size)})
    return _near(cells.hint("merge").join(near, ["_cx", "_cy"]), reach, self_join)


def nested_place_pairs(left: DataFrame, right: DataFrame, reach: float, self_join: bool) -> DataFrame:
    """The same by nested loops: over all pairs of tiles, then over all pairs of rows of two tiles whose boxes come within reach."""
    a, b = _sides(left, right)
    row = left.select("x", "y").unionByName(right.select("x", "y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    x0, y0, x1, y1 = (float(v or 0.0) for v in row)
    at = lambda v, lo, hi: F.least(F.floor((F.col(v) - lo) / max((hi - lo) / TILES, 1e-12)), F.lit(TILES - 1))
    a, b = (rows.withColumn(f"t{i}", at(f"x{i}", x0, x1) * TILES + at(f"y{i}", y0, y1)) for i, rows in ((1, a), (2, b)))
    boxes = lambda rows, i: rows.groupBy(f"t{i}").agg(*[c.alias(f"{n}{i}") for n, c in zip(("xlo", "ylo", "xhi", "yhi"), (F.min(f"x{i}"), F.min(f"y{i}"), F.max(f"x{i}"), F.max(f"y{i}")), strict=True)])
    corners = lambda i: G.Box(*(F.col(f"{n}{i}") for n in ("xlo", "ylo", "xhi", "yhi")))
    # at most TILES * TILES rows on either side
    tiles = boxes(a, 1).crossJoin(F.broadcast(boxes(b, 2))).where(G.min_distance(corners(1), corners(2)) <= reach * (1 + 1e-9) + 1e-9).select("t1", "t2")
    return _near(a.hint("merge").join(tiles, "t1").hint("merge").join(b, "t2"), reach, self_join).drop("t1", "t2")


def spread(pairs: DataFrame, self_join: bool, *keep: str) -> DataFrame:
    """(id1, id2, *keep): the pairs of ids of gathered rows; in a self-join each once, the smaller id first."""
    each = pairs.select("ids2", "key1", "key2", *keep, F.explode("ids1").alias("_i")).select("key1", "key2", *keep, "_i", F.explode("ids2").alias("_j"))
    if not self_join:
        return each.select(F.col("_i").alias("id1"), F.col("_j").alias("id2"), *keep)
    each = each.where("key1 != key2 or _i < _j")
    return each.select(F.least("_i", "_j").alias("id1"), F.greatest("_i", "_j").alias("id2"), *keep)


def point_pairs(left: DataFrame, right: DataFrame, reach: float, self_join: bool) -> DataFrame:
    """(id1, id2, dist) of points at most ``reach`` apart; points of one place are compared as one."""
    a = gathered(left)
    return spread(place_pairs(a, a if self_join else gathered(right), reach, self_join), self_join, "dist")


def nested_point_pairs(left: DataFrame, right: DataFrame, reach: float, self_join: bool) -> DataFrame:
    """The same by nested loops: the plan to hold the grid against."""
    a = gathered(left)
    return spread(nested_place_pairs(a, a if self_join else gathered(right), reach, self_join), self_join, "dist")


def partition_quality(rows: DataFrame, columns: int, tiles: int, layout: str = "sort") -> DataFrame:
    """Quality of a two-level layout of points or boxes, a row for each tile: entries, area and margin of its bounding box, the
    area that it shares with the other tiles of its slice, and whether the slice's box fails to contain it.

    ``sort`` cuts slices of about as many entries (and tiles within them), ``grid`` cuts the extent evenly; boxes go by their centres.
    """
    b = G.box() if "xlo" in rows.columns else G.point_box(G.point())
    middle = G.center(b)
    rows = rows.select(middle.x.alias("x"), middle.y.alias("y"), *[v.alias(c) for c, v in zip(("xlo", "ylo", "xhi", "yhi"), b, strict=True)])
    if layout == "grid":
        ends = rows.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
        at = lambda v, lo, hi, n: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * n), F.lit(n - 1))).otherwise(0).cast("int")
        tiled = rows.crossJoin(F.broadcast(ends)).withColumns({"tile_x": at("x", "_x0", "_x1", columns), "tile_y": at("y", "_y0", "_y1", tiles)})
    elif layout == "sort":
        cut = rows.select(F.percentile_approx("x", [i / columns for i in range(1, columns)], 10_000).alias("q"))
        sliced = rows.crossJoin(F.broadcast(cut)).withColumn("tile_x", F.size(F.filter("q", lambda v: v < F.col("x")))).drop("q")
        cuts = sliced.groupBy("tile_x").agg(F.percentile_approx("y", [i / tiles for i in range(1, tiles)], 10_000).alias("q"))
        tiled = sliced.join(F.broadcast(cuts), "tile_x").withColumn("tile_y", F.size(F.filter("q", lambda v: v < F.col("y"))))
    else:
        raise ValueError(f"layout must be sort or grid, not {layout!r}")
    boxes = tiled.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"), *G.bounding_box(G.box()))
    corners = ("xlo", "ylo", "xhi", "yhi")
    # at most ``columns`` x ``tiles`` rows from here on
    siblings = boxes.select("tile_x", F.col("tile_y").alias("_other"), *[F.col(c).alias(f"o_{c}") for c in corners])
    common = G.intersection_area(G.box(), G.box("o_"))
    overlap = boxes.join(siblings, "tile_x").where("tile_y != _other").groupBy("tile_x", "tile_y").agg(F.sum(common).alias("overlap"))
    slices = boxes.groupBy("tile_x").agg(F.min("xlo").alias("p_xlo"), F.min("ylo").alias("p_ylo"), F.max("xhi").alias("p_xhi"), F.max("yhi").alias("p_yhi"))
    out = boxes.join(overlap, ["tile_x", "tile_y"], "left").join(slices, "tile_x")
    return out.select(
        "tile_x", "tile_y", "n", *corners, G.area(G.box()).alias("area"), G.margin(G.box()).alias("margin"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"), (~G.contains(G.box("p_"), G.box())).alias("violation")
    )


def quality_summary(tiles: DataFrame) -> DataFrame:
    """One row: tiles, entries, total area, total overlap (each pair once) and containment violations."""
    return tiles.agg(
        F.count(F.lit(1)).alias("tiles"), F.sum("n").alias("entries"), F.sum("area").alias("area"), (F.sum("overlap") / 2).alias("overlap"), F.sum(F.col("violation").cast("long")).alias("violations")
    )
