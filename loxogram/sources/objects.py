"""Scans: header-less CSV files of places and keywords, in-memory maps, and the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.frame import SpatioTextual, max_distance

WORLD = (-180.0, -90.0, 180.0, 90.0)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the order within a file is kept by its splits' positions."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"))
    return lines.select("file", F.struct("start", "seq").alias("line"), "value")


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first in the given order."""
    names = [c for c in rows.columns if c not in order and c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return first.select(key, "_row.*")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """objects(id, x, y) from lines ``id,x,y[,...]``: lines of fewer fields or bad numbers go, the first of an id stays."""
    parts = F.split("value", ",")
    number = lambda i, kind: F.trim(F.get(parts, F.lit(i))).try_cast(kind)
    rows = numbered_lines(spark, path).where(F.size(parts) >= 3).select("file", "line", number(0, "long").alias("id"), number(1, "double").alias("x"), number(2, "double").alias("y"))
    return first_wins(rows.where("id is not null and x is not null and y is not null"), "id", ["file", "line"])


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """terms(id, term), a row for each occurrence, from lines ``id,t1,t2,...``: the first line of an id stays."""
    parts = F.split("value", ",")
    rows = numbered_lines(spark, path).select("file", "line", F.trim(F.get(parts, F.lit(0))).try_cast("long").alias("id"), F.expr("slice(split(value, ','), 2, greatest(size(split(value, ',')) - 1, 0))").alias("terms"))
    kept = first_wins(rows.where("id is not null"), "id", ["file", "line"])
    return kept.select("id", F.explode(F.transform("terms", F.trim)).alias("term")).where("term != ''")


def terms_of(spark: SparkSession, documents: dict[int, list]) -> DataFrame:
    """terms(id, term) of a map in memory."""
    return spark.createDataFrame([(i, str(t)) for i, ts in documents.items() for t in ts], "id long, term string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_place(key: Column) -> tuple[Column, Column]:
    """A place in the world's box that follows from the key."""
    x = (key * key * 31 + key * 7919) % 36000 / F.lit(100.0) - 180
    y = (key * key * 17 + key * 104729) % 18000 / F.lit(100.0) - 90
    return x.alias("x"), y.alias("y")


def part_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("id"), *derived_place(key))


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the name, the type and the brand."""
    words = F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.lower("p_brand")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(words).alias("term"))


def document_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(key.alias("id"), *derived_place(key))


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a-z in the lower-cased text."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(words).alias("term"))


def part_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes whose sides follow from the size of the part."""
    o = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *derived_place(F.col("p_partkey")), (F.col("p_size") / F.lit(10.0)).alias("s"))
    return o.select("id", F.col("x").alias("xlo"), F.col("y").alias("ylo"), (F.col("x") + F.col("s")).alias("xhi"), (F.col("y") + F.col("s") / 2).alias("yhi"))


def world(objects: DataFrame, weights: DataFrame) -> SpatioTextual:
    return SpatioTextual(objects, weights, max_distance(*WORLD))


def with_ids(data: SpatioTextual, keep) -> SpatioTextual:
    """The objects whose id passes, with their weights."""
    return SpatioTextual(data.objects.where(keep(F.col("id"))), data.weights.where(keep(F.col("id"))), data.max_distance)


def line_index(rows: DataFrame, order: list[str], parts: int = 200) -> DataFrame:
    """``rows`` with _i, their place from 0 in the given order, of which the first column is numeric.

    Quantiles of that column cut the rows into ranges; each is numbered by itself, and the ranges'
    counts become offsets. The cuts are constants, so a task that runs again numbers alike.
    """
    cuts = rows.agg(F.percentile_approx(order[0], [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order[0]))) if cuts else F.lit(0)
    ranged = rows.withColumn("_p", part)
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    numbered = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    return numbered.join(F.broadcast(offsets), "_p").withColumn("_i", F.col("_k") + F.col("_off")).drop("_p", "_k", "_off")
