"""Boolean spatial-keyword queries: all keywords must occur; then a radius, or the nearest k.

Queries come as (qid, weight, x, y, term, qw), any number of them in one pass: matching is one equi-join
on the term, and only objects that match go on to the join with the places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .frame import SpatioTextual, postings


def match_counts(data: SpatioTextual, queries: DataFrame) -> DataFrame:
    """(qid, id, matched): distinct query keywords that an object has, where there are any."""
    keywords = queries.select("qid", "term").distinct()
    return postings(data.weights, queries).select("id", "term").join(keywords, "term").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("matched"))


def matching(data: SpatioTextual, queries: DataFrame) -> DataFrame:
    """(qid, id, dist) of objects that have every keyword. A query without keywords has no rows, hence no matches."""
    need = queries.groupBy("qid").agg(F.countDistinct("term").alias("need"), F.first("x").alias("qx"), F.first("y").alias("qy"))
    full = match_counts(data, queries).join(need, "qid").where("matched = need")
    dist = G.distance(G.point(), G.Point(F.col("qx"), F.col("qy")))
    return full.join(data.objects, "id").select("qid", "id", dist.alias("dist"))


def range_query(data: SpatioTextual, queries: DataFrame, radius: float) -> DataFrame:
    """Matches at most ``radius`` away; a negative radius has none. Readers sort by (dist, id)."""
    return matching(data, queries).where(F.col("dist") <= F.lit(float(radius)) if radius >= 0 else F.lit(False))


def top_k(rows: DataFrame, per: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of each group; the window's limit is applied before the shuffle as well."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order)).cast("int"))
    return ranked.where(F.col("rank") <= max(0, k))


def nearest_matching(data: SpatioTextual, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest matches of each query, ties by id; k <= 0 has none."""
    return top_k(matching(data, queries), ["qid"], [F.round("dist", 9), "id"], k)
