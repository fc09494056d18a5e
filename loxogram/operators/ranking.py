"""Top-k ranking by a blend of distance and text relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.costs import combined_cost
from .boolean import top_k
from .frame import SpatioTextual, postings

ALPHA = 0.5


def relevance(data: SpatioTextual, queries: DataFrame, mode: str = "fast", by_cluster: bool = False) -> DataFrame:
    """(qid, id, ir) of objects with a keyword: fast adds the weights of the matched keywords, precise the
    products with the object's term weights. By cluster: the best of an object's sums per cluster."""
    if mode not in ("fast", "precise"):
        raise ValueError(f"mode must be fast or precise, not {mode!r}")
    gain = F.col("qw") if mode == "fast" else F.col("w") * F.col("qw")
    keys = ["qid", "id", "cluster"] if by_cluster else ["qid", "id"]
    sums = postings(data.weights, queries).join(queries.select("qid", "term", "qw"), "term").groupBy(*keys).agg(F.sum(gain).alias("ir"))
    return sums.groupBy("qid", "id").agg(F.max("ir").alias("ir")) if by_cluster else sums


def scored(data: SpatioTextual, queries: DataFrame, alpha: float = ALPHA, mode: str = "fast") -> DataFrame:
    """(qid, id, ir, dist, cost) of the objects with relevance above 0."""
    places = queries.groupBy("qid").agg(F.first("x").alias("qx"), F.first("y").alias("qy"))
    found = relevance(data, queries, mode).where("ir > 0").join(data.objects, "id").join(places, "qid")
    found = found.withColumn("dist", G.distance(G.point(), G.Point(F.col("qx"), F.col("qy"))))
    return found.select("qid", "id", "ir", "dist", combined_cost(F.col("dist"), F.col("ir"), alpha, data.max_distance).alias("cost"))


def top_ranked(data: SpatioTextual, queries: DataFrame, k: int, alpha: float = ALPHA, mode: str = "fast") -> DataFrame:
    """The k objects of least cost for each query, ties by id."""
    return top_k(scored(data, queries, alpha, mode), ["qid"], [F.round("cost", 9), "id"], k)


def top_ranked_by_distance(data: SpatioTextual, queries: DataFrame, k: int, alpha: float = ALPHA, mode: str = "fast") -> DataFrame:
    """The same objects; rank follows (dist, id), and the relevance is what goes with them."""
    best = top_ranked(data, queries, k, alpha, mode).drop("rank", "cost")
    return top_k(best, ["qid"], [F.round("dist", 9), "id"], k)
