"""Clustering of weighted documents by the angle between their vectors, on rows (id, term, w).

Centres are rows (cluster, term, w) as well, so that neither the vocabulary nor a centre is ever one value.
Each round is an equi-join on the term and two aggregations; its assignment is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import checkpointed

INITS = ("k-means++", "random")


def _draw(seed: int, *keys) -> Column:
    """A uniform number in (0, 1) that follows from the seed and the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _norms(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def _cosines(weights: DataFrame, norms: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster, cos) of documents and centres that share a term."""
    c = centres.select("cluster", "term", F.col("w").alias("_c")).join(_norms(centres, "cluster").withColumnRenamed("norm", "_n"), "cluster")
    dots = weights.join(c, "term").groupBy("id", "cluster").agg(F.sum(F.col("w") * F.col("_c")).alias("dot"), F.max("_n").alias("_n"))
    whole = F.col("norm") * F.col("_n")
    return dots.join(norms, "id").select("id", "cluster", F.when(whole > 0, F.col("dot") / whole).otherwise(0.0).alias("cos"))


def assign(weights: DataFrame, norms: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster): the centre of the greatest cosine, ties and documents that share no term with any go to the lowest."""
    best = _cosines(weights, norms, centres).groupBy("id").agg(F.max(F.struct(F.round("cos", 12).alias("r"), (-F.col("cluster")).alias("k"))).alias("b"))
    placed = norms.select("id").join(best, "id", "left")
    return placed.select("id", F.when(F.col("b.r") > 0, -F.col("b.k")).otherwise(0).cast("int").alias("cluster"))


def _pick(norms: DataFrame, seed: int, n: int, *more) -> list:
    """Ids of n documents drawn at random."""
    return [r["id"] for r in norms.orderBy(_draw(seed, F.col("id"), *more), "id").limit(n).collect()]


def start_plus_plus(weights: DataFrame, norms: DataFrame, k: int, seed: int) -> list:
    """Ids of k starting documents: each drawn with a weight of the squared cosine distance to the nearest one before.

    A weighted draw takes the least of -log(u) / weight, so that it needs no running sum.
    """
    ids = _pick(norms, seed, 1)
    near = checkpointed(norms.select("id", F.lit(1.0).alias("d2")))
    for i in range(1, k):
        centre = weights.where(F.col("id") == ids[-1]).select(F.lit(0).alias("cluster"), "term", "w")
        far = _cosines(weights, norms, centre).select("id", F.greatest(1 - F.col("cos"), F.lit(0.0)).alias("d"))
        now = near.join(far, "id", "left").select("id", F.least("d2", F.coalesce(F.col("d") * F.col("d"), F.lit(1.0))).alias("d2"))
        near = checkpointed(now.where(F.col("id") != ids[-1]))
        u = _draw(seed, F.lit(i), F.col("id"))
        # documents at distance 0 are drawn only where there are no others
        race = F.when(F.col("d2") > 1e-18, -F.log(u) / F.col("d2")).otherwise(1e300 * u)
        ids.append(near.orderBy(race, "id").select("id").first()["id"])
    return ids


def centres_of(weights: DataFrame, ids: list) -> DataFrame:
    """The documents of these ids as centres, numbered in order."""
    numbers = weights.sparkSession.createDataFrame(list(enumerate(ids)), "cluster int, id long")
    return numbers.join(weights, "id").select("cluster", "term", "w")


def means(weights: DataFrame, placed: DataFrame) -> DataFrame:
    """(cluster, term, w): the mean of the raw vectors of each cluster."""
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sums = weights.join(placed, "id").groupBy("cluster", "term").agg(F.sum("w").alias("s"))
    return sums.join(F.broadcast(sizes), "cluster").select("cluster", "term", (F.col("s") / F.col("n")).alias("w"))  # k rows


def spherical_kmeans(weights: DataFrame, k: int, seed: int = 1, iterations: int = 300, init: str = "k-means++", max_moves: int = 0) -> DataFrame:
    """(id, cluster): documents go to the centre of the greatest cosine, centres to the mean of their raw vectors.

    It ends when at most ``max_moves`` documents change their cluster, or after so many iterations. A centre
    without documents starts anew from a random one. Empty input and k above the number of documents raise.
    """
    if init not in INITS:
        raise ValueError(f"init must be one of {INITS}, not {init!r}")
    weights = weights.select("id", "term", "w").groupBy("id", "term").agg(F.sum("w").alias("w"))
    norms = checkpointed(_norms(weights, "id"))
    n = norms.count()
    if n == 0 or not 1 <= k <= n:
        raise ValueError(f"k = {k} does not fit {n} documents")
    ids = start_plus_plus(weights, norms, k, seed) if init == "k-means++" else _pick(norms, seed, k)
    centres = centres_of(weights, ids)
    placed = checkpointed(assign(weights, norms, centres))
    for i in range(iterations):
        centres = means(weights, placed)
        filled = {r["cluster"] for r in placed.select("cluster").distinct().collect()}  # at most k
        lost = [c for c in range(k) if c not in filled]
        if lost:
            numbers = weights.sparkSession.createDataFrame(list(zip(lost, _pick(norms, seed, len(lost), F.lit(-1 - i)), strict=True)), "cluster int, id long")
            centres = centres.unionByName(numbers.join(weights, "id").select("cluster", "term", "w"))
        now = checkpointed(assign(weights, norms, checkpointed(centres)))
        moves = now.join(placed.withColumnRenamed("cluster", "_old"), "id").where("cluster != _old").count()
        placed = now
        if moves <= max_moves:
            break
    return placed
