"""Term statistics and term weights of a collection.

Input is ``terms(id, term)``, one row for each occurrence. Everything is an aggregation on (id, term), id or
term. Weights deal the occurrences to partitions by id once, which serves the frequencies, the document's own
figures and its largest weight. Collection-wide scalars come from one-row aggregates that are cross-joined
in, which broadcasts a single row.

``store`` writes weights in the order of terms, so that a query reads the row groups of its keywords alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SMOOTHING = 0.2


def term_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("f"))


def document_frequency(terms: DataFrame) -> DataFrame:
    return term_frequency(terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def collection_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


def max_frequency(terms: DataFrame) -> DataFrame:
    return term_frequency(terms).groupBy("id").agg(F.max("f").alias("max_f"))


def _with_statistics(terms: DataFrame, documents: DataFrame | None) -> DataFrame:
    """(id, term, f, max_f, len, df, cf, n): ``documents(id)`` also counts documents without terms."""
    tf = term_frequency(terms.repartition("id"))
    by_term = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("f").alias("cf"))
    n = (documents if documents is not None else terms).agg(F.countDistinct("id").alias("n"))
    own = Window.partitionBy("id")
    own_figures = tf.withColumns({"max_f": F.max("f").over(own), "len": F.sum("f").over(own)})
    return own_figures.join(by_term, "term").crossJoin(F.broadcast(n))


def tfidf(terms: DataFrame, smoothing: float = 0.0, documents: DataFrame | None = None) -> DataFrame:
    """weights(id, term, w), w in [0.1, 1]: damped tf times idf, optionally mixed with the collection's
    frequency, then scaled by the document's largest and put through a square root."""
    s = _with_statistics(terms, documents)
    tf = F.lit(0.1) + F.lit(0.9) * F.col("f") / F.col("max_f")
    raw = tf * (1 + F.log(F.col("n") / F.col("df"))) * (1 + F.log(1 + F.col("f")))
    if smoothing > 0:
        raw = F.lit(1 - smoothing) * raw + F.lit(smoothing) * F.col("cf") / (F.col("n") * F.col("len"))
    s = s.select("id", "term", raw.alias("raw"))
    return s.select("id", "term", (F.lit(0.1) + F.lit(0.9) * F.sqrt(F.col("raw") / F.max("raw").over(Window.partitionBy("id")))).alias("w"))


def language_model(terms: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """weights(id, term, w): the smoothed probability of the term, to the power of its frequency."""
    s = _with_statistics(terms, None).crossJoin(F.broadcast(terms.agg(F.count(F.lit(1)).alias("total"))))
    p = F.lit(1 - smoothing) * F.col("f") / F.col("len") + F.lit(smoothing) * F.col("cf") / F.col("total")
    return s.select("id", "term", F.pow(p, F.col("f")).alias("w"))


def keyword_summary(terms: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent terms with rank, the number of occurrences and of distinct terms."""
    totals = terms.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("term").alias("vocabulary"))
    best = collection_frequency(terms).orderBy(F.desc("cf"), "term").limit(top)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cf"), "term")).cast("int"))  # ``top`` rows
    return ranked.crossJoin(F.broadcast(totals))


def term_maxima(weights: DataFrame) -> DataFrame:
    return weights.groupBy("term").agg(F.max("w").alias("term_max"))


def pseudo_documents(cells: DataFrame, weights: DataFrame, *more: str) -> DataFrame:
    """(cell, [more,] term, w): the largest weight of each term among the objects of a cell."""
    return weights.join(cells, "id").groupBy("cell", *more, "term").agg(F.max("w").alias("w"))


def posting_statistics(weights: DataFrame) -> DataFrame:
    """Per term: documents, largest and total weight, and the norm of the weights."""
    return weights.groupBy("term").agg(
        F.count(F.lit(1)).alias("postings"), F.max("w").alias("max_w"), F.sum("w").alias("sum_w"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )


def signatures(terms: DataFrame, code) -> DataFrame:
    """(id, signature): 64 bits, two set for each distinct term; ``code`` maps the term column to a long.

    The signature of a group of objects is bit_or over theirs, and one that lacks a keyword's bits can't match it.
    """
    c = code(F.col("term"))
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v, F.lit(64)).cast("int"))
    return terms.groupBy("id").agg(F.bit_or(bit(c).bitwiseOR(bit(c * 31 + 17))).alias("signature"))


def store(weights: DataFrame, path: str) -> None:
    """Parquet by ranges of terms, sorted within: its row groups' statistics find a term. A term's rows are spread by id if they fill a range."""
    weights.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
