"""The data model: objects with a place and a weighted bag of terms."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keywords that are named in the scan's filter; more go by the join alone.
NAMED_TERMS = 1000
#: Rows of a query table that are broadcast at once; more are worked off in blocks.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class SpatioTextual:
    """``objects(id, x, y)``, ``weights(id, term, w[, cluster])``, and the distance that costs are scaled by."""

    objects: DataFrame
    weights: DataFrame
    max_distance: float


def postings(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """The weights of the queries' keywords. A few keywords become a filter, which reaches the scan of stored weights."""
    asked = [r["term"] for r in queries.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    return weights if len(asked) > NAMED_TERMS else weights.where(F.col("term").isin(asked))


def max_distance(xlo: float, ylo: float, xhi: float, yhi: float) -> float:
    return ((xhi - xlo) ** 2 + (yhi - ylo) ** 2) ** 0.5


def query_frame(spark, queries: list[dict]) -> DataFrame:
    """(qid, weight, x, y, term, qw): a row for each keyword of each query. The rows are on the driver, hence few."""
    rows = [(q["qid"], float(q.get("weight", 1.0)), float(q["x"]), float(q["y"]), term, float(qw)) for q in queries for term, qw in q["keywords"]]
    return spark.createDataFrame(rows, "qid int, weight double, x double, y double, term string, qw double")


def place_frame(spark, queries: list[dict]) -> DataFrame:
    """(qid, weight, x, y): a row for each query, with or without keywords."""
    return spark.createDataFrame([(q["qid"], float(q.get("weight", 1.0)), float(q["x"]), float(q["y"])) for q in queries], "qid int, weight double, x double, y double")


def shared_folder(spark) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or where a local session names none, one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or f"/tmp/checkpoints/loxogram-{os.getpid()}").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the shared folder, without its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the shared folder as Parquet, without its lineage: smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
