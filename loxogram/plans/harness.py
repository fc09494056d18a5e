"""Experiments: sweep one parameter at a time (or distance and similarity together), time each run, summarise over iterations.

``python -m loxogram.plans.harness CONFIG.json SF_DIR OUT_DIR`` runs a configuration over the driver's
tables or the files that it names; ``--list`` names the experiments.
"""

from __future__ import annotations

import argparse
import dataclasses
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boolean, group, joins, ranking, weights
from ..operators.frame import SpatioTextual, checkpointed, place_frame, query_frame
from ..sources import config as C
from ..sources import objects, sampling, validation, writers
from .generate import Generator, Source, subgroup_size

METRICS = "experiment string, swept string, value string, iteration int, rows long, seconds double, scanned long, spatial double, textual double, ir double, memory long"


def _single(spark, gen: Generator, p: C.QueryParams):
    return query_frame(spark, gen.single(p.queries, p.keywords, p.area, p.keyword_space))


def _members(spark, gen: Generator, p: C.QueryParams, percent: int | None = None):
    rows = gen.groups(p.queries, p.group_size, p.keywords, p.area, p.keyword_space, percent)
    gids = spark.createDataFrame([(r["qid"], r["gid"]) for r in rows], "qid int, gid int")
    return place_frame(spark, rows).join(gids, "qid"), query_frame(spark, rows).drop("weight", "x", "y")


def _join_query(gen: Generator, p: C.QueryParams, mode: str) -> joins.JoinQuery:
    q = gen.joins(1, p.keywords, p.area, p.keyword_space)[0]
    return joins.JoinQuery("jaccard", mode, tuple(q["keywords"]), q["window"], p.alpha)


@dataclasses.dataclass(frozen=True)
class Data:
    """The data set of an experiment, and the second one of joins over two; without it the first one's even and odd ids are joined."""

    first: SpatioTextual
    second: SpatioTextual | None = None

    def pair(self) -> tuple[SpatioTextual, SpatioTextual]:
        if self.second:
            return self.first, self.second
        return objects.with_ids(self.first, lambda i: i % 2 == 0), objects.with_ids(self.first, lambda i: i % 2 == 1)


Run = Callable[[SparkSession, Data, Generator, C.QueryParams], DataFrame]

EXPERIMENTS: dict[str, Run] = {
    "range": lambda s, d, g, p: boolean.range_query(d.first, _single(s, g, p), p.radius),
    "nearest": lambda s, d, g, p: boolean.nearest_matching(d.first, _single(s, g, p), p.k),
    "ranked": lambda s, d, g, p: ranking.top_ranked(d.first, _single(s, g, p), p.k, p.alpha),
    "group_sum": lambda s, d, g, p: group.group_nearest(d.first, *_members(s, g, p), p.k, "SUM", p.alpha),
    "group_max": lambda s, d, g, p: group.group_nearest(d.first, *_members(s, g, p), p.k, "MAX", p.alpha),
    "subgroup": lambda s, d, g, p: group.subgroup_nearest(d.first, *_members(s, g, p, p.subgroup_percent), max(1, subgroup_size(p.group_size, p.subgroup_percent)), p.k, "SUM", p.alpha),
    "join": lambda s, d, g, p: joins.threshold_join(d.first, None, _join_query(g, p, "full"), p.join_distance, p.join_similarity),
    "join_two": lambda s, d, g, p: joins.threshold_join(*d.pair(), _join_query(g, p, "full"), p.join_distance, p.join_similarity),
    "join_top": lambda s, d, g, p: joins.top_k_join(d.first, None, _join_query(g, p, "full"), p.k),
    "join_top_two": lambda s, d, g, p: joins.top_k_join(*d.pair(), _join_query(g, p, "full"), p.k),
}


def sweep(config: C.Config, experiment: str) -> Iterator[tuple[str, object, C.QueryParams]]:
    """(swept, value, parameters): the defaults, then every value of every sweep. An experiment's own overrides win over the defaults, swept values over both.

    The sweep ``combined`` varies distance and similarity together: it has pairs, or is true, and then
    takes the values of the sweeps of both, one by one up to the shorter.
    """
    base = dataclasses.replace(config.params, **config.overrides.get(experiment, {}))
    yield "defaults", "", base
    for name, values in config.sweeps.items():
        if name == "combined":
            pairs = values if isinstance(values, list) else zip(config.sweeps.get("join_distance", []), config.sweeps.get("join_similarity", []), strict=False) if values else []
            for distance, similarity in pairs:
                yield name, f"{distance:.3f} / {similarity:.2f}", dataclasses.replace(base, join_distance=distance, join_similarity=similarity)
            continue
        for value in values:
            yield name, value, dataclasses.replace(base, **{name: value})


def ranked_vocabulary(terms: DataFrame) -> DataFrame:
    """(i, term): the distinct terms with their place from 0 in order, numbered by their first two characters and the counts of these."""
    start = terms.select("term").distinct().withColumn("_s", F.substring("term", 1, 2))
    sizes = checkpointed(start.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row for each pair of characters
    offsets = sizes.select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = F.row_number().over(Window.partitionBy("_s").orderBy("term"))
    return start.withColumn("_k", own).join(offsets, "_s").select((F.col("_off") + F.col("_k") - 1).alias("i"), "term")


def source_of(data: SpatioTextual, terms: DataFrame, box) -> Source:
    """What the generator draws from. The vocabulary stays distributed; only words that are drawn come to the driver."""
    dense = [(r["x"], r["y"]) for r in validation.dense_regions(data.objects).collect()]
    top = [r["term"] for r in weights.keyword_summary(terms).collect()]
    ranked = checkpointed(ranked_vocabulary(terms))

    def words(places: list[int]) -> dict[int, str]:
        asked = ranked.sparkSession.createDataFrame([(p,) for p in places], "i long")
        return {r["i"]: r["term"] for r in ranked.join(F.broadcast(asked), "i").collect()}

    return Source(box, dense, top, ranked.count(), words)


def load_dataset(spark: SparkSession, sf_dir: str, wanted: C.DatasetConfig, smoothing: float) -> tuple[SpatioTextual, DataFrame, tuple]:
    """(data, terms, extent) of a data set of the configuration. A share takes that part of the ids, evenly spread."""
    box = C.CATALOGUE[wanted.name].box if wanted.name in C.CATALOGUE else objects.WORLD
    if wanted.places and wanted.keywords:
        places, terms = objects.read_places(spark, wanted.places), objects.read_keywords(spark, wanted.keywords)
    elif wanted.name in ("PART", "DOCUMENTS"):
        places, terms = {"PART": (objects.part_objects, objects.part_terms), "DOCUMENTS": (objects.document_objects, objects.document_terms)}[wanted.name]
        places, terms = places(spark, sf_dir), terms(spark, sf_dir)
    else:
        raise ValueError(f"data set {wanted.name!r} needs files of places and keywords")
    if wanted.share < 1:
        kept = checkpointed(sampling.systematic(places.select("id"), ["id"], wanted.share))
        places, terms = places.join(kept, "id", "left_semi"), terms.join(kept, "id", "left_semi")
    scale = ((box[2] - box[0]) ** 2 + (box[3] - box[1]) ** 2) ** 0.5
    return SpatioTextual(places, checkpointed(weights.tfidf(terms, smoothing)), scale), terms, box


def scanned_rows(df: DataFrame) -> int:
    """Rows that the scans of an executed DataFrame put out, from Spark's SQL metrics."""

    def walk(plan) -> int:
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        children = plan.children()
        if children.isEmpty():
            rows = plan.metrics().get("numOutputRows")
            return int(rows.get().value()) if "Scan" in name and rows.isDefined() else 0
        return sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def measured(spark: SparkSession, result: DataFrame) -> tuple:
    """(rows, seconds, rows scanned, mean distance, text part and cost of the results, growth of the driver's memory): the result is computed in full."""
    mean = lambda *names: next((F.avg(c) for c in names if c in result.columns), F.lit(None).cast("double"))
    memory = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    before, began = memory.totalMemory() - memory.freeMemory(), time.perf_counter()
    stats = result.agg(F.count(F.lit(1)), mean("dist"), mean("sim", "ir"), mean("cost", "combined"))
    rows, spatial, textual, cost = stats.collect()[0]
    seconds = time.perf_counter() - began
    return rows, seconds, scanned_rows(stats), spatial, textual, cost, memory.totalMemory() - memory.freeMemory() - before


def run(spark: SparkSession, config: C.Config, sf_dir: str) -> DataFrame:
    """A row of METRICS for each run; data sets are prepared once."""
    first, terms, box = load_dataset(spark, sf_dir, config.dataset, config.smoothing)
    second = load_dataset(spark, sf_dir, config.secondary, config.smoothing)[0] if config.secondary else None
    data, source = Data(first, second), source_of(first, terms, box)
    rows = []
    for experiment in config.experiments:
        for swept, value, params in sweep(config, experiment):
            for i in range(config.iterations):
                found = EXPERIMENTS[experiment](spark, data, Generator(source, config.seed + i), params)
                rows.append((experiment, swept, str(value), i, *measured(spark, found)))
    return spark.createDataFrame(rows, METRICS)


def detailed(metrics: DataFrame) -> DataFrame:
    """The detailed metrics, a row for each swept value, in the 18 columns that readers of these files expect (fixed names). Rows scanned stand for nodes visited."""
    ms = F.col("seconds") * 1000
    total = lambda c: F.sum(c).cast("long")
    out = metrics.groupBy("experiment", "swept", "value").agg(
        F.count(F.lit(1)).alias("numIterations"), F.sum(ms).alias("totalTimeMs"), F.median(ms).alias("medianTimeMs"), F.min(ms).alias("minTimeMs"), F.max(ms).alias("maxTimeMs"), F.avg(ms).alias("avgTimeMs"),
        total("scanned").alias("totalNodesVisited"), F.avg("scanned").alias("avgNodesVisited"), F.avg("spatial").alias("avgSpatialCost"), F.avg("textual").alias("avgTextualCost"), F.avg("ir").alias("avgIRCost"),
        total("rows").alias("totalResults"), F.avg("rows").alias("avgResults"), total("rows").alias("totalReturnedPairs"), F.avg("rows").alias("avgReturnedPairs"), total("memory").alias("memoryDeltaBytes"),
    )
    shown = F.when(F.col("swept") == "defaults", F.lit("default")).otherwise(F.concat_ws("=", "swept", "value"))
    return out.withColumns({"queryType": F.col("experiment"), "value": shown}).select("queryType", "value", *out.columns[3:]).orderBy("queryType", "value")


def summary(metrics: DataFrame) -> DataFrame:
    """Mean, least, greatest and median seconds over the iterations."""
    s = F.col("seconds")
    return metrics.groupBy("experiment", "swept", "value").agg(F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"), F.median(s).alias("median"), F.max("rows").alias("rows"))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loxogram")
    parser.add_argument("--list", action="store_true")
    parser.add_argument("config", nargs="?")
    parser.add_argument("sf_dir", nargs="?")
    parser.add_argument("out", nargs="?")
    given = parser.parse_args(args)
    if given.list or not given.out:
        print("\n".join(EXPERIMENTS))
        return
    spark = SparkSession.builder.getOrCreate()
    metrics = run(spark, C.load(Path(given.config).read_text()), given.sf_dir)
    metrics = checkpointed(metrics)
    writers.write_results(metrics, f"{given.out}/runs")
    writers.write_results(detailed(metrics), f"{given.out}/detailed")
    writers.write_results(summary(metrics), f"{given.out}/summary")


if __name__ == "__main__":
    main()
