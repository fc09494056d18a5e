"""Group queries: objects that are good for several query members together.

Every object is a candidate. The text relevance comes from an equi-join on terms, gathered per object; each
object then meets each group once, as a row that holds the group's members, so that the aggregate is
computed in place and only the k best of each task are shuffled. SUM adds the members' weighted costs;
MAX takes the member whose weighted cost is greatest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.costs import combined_cost
from .boolean import top_k
from .frame import BROADCAST_ROWS, SpatioTextual
from .ranking import ALPHA, relevance

AGGREGATORS = ("SUM", "MAX")


def aggregator(name: str) -> str:
    if name.upper() not in AGGREGATORS:
        raise ValueError(f"aggregator must be one of {AGGREGATORS}, not {name!r}")
    return name.upper()


def aggregate_value(name: str, cost, members):
    """What ``members`` members of the same cost add up to."""
    return cost * members if aggregator(name) == "SUM" else cost


def _blocks(members: DataFrame, limit: int) -> list[DataFrame]:
    """Whole groups, in as many parts as it takes for one to have about ``limit`` members."""
    n = -(-members.count() // max(1, limit))
    return [members] if n <= 1 else [members.where(F.pmod(F.xxhash64("gid"), F.lit(n)) == i) for i in range(n)]


def member_arrays(data: SpatioTextual, members: DataFrame, queries: DataFrame, alpha: float = ALPHA, mode: str = "fast") -> DataFrame:
    """(gid, id, costs): for each object and group an array with qid, weight, ir, dist and cost of every member.

    ``members(gid, qid, weight, x, y)`` are the members' places, ``queries`` their keywords.
    """
    who = members.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("qid", F.col("weight").cast("double").alias("weight"), F.col("x").alias("qx"), F.col("y").alias("qy")))).alias("members"))
    asked = queries.join(F.broadcast(members.select("qid").distinct()), "qid", "left_semi")
    found = relevance(data, asked, mode).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("qid", "ir"))).alias("found"))
    met = data.objects.join(found, "id", "left").crossJoin(F.broadcast(who))

    def cost(m):
        ir = F.coalesce(F.try_element_at(F.col("found"), m["qid"]), F.lit(0.0))
        dist = G.distance(G.point(), G.Point(m["qx"], m["qy"]))
        return F.struct(m["qid"].alias("qid"), m["weight"].alias("weight"), ir.alias("ir"), dist.alias("dist"), combined_cost(dist, ir, alpha, data.max_distance).alias("cost"))

    return met.select("gid", "id", F.transform("members", cost).alias("costs"))


def member_costs(data: SpatioTextual, members: DataFrame, queries: DataFrame, alpha: float = ALPHA, mode: str = "fast") -> DataFrame:
    """(gid, id, qid, weight, ir, dist, cost) of every object with every member, a row each."""
    return member_arrays(data, members, queries, alpha, mode).select("gid", "id", F.inline("costs"))


def _combined(name: str, costs: Column) -> dict[str, Column]:
    """ir, dist and cost of an array of members, in its order."""
    if aggregator(name) == "SUM":
        return {c: F.aggregate(costs, F.lit(0.0), lambda acc, m: acc + m[c] * m["weight"]) for c in ("ir", "dist", "cost")}
    order = F.transform(costs, lambda m: F.struct(F.round(m["cost"] * m["weight"], 9).alias("r"), (-m["qid"]).alias("q"), *[(m[c] * m["weight"]).alias(c) for c in ("ir", "dist", "cost")]))
    return {c: F.array_max(order)[c] for c in ("ir", "dist", "cost")}


def _ids(costs: Column) -> Column:
    return F.concat_ws(",", F.transform(costs, lambda m: m["qid"].cast("string")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def group_nearest(data: SpatioTextual, members: DataFrame, queries: DataFrame, k: int, name: str = "SUM", alpha: float = ALPHA, mode: str = "fast", block: int = BROADCAST_ROWS) -> DataFrame:
    """The k objects of least aggregate cost over all members, ties by id; member_ids lists the members.

    Groups of more than ``block`` members in all are answered in several passes.
    """

    def one(part: DataFrame) -> DataFrame:
        costs = member_arrays(data, part, queries, alpha, mode)
        every = costs.select("gid", "id", *[v.alias(c) for c, v in _combined(name, F.col("costs")).items()], _ids(F.col("costs")).alias("member_ids"))
        return top_k(every, ["gid"], [F.round("cost", 9), "id"], k)

    return _union([one(part) for part in _blocks(members, block)])


def subgroup_nearest(data: SpatioTextual, members: DataFrame, queries: DataFrame, size: int, k: int, name: str = "SUM", alpha: float = ALPHA, mode: str = "fast", up_to: int | None = None, block: int = BROADCAST_ROWS) -> DataFrame:
    """For each subgroup size from ``size`` to ``up_to``: the k objects of least aggregate cost over the
    ``size`` members that are cheapest for them (unweighted cost, ties by member); member_ids in that order.

    One pass serves all sizes: an object's members are sorted by cost within its row, and each size takes the
    first of them. Groups are as small as the member list; more than ``block`` members are answered in several passes.
    """
    last = up_to or size
    smallest = members.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    if not 1 <= size <= last or (smallest is not None and last > smallest):
        raise ValueError(f"subgroup sizes {size} to {last} do not fit groups of {smallest}")

    def one(part: DataFrame) -> DataFrame:
        costs = member_arrays(data, part, queries, alpha, mode)
        ordered = F.sort_array(F.transform("costs", lambda m: F.struct(F.round(m["cost"], 9).alias("_c"), m["qid"].alias("qid"), *[m[c].alias(c) for c in ("weight", "ir", "dist", "cost")])))
        rows = costs.select("gid", "id", ordered.alias("_o")).withColumn("size", F.explode(F.sequence(F.lit(size), F.lit(last))))
        rows = rows.select("gid", "size", "id", F.slice("_o", F.lit(1), F.col("size")).alias("_o"))
        out = rows.select("gid", "size", "id", *[v.alias(c) for c, v in _combined(name, F.col("_o")).items()], _ids(F.col("_o")).alias("member_ids"))
        return top_k(out, ["gid", "size"], [F.round("cost", 9), "id"], k)

    return _union([one(part) for part in _blocks(members, block)])


def subgroup_nearest_each(data: SpatioTextual, members: DataFrame, queries: DataFrame, size: int, up_to: int, k: int, **how) -> DataFrame:
    """The same by one run for each size: the plan to hold the single pass against."""
    return _union([subgroup_nearest(data, members, queries, s, k, **how) for s in range(size, up_to + 1)])
