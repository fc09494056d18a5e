"""Spatio-textual similarity joins over one or two sets: by thresholds, and the k best pairs.

A pair's text similarity is that of its full vectors (modes ``full`` and ``spatial``) or the smaller of
both objects' scores against the query's keywords (``textual`` and ``all``); ``spatial`` and ``all`` also
hold both objects to a window. In a self-join a pair is (smaller id, larger id).

Candidates come from a grid (points within the reach) or, where so few pairs are similar enough that the text
is the sharper filter, from the terms: with terms in the order of their rarity, two vectors of a similarity
of at least the floor share a term among the first of both, before what is left of either is too little
to reach it. Both similarities are then computed by an equi-join of the candidates with the weights.

Top-k joins look at pairs within a small reach first, about as many as there are objects; the cost of the k-th
bounds the distance and the similarity of all better ones, which the grid or the terms then find.

Nearest joins compare vectors apart from their places, the most similar first, and then the places of those that are similar enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.costs import combined_cost, distance_ceiling, relevance_floor, set_distance
from ..functions.similarity import array_shared, array_similarity, array_weight, joint_weight, keyword_score, packed_shared, packed_vector, pair_similarity, sane, shared_similarity, similarity_bound, weight_bound
from .boolean import top_k
from .frame import SpatioTextual, written
from .spatial import gathered, nested_place_pairs, nested_point_pairs, place_pairs, point_pairs, spread
from .weights import term_maxima

MODES = ("full", "textual", "spatial", "all")
#: Other names of modes, as configurations write them.
MODE_NAMES = {"": "full", "full_join": "full", "constraint_textual_join": "textual", "partial_join": "textual", "constraint_spatial_join": "spatial", "constraint_all_join": "all"}


def parse_mode(name: str | None) -> str:
    mode = (name or "").strip().lower()
    mode = MODE_NAMES.get(mode, mode)
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {name!r}")
    return mode


@dataclass(frozen=True)
class JoinQuery:
    """How text counts: the similarity, the mode, its keywords (term, weight) and its window.

    ``policy`` (strict or combined_cost) is carried for configurations that name one; no join consults it.
    """

    kind: str = "jaccard"
    mode: str = "full"
    keywords: tuple[tuple[str, float], ...] = ()
    window: tuple[float, float, float, float] | None = None
    alpha: float = 0.5
    policy: str = "strict"


#: Pairs for each object that a grid may be expected to compare; beyond, terms find the candidates.
GRID_PAIRS = 32
#: Terms that vectors may have on average to be compared as arrays, pair by pair; longer ones by equi-joins on the term.
SHORT = 32
#: Terms that the longest vector may have for comparisons to be compiled, a term at a time.
PACKED = 8
#: Vectors of a place in one row; more at a place go on in further rows.
PLACE_VECTORS = 64


def _measured(data: SpatioTextual, kind: str) -> DataFrame:
    """The weights with _total, what the similarity needs to know of the whole vector."""
    return data.weights.select("id", "term", "w", joint_weight(kind, F.col("w")).over(Window.partitionBy("id")).alias("_total"))


def document_similarity(pairs: DataFrame, left: SpatioTextual, right: SpatioTextual, kind: str) -> DataFrame:
    """``pairs`` (id1, id2, dist) with sim, the similarity of the full vectors, where it is positive."""
    a = _measured(left, kind).select(F.col("id").alias("id1"), "term", F.col("w").alias("_w1"), F.col("_total").alias("_t1"))
    b = _measured(right, kind).select(F.col("id").alias("id2"), "term", F.col("w").alias("_w2"), F.col("_total").alias("_t2"))
    met = pairs.hint("merge").join(a, "id1").hint("merge").join(b, ["id2", "term"])
    sim = pair_similarity(kind, F.col("_w1"), F.col("_w2"), F.max("_t1"), F.max("_t2"))
    return met.groupBy("id1", "id2", "dist").agg(sim.alias("sim")).where("sim > 0")


def keyword_scores(data: SpatioTextual, query: JoinQuery) -> DataFrame:
    """(id, score) of the objects with a keyword whose score counts."""
    keywords = data.weights.sparkSession.createDataFrame(list(query.keywords), "term string, qw double")
    matched = data.weights.join(F.broadcast(keywords), "term").join(F.broadcast(term_maxima(data.weights).join(F.broadcast(keywords), "term", "left_semi")), "term")
    score = keyword_score(query.kind, F.col("w"), F.col("qw"), F.col("term_max"), sum(q for _, q in query.keywords), sum(q * q for _, q in query.keywords))
    return matched.groupBy("id").agg(score.alias("score")).where(sane(F.col("score")))


def clustered_keyword_scores(data: SpatioTextual, query: JoinQuery) -> DataFrame:
    """The best of an object's scores per cluster of postings."""
    keywords = data.weights.sparkSession.createDataFrame(list(query.keywords), "term string, qw double")
    matched = data.weights.join(F.broadcast(keywords), "term").join(F.broadcast(term_maxima(data.weights).join(F.broadcast(keywords), "term", "left_semi")), "term")
    score = keyword_score(query.kind, F.col("w"), F.col("qw"), F.col("term_max"), sum(q for _, q in query.keywords), sum(q * q for _, q in query.keywords))
    return matched.groupBy("id", "cluster").agg(score.alias("score")).groupBy("id").agg(F.max("score").alias("score")).where(sane(F.col("score")))


@dataclass(frozen=True)
class _Side:
    data: SpatioTextual
    objects: DataFrame  # what may take part: within the window, and with a score where keywords count


def _side(data: SpatioTextual, query: JoinQuery, floor: float) -> _Side:
    objects = data.objects
    if query.mode in ("spatial", "all") and query.window:
        objects = objects.where(G.contains_point(G.fixed_box(*query.window), G.point()))
    if query.mode in ("textual", "all"):
        scores = keyword_scores(data, query)
        objects = objects.join(scores.where(F.col("score") >= floor) if floor > 0 else scores, "id")
    return _Side(data, objects)


def _similar(pairs: DataFrame, a: _Side, b: _Side, query: JoinQuery) -> DataFrame:
    if query.mode in ("full", "spatial"):
        return document_similarity(pairs, a.data, b.data, query.kind)
    one = a.objects.select(F.col("id").alias("id1"), F.col("score").alias("_s1"))
    two = b.objects.select(F.col("id").alias("id2"), F.col("score").alias("_s2"))
    return pairs.hint("merge").join(one, "id1").hint("merge").join(two, "id2").withColumn("sim", F.least("_s1", "_s2")).drop("_s1", "_s2")


def _short(side: _Side) -> bool:
    """Whether the vectors are short on average."""
    return side.data.weights.count() <= SHORT * side.data.objects.count()


def _near(a: _Side, b: _Side, query: JoinQuery, reach: float, floor: float | None, plan: str = "grid", finish=lambda pairs: pairs, rows: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id1, id2, ...) of pairs within reach with what ``finish`` makes of dist and sim: all (``floor`` None, sim 1), or those of sim >= floor and > 0.

    Objects of one place and one vector (or score) are compared as one, and ``finish`` sees each such pair once, before it is spread.
    ``rows`` are both sides' ``_vectors``, if they are at hand.
    """
    find, self_join = {"grid": place_pairs, "nested": nested_place_pairs}[plan], a is b
    if floor is None:
        one, two = gathered(a.objects), None if self_join else gathered(b.objects)
        pairs = find(one, one if self_join else two, reach, self_join).withColumn("sim", F.lit(1.0))
    elif query.mode in ("textual", "all"):
        one, two = gathered(a.objects, "score"), None if self_join else gathered(b.objects, "score")
        pairs = find(one, one if self_join else two, reach, self_join).withColumn("sim", F.least("score1", "score2"))
    elif not rows and not _all_short(a, b):
        points = {"grid": point_pairs, "nested": nested_point_pairs}[plan]
        pairs = points(a.objects.select("id", "x", "y"), b.objects.select("id", "x", "y"), reach, self_join)
        return finish(document_similarity(pairs, a.data, b.data, query.kind).where(F.col("sim") >= floor))
    else:
        pairs = _vector_pairs(*(rows or _written_vectors(a, b)), query.kind, reach, self_join, find)
    if floor is not None:
        pairs = pairs.where((F.col("sim") >= floor) & (F.col("sim") > 0))
    done = finish(pairs.select("ids1", "ids2", "key1", "key2", "dist", "sim"))
    return spread(done, self_join, *[c for c in done.columns if c not in ("ids1", "ids2", "key1", "key2")])


def _all_short(a: _Side, b: _Side) -> bool:
    return _short(a) and (a is b or _short(b))


def _vectors(side: _Side) -> DataFrame:
    """The objects that have terms, gathered by place and vector v, an array of (term, w) in the order of terms."""
    vectors = side.data.weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("v"))
    return gathered(side.objects.select("id", "x", "y").hint("merge").join(vectors, "id"), "v")


def _written_vectors(a: _Side, b: _Side) -> tuple[DataFrame, DataFrame]:
    one = written(_vectors(a))
    return one, one if a is b else written(_vectors(b))


def _vector_pairs(one: DataFrame, two: DataFrame, kind: str, reach: float, self_join: bool, find=place_pairs) -> DataFrame:
    """(ids1, ids2, key1, key2, dist, sim) of the ``_vectors`` rows within reach: places are dealt to cells with all their vectors, if these can be packed."""
    width = _packed_width(one, two)
    if width is None:
        held = lambda rows: rows.withColumns({"total": array_weight(kind, F.col("v"))})
        pairs = find(held(one), held(two).withColumn("v", F.map_from_entries("v")), reach, self_join)
        pairs = pairs.withColumn("_shared", _once(array_shared(kind, F.col("v1"), F.col("v2"))))
        return pairs.withColumn("sim", shared_similarity(kind, F.col("_shared"), F.col("total1"), F.col("total2")))
    places = _place_vectors(one, kind, width)
    met = find(places, places if self_join else _place_vectors(two, kind, width), reach, self_join)
    met = met.select("dist", "key1", "key2", "vectors2", F.explode("vectors1").alias("a")).select("dist", "key1", "key2", "a", F.explode("vectors2").alias("b"))
    met = met.where("key1 != key2 or a.key <= b.key") if self_join else met
    met = met.select("dist", "a", "b", _once(packed_shared(kind, F.col("a"), F.col("b"), width)).alias("_shared"))
    sim = shared_similarity(kind, F.col("_shared"), F.col("a.total"), F.col("b.total"))
    return met.select(*[F.col(f"{side}.{c}").alias(f"{c}{i}") for c in ("ids", "key") for i, side in ((1, "a"), (2, "b"))], "dist", sim.alias("sim"))


def _once(value: Column) -> Column:
    """The value by way of a generator: filters and projections over it do not compute it again."""
    return F.explode(F.array(value))


def _packed_width(*rows: DataFrame) -> int | None:
    """The terms of the longest vector, if these are few and no two terms have one hash; else None."""
    both = rows[0] if rows[0] is rows[-1] else rows[0].select("v").unionByName(rows[-1].select("v"))
    width = both.agg(F.max(F.size("v"))).first()[0] or 0
    if width > PACKED:
        return None
    terms = both.select(F.explode("v.term").alias("term")).where("term is not null").distinct()
    n, hashes = terms.agg(F.count("term"), F.countDistinct(F.xxhash64("term"))).first()
    return width if n == hashes else None


def _place_vectors(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """(x, y, vectors, key): the packed vectors of a place, with their totals, ids and keys, in rows of ``PLACE_VECTORS``; key is the least."""
    vector = F.struct(*packed_vector(F.col("v"), width), array_weight(kind, F.col("v")).alias("total"), "ids", "key")
    block = F.floor((F.row_number().over(Window.partitionBy("x", "y").orderBy("key")) - 1) / PLACE_VECTORS)
    blocks = rows.select("x", "y", "key", vector.alias("_v")).withColumn("_block", block)
    return blocks.groupBy("x", "y", "_block").agg(F.collect_list("_v").alias("vectors"), F.min("key").alias("key")).drop("_block")


def near_similarity(data: SpatioTextual, kind: str, reach: float, digits: int | None = None) -> DataFrame:
    """(id1, id2, sim) of the objects within reach of one another that share a term."""
    side = _Side(data, data.objects)
    return _near(side, side, JoinQuery(kind), reach, 0.0, finish=lambda p: _rounded(p, digits)).select("id1", "id2", "sim")


def near_set_distance(data: SpatioTextual, reach: float, digits: int | None = None) -> DataFrame:
    """(id1, id2, dist) of the objects within reach of one another that have terms: the Jaccard distance of their terms as sets."""
    sets = data.weights.groupBy("id").agg(F.sort_array(F.collect_set("term")).alias("t"))
    one = gathered(data.objects.select("id", "x", "y").hint("merge").join(sets, "id"), "t")
    pairs = place_pairs(one, one, reach, True).withColumn("dist", set_distance(F.col("t1"), F.col("t2")))
    return spread(_rounded(pairs, digits), True, "dist")


def _rounded(pairs: DataFrame, digits: int | None) -> DataFrame:
    """Doubles to so many digits (-0.0 becomes 0.0), where digits are given."""
    if digits is None:
        return pairs
    return pairs.select(*[(_round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in pairs.dtypes])


def _round(value: Column, digits: int) -> Column:
    """``F.round``, by plain arithmetic for a value that is not large nor near the middle of two results: their nearest is the same."""
    scaled = value * 10.0**digits
    plain = (F.abs(scaled) < 1e12) & (F.abs(F.abs(scaled - F.rint(scaled)) - 0.5) > 1e-3)
    return F.when(plain, F.rint(scaled) / 10.0**digits).otherwise(F.round(value, digits))


def _finish(pairs: DataFrame, query: JoinQuery, max_distance: float) -> DataFrame:
    return pairs.select("id1", "id2", "dist", "sim", combined_cost(F.col("dist"), F.col("sim"), query.alpha, max_distance).alias("combined"))


def _refused(query: JoinQuery) -> bool:
    parse_mode(query.mode)
    return (query.mode in ("spatial", "all") and query.window is None) or (query.mode in ("textual", "all") and not query.keywords)


def _none(left: SpatioTextual) -> DataFrame:
    return left.objects.sparkSession.createDataFrame([], "id1 long, id2 long, dist double, sim double, combined double")


def threshold_join(left: SpatioTextual, right: SpatioTextual | None, query: JoinQuery, reach: float, floor: float, plan: str = "auto", digits: int | None = None) -> DataFrame:
    """(id1, id2, dist, sim, combined) of pairs with dist <= reach and sim >= floor and sim > 0.

    A floor of 0 or less leaves the text out: every pair within reach counts, with sim 1. A mode that needs a
    window or keywords and has none gives no pairs. ``plan`` is grid, terms (for full vectors and a positive floor), nested,
    or auto, which takes terms where a grid would compare too many pairs and the terms fewer. ``right=None`` joins the left
    with itself. ``digits`` rounds the doubles, before pairs of copies are spread.
    """
    if _refused(query):
        return _none(left)
    a = _side(left, query, floor)
    b = a if right is None else _side(right, query, floor)
    rows = None
    if plan == "auto":
        plan = "grid"
        if floor > 0 and query.mode in ("full", "spatial"):
            (n, box), m = _extent(a.objects), b.objects.count()
            expected = _expected_pairs(n, m, max(reach, 0.0), box)
            if expected > GRID_PAIRS * (n + m):
                if _all_short(a, b):  # the grid compares rows of one place and vector
                    rows = _written_vectors(a, b)
                    n, m = (side.count() for side in rows)
                    expected = _expected_pairs(n, m, max(reach, 0.0), box)
                if expected > GRID_PAIRS * (n + m) and _term_count(a, b, query, floor, rows) < expected:
                    plan = "terms"
    scale = left.max_distance
    cost = combined_cost(F.col("dist"), F.col("sim"), query.alpha, scale).alias("combined")
    if plan == "terms":
        pairs = _term_pairs(a, b, right is None, query, scale, floor, None, reach)
        if floor <= 0:
            return _rounded(_finish(pairs.withColumn("sim", F.lit(1.0)), query, scale), digits)
        return _rounded(_finish(_similar(pairs, a, b, query).where((F.col("sim") >= floor) & (F.col("sim") > 0)), query, scale), digits)
    finish = lambda p: _rounded(p.select("*", cost), digits)
    return _near(a, b, query, reach, floor if floor > 0 else None, plan, finish, rows).select("id1", "id2", "dist", "sim", "combined")


def _term_count(a: _Side, b: _Side, query: JoinQuery, floor: float, rows: tuple[DataFrame, DataFrame] | None = None) -> float:
    """Pairs that share a leading term, once for each such term: what a join by terms would compare.

    With both sides' ``_vectors`` at hand, equal vectors are looked at once.
    """
    one, two = ((a, b) if rows is None else (_counted(rows[0]), None if a is b else _counted(rows[1])))
    two = one if two is None else two
    n = F.sum("n") if rows else F.count(F.lit(1))
    extra = ("n",) if rows else ()
    rarity = _rarity(two)
    counts = lambda side, name: _leading(side, query.kind, rarity, floor, extra).groupBy("term").agg(n.alias(name))
    met = counts(one, "n").hint("merge").join(counts(two, "m"), "term").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    return met / 2 if a is b else met


def _counted(rows: DataFrame) -> _Side:
    """The vectors of ``_vectors`` rows as objects (without places), n being the objects that have them."""
    vectors = written(rows.groupBy("v").agg(F.min("key").alias("id"), F.sum(F.size("ids")).alias("n")))
    objects = vectors.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "n")
    return _Side(SpatioTextual(objects, vectors.select("id", F.inline("v")), 0.0), objects)


def _rarity(side: _Side) -> DataFrame:
    return side.objects.select("id").hint("merge").join(side.data.weights, "id").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _leading(side: _Side, kind: str, rarity: DataFrame, floor: Column | float | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, x, y, *extra, term, total, rest): the terms among which a partner's first common one must be, rest being what the vector has from it on.

    ``floor`` None leaves all terms in.
    """
    rows = side.objects.select("id", "x", "y", *extra).hint("merge").join(_measured(side.data, kind), "id").join(rarity, "term")
    onwards = Window.partitionBy("id").orderBy("df", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("rest", joint_weight(kind, F.col("w")).over(onwards)).withColumnRenamed("_total", "total")
    if floor is not None:
        rows = rows.where(F.col("rest") * (1 + 1e-9) >= weight_bound(kind, F.lit(floor) if isinstance(floor, float) else floor, F.col("total")))
    return rows.select("id", "x", "y", *extra, "term", "total", "rest")


def _term_pairs(a: _Side, b: _Side, self_join: bool, query: JoinQuery, max_distance: float, floor: float | None = None, ceiling: float | None = None, reach: float | None = None, limits: DataFrame | None = None) -> DataFrame:
    """(id1, id2, dist): candidates that share a leading term, all that can have a similarity of ``floor`` and a cost of ``ceiling``.

    ``limits(id, limit)`` gives left objects a ceiling of their own; the right side then keeps all its terms.
    """
    kind = query.kind
    rarity = _rarity(a if self_join else b)
    if limits is not None:
        bounded = _Side(a.data, a.objects.join(limits, "id", "left"))
        least = F.coalesce(F.lit(0.0) if query.alpha >= 1 else F.greatest(1 - F.col("limit") / (1 - query.alpha), F.lit(0.0)), F.lit(0.0))
        one = _leading(bounded, kind, rarity, least, ("limit",))
    else:
        one = _leading(a, kind, rarity, floor)
    two = one if self_join else _leading(b, kind, rarity, floor if limits is None else None)
    left = one.select("term", *[F.col(c).alias(f"{c}1") for c in ("id", "x", "y", "total", "rest")], *(["limit"] if limits is not None else []))
    right = two.select("term", *[F.col(c).alias(f"{c}2") for c in ("id", "x", "y", "total", "rest")])
    dist = G.distance(G.Point(F.col("x1"), F.col("y1")), G.Point(F.col("x2"), F.col("y2")))
    met = left.join(right, "term").where(F.col("id1") < F.col("id2") if self_join else F.lit(True)).withColumn("dist", dist)
    if reach is not None:
        met = met.where(F.col("dist") <= reach)
    most = similarity_bound(kind, F.col("rest1"), F.col("rest2"), F.col("total1"), F.col("total2"))
    least_cost = combined_cost(F.col("dist"), most, query.alpha, max_distance)
    if limits is not None:
        met = met.where(F.col("limit").isNull() | (least_cost <= F.col("limit") + 1e-9))
    elif ceiling is not None:
        met = met.where(least_cost <= ceiling + 1e-9)
    return met.select("id1", "id2", "dist").distinct()


def _expected_pairs(n: float, m: float, reach: float, box: tuple[float, float, float, float]) -> float:
    """Pairs within reach if places were even over the box."""
    width, height = max(box[2] - box[0], 1e-12), max(box[3] - box[1], 1e-12)
    return n * m * min(1.0, 2 * reach / width) * min(1.0, 2 * reach / height)


def _extent(objects: DataFrame) -> tuple[int, tuple[float, float, float, float]]:
    row = objects.agg(F.count(F.lit(1)), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return row[0], tuple(float(v or 0.0) for v in row[1:])


def _best_similarity(a: _Side, b: _Side, query: JoinQuery) -> float:
    """No pair has more: 1, or for the unbounded sum the smaller of both sides' largest totals."""
    if query.mode in ("textual", "all"):
        tops = [x.objects.agg(F.max("score")).first()[0] for x in (a, b)]
    elif query.kind == "sum":
        tops = [x.data.weights.groupBy("id").agg(F.sum("w").alias("s")).agg(F.max("s")).first()[0] for x in (a, b)]
    else:
        return 1.0
    return min(t or 0.0 for t in tops)


def _best_pairs(pairs: DataFrame, query: JoinQuery, max_distance: float, k: int) -> DataFrame:
    """The k first pairs by cost, with their rank: a bounded sort, then a window over k rows."""
    order = [F.round("combined", 9), "id1", "id2"]
    best = _finish(pairs.where("sim > 0"), query, max_distance).orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def top_k_join(left: SpatioTextual, right: SpatioTextual | None, query: JoinQuery, k: int, plan: str = "bounded") -> DataFrame:
    """The k pairs of least combined cost among those with sim > 0, ties by ids, with their rank.

    ``plan="all"`` scores every pair that shares a term (or, with keywords, every pair that scores).
    """
    if k <= 0 or _refused(query):
        return _none(left).withColumn("rank", F.lit(0))
    a = _side(left, query, 0)
    b = a if right is None else _side(right, query, 0)
    self_join, full = right is None, query.mode in ("full", "spatial")
    scale = left.max_distance
    pick = lambda pairs: _best_pairs(pairs, query, scale, k)
    within = lambda x, y, reach: _near(x, y, query, reach, 0.0)
    (n, box), m = _extent(a.objects), b.objects.count()
    whole = ((box[2] - box[0]) ** 2 + (box[3] - box[1]) ** 2) ** 0.5
    if right is not None:
        _, other = _extent(b.objects)
        whole = ((max(box[2], other[2]) - min(box[0], other[0])) ** 2 + (max(box[3], other[3]) - min(box[1], other[1])) ** 2) ** 0.5
    if plan == "bounded":
        reach = max(whole, 1e-9) * min(1.0, ((4 * k + 2.0 * (n + m)) / max(1.0, float(n) * m)) ** 0.5)
        while reach < whole and _expected_pairs(n, m, reach, box) <= 4 * GRID_PAIRS * (k + n + m):
            found, worst = pick(within(a, b, reach)).agg(F.count(F.lit(1)), F.max("combined")).first()
            if found >= k:
                worst += 1e-9
                best = _best_similarity(a, b, query)
                ceiling = distance_ceiling(worst, query.alpha, scale, best) * (1 + 1e-9) + 1e-9
                floor = relevance_floor(worst, query.alpha)
                if full and _expected_pairs(n, m, min(ceiling, whole), box) > GRID_PAIRS * (n + m):
                    near = ceiling if ceiling < float("inf") else None
                    return pick(_similar(_term_pairs(a, b, self_join, query, scale, floor or None, worst, near), a, b, query))
                if not full:
                    a = _Side(a.data, a.objects.where(F.col("score") >= floor))
                    b = a if self_join else _Side(b.data, b.objects.where(F.col("score") >= floor))
                return pick(within(a, b, min(ceiling, 2 * whole + 1)).where(F.col("sim") >= floor))
            reach *= 4
    if not full:
        return pick(within(a, b, 2 * whole + 1))
    return pick(_similar(_term_pairs(a, b, self_join, query, scale), a, b, query))


#: Of the largest similarity that there can be, the parts down to which partners are looked for in turn.
LEVELS = (0.85, 0.6, 0.3)
#: Pairs of vectors up to which one look at all that share a term is enough.
FEW_PAIRS = 1_000_000
#: Places in one row of a vector's places, and about how many a cell is to hold.
PLACES, CELL_PLACES = 256, 32
#: Places a vector from which on the grid looks at them first.
MANY_PLACES = 256


def nearest_join(left: SpatioTextual, right: SpatioTextual, query: JoinQuery, k: int, plan: str = "bounded") -> DataFrame:
    """For each left object its k partners of least combined cost, among those that share a term.

    Objects of one place and vector are answered as one, and vectors are compared once, wherever they occur. Partners are looked for
    among the vectors of a high similarity first: whoever has k that no less similar one can beat is done, and the others
    go on to a lower one, with the cost of their k-th as a ceiling. The last look has no floor but that ceiling's.
    """
    if k <= 0:
        return _none(left).withColumn("rank", F.lit(0))
    a, b = _side(left, query, 0), _side(right, query, 0)
    if plan == "all" or query.mode not in ("full", "spatial"):
        pairs = _finish(_similar(_term_pairs(a, b, False, query, left.max_distance), a, b, query).where("sim > 0"), query, left.max_distance)
        return top_k(pairs, ["id1"], [F.round("combined", 9), "id2"], k)
    scale, short, best = left.max_distance, _short(a) and _short(b), _best_similarity(a, b, query)
    share = 1.0 if not scale > 0 else 1 - query.alpha  # what a similarity of 1 takes off the cost
    one, two = (written(_vectors(side).withColumn("vid", F.min("key").over(Window.partitionBy("v")))) for side in (a, b))
    mine, others = (written(rows.where("vid = key").select("vid", "v")) for rows in (one, two))
    n, (m, box) = mine.count(), _extent(two)
    places = written(_cell_places(two, box, k))
    todo = one.select("key", "vid", "x", "y", F.lit(None).cast("double").alias("limit"))
    done = None
    if short and share < 1 and m > MANY_PLACES * others.count():
        reach = max(((box[2] - box[0]) ** 2 + (box[3] - box[1]) ** 2) ** 0.5, 1e-9) * min(1.0, ((k + 8.0) / max(1, m)) ** 0.5)
        found = _looked(todo, _best_partners(_near_rows(one, two, query.kind, reach, k), query, scale, k), k)
        # what is not within reach costs more
        least = query.alpha * reach / scale + share * (1 - best)
        done, todo = _parted(found, F.col("limit") + 2e-9 <= least)
    levels = [x * best for x in LEVELS] if share > 0 and float(n) * others.count() > FEW_PAIRS else []
    for level in (*levels, 0.0):
        if todo.isEmpty():
            break
        # a ceiling of the cost is a floor of the similarity
        floor = F.greatest(F.coalesce(1 - (F.col("limit") + 2e-9) / share if share > 0 else F.lit(0.0), F.lit(0.0)), F.lit(level))
        asked = todo.withColumn("floor", floor)
        pairs = written(_similar_vectors(mine, others, asked.groupBy("vid").agg(F.min("floor").alias("floor")), query.kind, level, short))
        met = asked.hint("merge").join(pairs.withColumnRenamed("vid1", "vid"), "vid").where("sim >= floor - 1e-9")
        corner = G.min_distance(G.point_box(G.point()), G.box("c_")) * (1 - 1e-9)
        met = met.hint("merge").join(places, "vid2").where(F.col("limit").isNull() | (combined_cost(corner, F.col("sim"), query.alpha, scale) <= F.col("limit") + 2e-9))
        found = _looked(todo, _best_partners(met, query, scale, k), k)
        more, todo = _parted(found, F.col("limit") + 2e-9 <= share * (1 - level) if level > 0 else F.lit(True))
        done = more if done is None else done.unionByName(more)
    if done is None:
        return _none(left).withColumn("rank", F.lit(0))
    answers = done.select("key", "partners").hint("merge").join(one.select("key", "ids"), "key")
    answers = answers.select("partners", F.explode("ids").alias("id1")).select("id1", F.posexplode("partners").alias("_rank", "_p"))
    return answers.select("id1", "_p.id2", "_p.dist", "_p.sim", "_p.combined", (F.col("_rank") + 1).cast("int").alias("rank"))


def _cell_places(rows: DataFrame, box: tuple[float, float, float, float], k: int) -> DataFrame:
    """(vid2, places, c_xlo, c_ylo, c_xhi, c_yhi): a vector's places by cells of a grid, finer where there are more; each with the k least of its ids."""
    width, height = max(box[2] - box[0], 1e-9), max(box[3] - box[1], 1e-9)
    same = Window.partitionBy("x", "y", "vid").orderBy("id")
    ids = rows.select("x", "y", "vid", F.explode(F.slice("ids", 1, k)).alias("id")).withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k)
    ids = ids.groupBy("x", "y", "vid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    sizes = rows.groupBy("vid").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.greatest(F.floor(F.sqrt(F.col("_n") / CELL_PLACES)), F.lit(1))
    at = lambda v, lo, side: F.least(F.floor((F.col(v) - lo) / side * parts), parts - 1)
    cells = ids.hint("merge").join(sizes, "vid").withColumns({"_cx": at("x", box[0], width), "_cy": at("y", box[1], height)})
    cells = cells.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy("vid", "_cx", "_cy").orderBy("x", "y")) - 1) / PLACES))
    corners = [f(c).alias(f"c_{c}{end}") for end, f in (("lo", F.min), ("hi", F.max)) for c in ("x", "y")]
    cells = cells.groupBy(F.col("vid").alias("vid2"), "_cx", "_cy", "_block").agg(F.collect_list(F.struct("x", "y", "ids")).alias("places"), *corners)
    return cells.select("vid2", "places", *[F.col(f"c_{c}") for c in ("xlo", "ylo", "xhi", "yhi")])


def _best_partners(met: DataFrame, query: JoinQuery, scale: float, k: int) -> DataFrame:
    """(key, partners) from (key, x, y, limit, sim, places): the k first (id2, dist, sim, combined) by cost, ties by id."""
    dist = lambda p: G.distance(G.point(), G.Point(p["x"], p["y"]))
    each = F.transform("places", lambda p: F.struct(dist(p).alias("dist"), p["ids"].alias("ids")))
    cost = lambda p: combined_cost(p["dist"], F.col("sim"), query.alpha, scale)
    each = F.transform(each, lambda p: F.struct(F.round(cost(p), 9).alias("c"), p["ids"].alias("ids"), p["dist"].alias("dist"), cost(p).alias("combined")))
    first = F.slice(F.array_sort(F.filter(each, lambda p: F.col("limit").isNull() | (p["combined"] <= F.col("limit") + 2e-9))), 1, k)
    rows = met.select("key", "sim", F.explode(first).alias("_p")).select("key", "sim", "_p.*").withColumn("least", F.col("ids")[0])
    rows = top_k(rows, ["key"], ["c", "least"], k).select("key", "c", F.explode("ids").alias("id2"), "dist", "sim", "combined")
    partners = F.slice(F.array_sort(F.collect_list(F.struct("c", "id2", "dist", "sim", "combined"))), 1, k)  # of k times k rows
    return rows.groupBy("key").agg(partners.alias("partners"))


def _looked(todo: DataFrame, partners: DataFrame, k: int) -> DataFrame:
    """The rows with their partners so far and, where these are k, the limit that the last of them sets."""
    found = todo.hint("merge").join(partners, "key", "left")
    return written(found.withColumn("limit", F.least("limit", F.when(F.size("partners") >= k, F.element_at("partners", -1)["combined"]))))


def _parted(found: DataFrame, settled: Column) -> tuple[DataFrame, DataFrame]:
    settled = F.coalesce(settled, F.lit(False))
    return found.where(settled & F.col("partners").isNotNull()), found.where(~settled).drop("partners")


def _near_rows(one: DataFrame, two: DataFrame, kind: str, reach: float, k: int) -> DataFrame:
    """(key, x, y, limit, sim, places) of the rows within reach that share a term."""
    held = lambda rows, *c: rows.select("x", "y", "key", F.slice("ids", 1, k).alias("ids"), array_weight(kind, F.col("v")).alias("total"), *c)
    pairs = place_pairs(held(one, "v"), held(two, F.map_from_entries("v").alias("v")), reach, False)
    pairs = pairs.withColumn("sim", array_similarity(kind, F.col("v1"), F.col("v2"), F.col("total1"), F.col("total2"))).where("sim > 0")
    place = F.array(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("ids2").alias("ids")))
    return pairs.select(F.col("key1").alias("key"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(None).cast("double").alias("limit"), "sim", place.alias("places"))


def _similar_vectors(mine: DataFrame, others: DataFrame, floors: DataFrame, kind: str, level: float, short: bool) -> DataFrame:
    """(vid1, vid2, sim): of the vectors asked for in ``floors``, each with those of a similarity of its floor, which is the level at least, and above 0."""
    terms = lambda rows: SpatioTextual(rows.select(F.col("vid").alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), rows.select(F.col("vid").alias("id"), F.inline("v")), 0.0)
    a, b = (_Side(data, data.objects) for data in (terms(mine), terms(others)))
    asked = _Side(a.data, a.objects.hint("merge").join(floors.withColumnRenamed("vid", "id"), "id"))
    rarity = _rarity(b)
    one = _leading(asked, kind, rarity, F.col("floor"), ("floor",)).select("term", "floor", *[F.col(c).alias(f"{c}1") for c in ("id", "total", "rest")])
    two = _leading(b, kind, rarity, level).select("term", *[F.col(c).alias(f"{c}2") for c in ("id", "total", "rest")])
    most = similarity_bound(kind, F.col("rest1"), F.col("rest2"), F.col("total1"), F.col("total2"))
    enough = most * (1 + 1e-9) + 1e-12 >= F.col("floor")
    if not short:
        pairs = one.hint("merge").join(two, "term").where(enough).select("id1", "id2", "floor", F.lit(0.0).alias("dist")).distinct()
        found = document_similarity(pairs.drop("floor"), a.data, b.data, kind).join(floors.withColumnRenamed("vid", "id1").hint("merge"), "id1")
    else:
        one = one.hint("merge").join(mine.select(F.col("vid").alias("id1"), F.col("v").alias("v1")), "id1")
        two = two.hint("merge").join(others.select(F.col("vid").alias("id2"), F.map_from_entries("v").alias("v2")), "id2")
        sim = array_similarity(kind, F.col("v1"), F.col("v2"), F.col("total1"), F.col("total2"))
        found = one.hint("merge").join(two, "term").where(enough).select("id1", "id2", "floor", sim.alias("sim")).where((F.col("sim") >= F.col("floor") - 1e-9) & (F.col("sim") > 0)).distinct()
    return found.where((F.col("sim") >= F.col("floor") - 1e-9) & (F.col("sim") > 0)).select(F.col("id1").alias("vid1"), F.col("id2").alias("vid2"), "sim")
