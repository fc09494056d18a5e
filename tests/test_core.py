"""Small fixtures with known answers, and properties that hold between operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loxogram.functions import costs, similarity
from loxogram.functions import geometry as G
from loxogram.operators import boolean, clustering, group, joins, ranking, spatial, weights
from loxogram.operators.frame import SpatioTextual, max_distance, place_frame, query_frame
from loxogram.plans import generate, harness
from loxogram.sources import config, objects, sampling, validation, writers

pytestmark = pytest.mark.usefixtures("plain_plans")

EIGHT = {
    1: (10, 20, [101, 102, 103]), 2: (15, 25, [102, 103]), 3: (12, 22, [101, 103, 104]), 4: (50, 50, [105]),
    5: (5, 5, [101, 106]), 6: (25, 15, [102, 107]), 7: (30, 30, [103, 108, 101]), 8: (60, 60, [109]),
}


def data_of(spark, rows, diagonal, smoothing=0.0):
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y, _) in rows.items()], "id long, x double, y double")
    terms = objects.terms_of(spark, {i: t for i, (_, _, t) in rows.items()})
    return SpatioTextual(places, weights.tfidf(terms, smoothing).cache(), diagonal)


@pytest.fixture(scope="module")
def eight(spark):
    return data_of(spark, EIGHT, max_distance(-4, -5, 5, 5))


def ask(spark, *words, x=10.0, y=20.0, weight=1.0):
    return query_frame(spark, [{"qid": 1, "x": x, "y": y, "keywords": [(str(w), weight) for w in words]}])


def test_weights_of_the_eight(eight):
    found = {(r["id"], r["term"]): r["w"] for r in eight.weights.collect()}
    assert found[1, "101"] == pytest.approx(0.932082, abs=1e-6) and found[1, "102"] == pytest.approx(1.0)
    assert found[3, "101"] == pytest.approx(0.76735, abs=1e-5) and found[6, "102"] == pytest.approx(0.821822, abs=1e-6)


@pytest.mark.parametrize(("word", "radius", "ids"), [(101, 100, {1, 3, 5, 7}), (102, 100, {1, 2, 6}), (105, 40, set()), (999, 100, set()), (101, -1, set())])
def test_range(spark, eight, word, radius, ids):
    assert {r["id"] for r in boolean.range_query(eight, ask(spark, word), radius).collect()} == ids


@pytest.mark.parametrize(("word", "k", "ids"), [(101, 1, [1]), (101, 2, [1, 3]), (102, 1, [1]), (101, 0, [])])
def test_nearest_matching(spark, eight, word, k, ids):
    assert [r["id"] for r in boolean.nearest_matching(eight, ask(spark, word), k).orderBy("rank").collect()] == ids


def test_all_keywords_must_match(spark, eight):
    assert {r["id"] for r in boolean.range_query(eight, ask(spark, 101, 103), 100).collect()} == {1, 3, 7}


def test_ranking(spark, eight):
    best = ranking.top_ranked(eight, ask(spark, 101), 2).orderBy("rank").collect()
    assert [(r["id"], round(r["cost"], 6)) for r in best] == [(1, 0.0), (3, 0.105118)]
    assert [r["id"] for r in ranking.top_ranked(eight, ask(spark, 105), 1).collect()] == [4]
    legacy = {r["id"] for r in ranking.top_ranked_by_distance(eight, ask(spark, 101), 3).collect()}
    assert legacy == {r["id"] for r in ranking.top_ranked(eight, ask(spark, 101), 3).collect()}
    with pytest.raises(ValueError):
        ranking.relevance(eight, ask(spark, 101), "other")


KEYWORDS = (("101", 1.0), ("102", 1.0), ("103", 1.0))


def test_threshold_join_of_the_eight(eight):
    q = joins.JoinQuery("jaccard", "textual", KEYWORDS)
    rows = joins.threshold_join(eight, None, q, 30, 0.1).orderBy("combined").collect()
    assert len(rows) == 14
    assert [(r["id1"], r["id2"], round(r["sim"], 6), round(r["combined"], 6)) for r in rows[:3]] == [(1, 3, 0.511567, 0.349334), (2, 3, 0.511567, 0.401893), (1, 2, 0.644027, 0.44078)]
    assert joins.threshold_join(eight, None, joins.JoinQuery("jaccard"), 30, 0.1).count() == 10


@pytest.mark.parametrize(("kind", "mode"), [("sum", "full"), ("jaccard", "full"), ("cosine", "spatial"), ("jaccard", "textual"), ("sum", "all")])
def test_plans_agree(spark, kind, mode):
    rng = random.Random(3)
    rows = {i: (rng.uniform(0, 20), rng.uniform(0, 20), [rng.randrange(1, 9) for _ in range(rng.randrange(1, 5))]) for i in range(60)}
    data = data_of(spark, rows, 28.0)
    q = joins.JoinQuery(kind, mode, (("1", 0.7), ("2", 0.5), ("5", 0.2)), (2.0, 2.0, 18.0, 18.0))
    key = lambda df: sorted((r["id1"], r["id2"], round(r["combined"], 9)) for r in df.collect())
    near = key(joins.threshold_join(data, None, q, 4, 0.2, plan="nested"))
    for plan in ("auto", "grid", *(["terms"] if mode in ("full", "spatial") else [])):
        assert key(joins.threshold_join(data, None, q, 4, 0.2, plan=plan)) == near
    every = key(joins.top_k_join(data, None, q, 12, plan="all"))
    assert len(every) == 12 and key(joins.top_k_join(data, None, q, 12)) == every
    even, odd = objects.with_ids(data, lambda i: i % 2 == 0), objects.with_ids(data, lambda i: i % 2 == 1)
    if mode in ("full", "spatial"):
        mirrored = sorted((b, a, c) for a, b, c in key(joins.threshold_join(odd, even, q, 4, 0.2)))
        assert key(joins.threshold_join(even, odd, q, 4, 0.2)) == mirrored
    assert key(joins.top_k_join(even, odd, q, 5)) == key(joins.top_k_join(even, odd, q, 5, plan="all"))


@pytest.mark.parametrize(("kind", "alpha"), [("sum", 0.0), ("jaccard", 0.3), ("cosine", 1.0)])
def test_bounded_plans_on_more_objects(spark, monkeypatch, kind, alpha):
    """With a low limit of the grid's pairs, terms find the candidates; the answers are those of all pairs."""
    monkeypatch.setattr(joins, "GRID_PAIRS", 0.5)
    rng = random.Random(11)
    rows = {i: (rng.uniform(0, 30), rng.uniform(0, 30), [min(rng.randrange(1, 40), rng.randrange(1, 40)) for _ in range(rng.randrange(1, 7))]) for i in range(140)}
    rows |= {200 + i: (5.0, 5.0, [1, 2]) for i in range(6)} | {300 + i: (7.0 + i, 5.0, [900 + i]) for i in range(4)}
    data = data_of(spark, rows, 42.0)
    q = joins.JoinQuery(kind, "full", alpha=alpha)
    even, odd = objects.with_ids(data, lambda i: i % 2 == 0), objects.with_ids(data, lambda i: i % 2 == 1)
    key = lambda df, *c: [tuple(round(v, 9) if isinstance(v, float) else v for v in (r[x] for x in c)) for r in df.orderBy(*c).collect()]
    for k in (25, 400) if kind == "jaccard" else (25,):
        assert key(joins.top_k_join(data, None, q, k), "rank", "id1", "id2", "combined") == key(joins.top_k_join(data, None, q, k, plan="all"), "rank", "id1", "id2", "combined")
    assert key(joins.top_k_join(even, odd, q, 30), "rank", "id1", "id2") == key(joins.top_k_join(even, odd, q, 30, plan="all"), "rank", "id1", "id2")
    assert key(joins.nearest_join(even, odd, q, 3), "id1", "rank", "id2") == key(joins.nearest_join(even, odd, q, 3, plan="all"), "id1", "rank", "id2")


def joined_rows(spark, run):
    """The most rows that a join of the queries of ``run`` made."""
    store, listed = spark._jsparkSession.sharedState().statusStore(), spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    settle = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    settle()
    seen = max((e.executionId() for e in listed(store.executionsList())), default=-1)
    run()
    settle()
    made = [0]
    for e in listed(store.executionsList()):
        if e.executionId() > seen:
            values = listed(store.executionMetrics(e.executionId()))
            counters = [m.accumulatorId() for node in listed(store.planGraph(e.executionId()).allNodes()) if "Join" in node.name() for m in listed(node.metrics()) if m.name() == "number of output rows"]
            made += [int(values[c].replace(",", "")) for c in counters if c in values]
    return max(made)


def few_texts(spark):
    """600 objects of 12 texts over four common terms, some at places that others have."""
    rng = random.Random(17)
    texts = [[1, 2], [1, 3], [2, 3], [1, 2, 3], [1, 1, 2], [1, 1, 3], [2, 2, 3], [4, 1], [4, 4, 1], [4, 2], [4, 3], [1, 2, 3, 4]]
    rows = {i: (rng.randrange(40) / 2, rng.randrange(40) / 2, rng.choice(texts)) for i in range(590)}
    return data_of(spark, rows | {600 + i: (1.5, 2.5, [1, 2]) for i in range(10)}, 28.0)


def test_nearest_join_compares_no_pairs_of_all_that_share_a_common_term(spark):
    data = few_texts(spark)
    even, odd = objects.with_ids(data, lambda i: i % 2 == 0), objects.with_ids(data, lambda i: i % 2 == 1)
    assert joined_rows(spark, lambda: joins.nearest_join(even, odd, joins.JoinQuery("cosine"), 2).collect()) <= 300 * 12


@pytest.mark.parametrize(("kind", "alpha", "few", "many"), [("cosine", 0.5, 0, 10**9), ("cosine", 0.5, 0, 0), ("sum", 0.4, 0, 0), ("jaccard", 0.9, 10**9, 0)])
def test_nearest_join_by_levels_and_by_the_grid(spark, monkeypatch, kind, alpha, few, many):
    """Looks at lower and lower levels, at near places first or not, and cells of few places: the answers are those of all pairs."""
    for name, value in (("FEW_PAIRS", few), ("MANY_PLACES", many), ("PLACES", 3), ("CELL_PLACES", 2)):
        monkeypatch.setattr(joins, name, value)
    data, q = few_texts(spark), joins.JoinQuery(kind, alpha=alpha)
    even, odd = objects.with_ids(data, lambda i: i % 2 == 0), objects.with_ids(data, lambda i: i % 2 == 1)
    odd = SpatioTextual(odd.objects.where("id < 300 or id >= 600"), odd.weights, odd.max_distance)
    key = lambda df: [(r["id1"], r["rank"], r["id2"], round(r["combined"], 9)) for r in df.orderBy("id1", "rank").collect()]
    assert key(joins.nearest_join(even, odd, q, 3)) == key(joins.nearest_join(even, odd, q, 3, plan="all"))


def test_scores_that_do_not_count(spark):
    frame = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, -0.5), (4, 0.0), (5, None), (6, 0.25)], "id int, score double")
    assert [r["id"] for r in frame.where(similarity.sane(F.col("score"))).collect()] == [6]


def test_joins_that_refuse(eight):
    assert joins.top_k_join(eight, None, joins.JoinQuery("jaccard", "spatial"), 3).count() == 0
    assert joins.top_k_join(eight, None, joins.JoinQuery("jaccard"), 0).count() == 0
    assert joins.parse_mode(None) == "full" and joins.parse_mode("PARTIAL_JOIN") == "textual"
    with pytest.raises(ValueError):
        joins.parse_mode("nothing")


def test_join_without_text_and_at_no_distance(spark):
    data = data_of(spark, {1: (0, 0, [1]), 2: (0, 0, [2]), 3: (0, 2, [1])}, 10.0)
    near = joins.threshold_join(data, None, joins.JoinQuery(), 0, 0).collect()
    assert [(r["id1"], r["id2"], r["sim"]) for r in near] == [(1, 2, 1.0)]
    assert joins.threshold_join(data, None, joins.JoinQuery(), -1, 0).count() == 0


def test_points_of_a_place_are_compared_as_one(spark, monkeypatch):
    """Copies made a row for each pair in every join of the plan; ids beyond a block go on in further rows."""
    monkeypatch.setattr(spatial, "GATHERED", 4)
    places = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(30)], "id long, x double, y double")
    want = sorted((a, b, float(abs(a % 3 - b % 3))) for a in range(30) for b in range(a + 1, 30) if abs(a % 3 - b % 3) <= 1)
    rows = spatial.gathered(places)
    assert rows.count() == 9 and rows.agg(F.max(F.size("ids"))).first()[0] == 4
    assert spatial.place_pairs(rows, rows, 1.0, True).count() == 9 * 10 // 2 - 9
    for find in (spatial.point_pairs, spatial.nested_point_pairs):
        assert sorted(tuple(r) for r in find(places, places, 1.0, True).collect()) == want
    assert sorted((r["id1"], r["id2"]) for r in spatial.point_pairs(places.where("id < 6"), places, 0, False).collect()) == [(a, b) for a in range(6) for b in range(30) if a % 3 == b % 3]


def test_pair_joins_broadcast_no_cells(spark):
    """The nine-fold cells of a table whose estimate is small were broadcast, which took the driver's memory."""
    places = spark.range(200).select("id", (F.col("id") % 30).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    data = SpatioTextual(places, spark.range(200).select("id", F.concat(F.lit("t"), F.col("id") % 5).alias("term"), F.lit(0.5).alias("w")), 40.0)
    plans = [spatial.point_pairs(places, places, 2.0, True), joins.near_similarity(data, "cosine", 2.0), joins.near_set_distance(data, 2.0), joins.threshold_join(data, None, joins.JoinQuery(), 2.0, 0.0)]
    for found in plans:
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_common_terms_leave_the_grid_in_place(spark, monkeypatch):
    """Where all vectors share their terms, a join by terms compares all pairs: more than a full grid."""
    monkeypatch.setattr(joins, "GRID_PAIRS", 0.5)
    monkeypatch.setattr(joins, "_term_pairs", None)
    data = data_of(spark, {i: (i % 10, i // 10, [1, 2, i % 2 + 3]) for i in range(100)}, 14.0)
    q = joins.JoinQuery("jaccard")
    key = lambda df: sorted((r["id1"], r["id2"], round(r["combined"], 9)) for r in df.collect())
    assert key(joins.threshold_join(data, None, q, 2.0, 0.3)) == key(joins.threshold_join(data, None, q, 2.0, 0.3, plan="nested"))


def copies(spark, n):
    """40 places and texts, n objects of each; each text has two terms of its own, one that another has and one that all have: only copies have a similarity of 0.3."""
    rows = {i: (i % 40 % 8, i % 40 // 8, [1, 100 + i % 40, 200 + i % 40, 300 + i % 20]) for i in range(40 * n)}
    return data_of(spark, rows, 12.0)


def test_copies_do_not_count_for_the_choice_of_plan(spark, monkeypatch):
    """Copies of places and texts made the join by terms, which compares each of them, seem the smaller."""
    monkeypatch.setattr(joins, "_term_pairs", None)
    data, q = copies(spark, 30), joins.JoinQuery("jaccard")
    found = joins.threshold_join(data, None, q, 20.0, 0.3)
    assert found.count() == 40 * 30 * 29 // 2


@pytest.mark.parametrize(("kind", "packed", "in_a_row"), [("jaccard", 8, 2), ("sum", 8, 64), ("cosine", 8, 2), ("sum", 0, 64)])
def test_vectors_of_a_place_are_compared_in_its_row(spark, monkeypatch, kind, packed, in_a_row):
    """Packed or as arrays, in one row or several, for one set or two: the pairs are those of joins on the term."""
    monkeypatch.setattr(joins, "PACKED", packed)
    monkeypatch.setattr(joins, "PLACE_VECTORS", in_a_row)
    few = few_texts(spark)
    data = SpatioTextual(few.objects.where("id < 200 or id >= 600").select("id", (F.floor("x") - F.floor("x") % 4).alias("x"), (F.floor("y") - F.floor("y") % 4).alias("y")), few.weights, few.max_distance)
    q = joins.JoinQuery(kind)
    key = lambda df: sorted((r["id1"], r["id2"], round(r["sim"], 9)) for r in df.collect())
    even, odd = objects.with_ids(data, lambda i: i % 2 == 0), objects.with_ids(data, lambda i: i % 2 == 1)
    for left, right in ((data, None), (even, odd)):
        near = spatial.point_pairs(left.objects, (right or left).objects, 4.0, right is None)
        want = key(joins.document_similarity(near, left, right or left, kind).where("sim >= 0.3"))
        assert want and key(joins.threshold_join(left, right, q, 4.0, 0.3, plan="grid")) == want


def test_terms_of_one_hash_are_not_packed(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [("a", 0.5), ("b", 0.5)]), (2, [("c", 0.5)])], "id long, v array<struct<term string, w double>>")
    assert joins._packed_width(rows, rows) == 2
    monkeypatch.setattr(F, "xxhash64", lambda c: F.lit(7).cast("long"))
    assert joins._packed_width(rows, rows) is None


def test_similarity_is_computed_once(spark):
    """Filters and projections over it repeated the comparison of the vectors."""
    side = joins._Side(*[few_texts(spark)] * 2)
    rows = spark.createDataFrame([(i, 0.0, 0.0, [i], i, [(str(t), 0.5) for t in range(12)]) for i in range(3)], "id long, x double, y double, ids array<long>, key long, v array<struct<term string, w double>>").drop("id")
    found = joins._near(side, side, joins.JoinQuery("jaccard"), 1.0, 0.3, rows=(rows, rows))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 3 and plan.count("try_element_at") + plan.count("element_at") <= 2 and plan.count("aggregate(v1") == 1


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(3)
    some = [rng.uniform(-400, 400) for _ in range(2000)] + [rng.randrange(-(10**7), 10**7) / 1e7 for _ in range(2000)] + [1.0000005, -1.0000005, 2.5e-7, 5e-7, -5e-7, 1e300, 123456789.1234565, 0.0, -0.0, float("nan"), float("inf")]
    rows = spark.createDataFrame([(v,) for v in some + [None]], "v double")
    assert rows.where(~joins._round(F.col("v"), 6).eqNullSafe(F.round("v", 6))).count() == 0


def test_top_k_fixtures(spark):
    one = data_of(spark, {100: (0, 0, [7001, 7100]), 101: (0, 0.2, [7001, 7101]), 102: (0, 1, [7001, 7102]), 103: (5, 5, [7999])}, 10.0)
    assert joins.top_k_join(one, None, joins.JoinQuery(), 2).count() == 2
    two = data_of(spark, {10: (0, 0, [9001]), 11: (0, 0.05, [9001]), 20: (100, 100, [9002]), 21: (100, 100.05, [9002])}, 150.0)
    best = joins.top_k_join(two, None, joins.JoinQuery("sum", "textual", (("9001", 1.0),)), 1).collect()
    assert [(r["id1"], r["id2"]) for r in best] == [(10, 11)]


def test_two_sets_with_overlapping_ids(spark):
    p = data_of(spark, {1: (0, 0, [2001, 2101]), 2: (0, 1, [2102])}, 10.0)
    s = data_of(spark, {1: (0, 0.3, [2001, 2201]), 2: (0, 1.3, [2202])}, 10.0)
    assert joins.threshold_join(p, s, joins.JoinQuery("jaccard", "textual", (("9999", 1.0),)), 3, 1e-6).count() == 0
    assert [(r["id1"], r["id2"]) for r in joins.threshold_join(p, s, joins.JoinQuery(), 3, 1e-6).collect()] == [(1, 1)]


def members(spark, weights_=(1.0, 0.5, 2.0)):
    rows = [{"qid": i, "weight": w, "x": 10.0 * i, "y": 20.0, "keywords": [(str(t), 0.5)]} for i, w, t in zip((1, 2, 3), weights_, (101, 102, 103), strict=True)]
    return place_frame(spark, rows).withColumn("gid", F.lit(1)), query_frame(spark, rows).drop("weight", "x", "y")


@pytest.mark.parametrize("name", ["SUM", "max"])
def test_groups(spark, eight, name):
    key = lambda df: [(r["size"] if "size" in r else 3, r["id"], round(r["cost"], 9), r["member_ids"]) for r in df.orderBy("rank").collect()]
    every = group.subgroup_nearest(eight, *members(spark), 1, 4, name, up_to=3)
    each = group.subgroup_nearest_each(eight, *members(spark), 1, 3, 4, name=name)
    assert sorted(key(every)) == sorted(key(each))
    whole = [(i, c) for _, i, c, _ in key(group.group_nearest(eight, *members(spark), 4, name))]
    assert whole == [(i, c) for s, i, c, _ in key(every) if s == 3]
    assert all(len(m.split(",")) == s for s, _, _, m in key(every))
    with pytest.raises(ValueError):
        group.subgroup_nearest(eight, *members(spark), 4, 1)
    with pytest.raises(ValueError):
        group.aggregator("MEDIAN")


def test_many_members_go_in_blocks(spark, eight):
    rows = [{"qid": 10 * g + i, "gid": g, "weight": 1.0, "x": 10.0 * i, "y": 20.0 - g, "keywords": [(str(101 + (g + i) % 4), 0.5)]} for g in range(5) for i in range(3)]
    gids = spark.createDataFrame([(r["qid"], r["gid"]) for r in rows], "qid int, gid int")
    who, asked = place_frame(spark, rows).join(gids, "qid"), query_frame(spark, rows).drop("weight", "x", "y")
    key = lambda df: sorted((r["gid"], r["rank"], r["id"], round(r["cost"], 9), r["member_ids"]) for r in df.collect())
    whole = key(group.group_nearest(eight, who, asked, 2))
    assert len(whole) == 10 and key(group.group_nearest(eight, who, asked, 2, block=4)) == whole
    assert key(group.subgroup_nearest(eight, who, asked, 2, 2, "MAX", block=1)) == key(group.subgroup_nearest(eight, who, asked, 2, 2, "MAX"))


def test_many_query_keywords(spark):
    asked = query_frame(spark, [{"qid": 1, "x": 0, "y": 0, "keywords": [(f"k{i}", 1.0) for i in range(100_001)]}])
    assert asked.count() == 100_001


def test_max_takes_the_worst_member(spark, eight):
    best = group.group_nearest(eight, *members(spark), 8, "MAX").collect()
    costs_ = group.member_costs(eight, *members(spark)).collect()
    for r in best:
        assert r["cost"] == pytest.approx(max(c["cost"] * c["weight"] for c in costs_ if c["id"] == r["id"]))


def box_rows(spark, rows):
    return spark.createDataFrame([(i, *map(float, b)) for i, b in rows], "id long, xlo double, ylo double, xhi double, yhi double")


def test_box_joins(spark):
    r = box_rows(spark, [(1, (0, 0, 2, 2)), (2, (1, 1, 3, 3)), (3, (1.5, 1.5, 2.5, 2.5)), (4, (4, 4, 5, 5)), (5, (4.5, 4.5, 5.5, 5.5)), (6, (7, 7, 8, 8)), (7, (2, 0, 2.1, 0.1))])
    found = {(x["id1"], x["id2"]) for x in spatial.self_join_intersection(r, G.fixed_box(0, 0, 8, 8)).collect()}
    assert found == {(1, 2), (1, 3), (2, 3), (4, 5), (1, 7)}
    assert spatial.self_join_intersection(r, G.fixed_box(9, 9, 10, 10)).count() == 0
    for size in (0.3, 1.0, 20.0):
        near = {(x["id1"], x["id2"]) for x in spatial.self_join_distance(r, G.fixed_box(0, 0, 8, 8), 1.5, size).collect()}
        assert near == found | {(2, 4), (2, 7), (3, 7)}


def test_box_distance_join_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, (x := rng.uniform(-9, 9), y := rng.uniform(-9, 9), x + rng.uniform(0, 2), y + rng.uniform(0, 2))) for i in range(80)]
    far = lambda a, b: math.hypot(max(b[0] - a[2], a[0] - b[2], 0), max(b[1] - a[3], a[1] - b[3], 0))
    for reach in (0.0, 0.7, 3.0):
        want = {(i, j) for i, a in rows for j, b in rows if i < j and far(a, b) <= reach}
        assert {(x["id1"], x["id2"]) for x in spatial.self_join_distance(box_rows(spark, rows), G.fixed_box(-20, -20, 20, 20), reach).collect()} == want


def test_nearest_keeps_ties(spark):
    r = box_rows(spark, [(1, (1, 1, 1, 1)), (2, (10, 10, 10, 10)), (3, (20, 20, 20, 20)), (4, (30, 30, 30, 30)), (5, (10, 10, 10, 10))])
    at = G.fixed_box(0, 0, 0, 0)
    assert {x["id"] for x in spatial.nearest(r, at, 2).collect()} == {1, 2, 5}
    assert spatial.nearest(r, at, 9).count() == 5
    with pytest.raises(ValueError):
        spatial.nearest(r, at, 0)


def test_insert_and_delete(spark):
    r = box_rows(spark, [(1, (0, 0, 1, 1)), (2, (2, 2, 3, 3))])
    assert {x["id"] for x in spatial.delete(spatial.insert(r, box_rows(spark, [(3, (5, 5, 6, 6))])), box_rows(spark, [(1, (0, 0, 1, 1)), (2, (0, 0, 1, 1))])).collect()} == {2, 3}


def test_geometry(spark):
    a, b = G.fixed_box(0, 0, 2, 2), G.fixed_box(3, 6, 4, 7)
    row = spark.range(1).select(
        G.min_distance(a, b).alias("near"), G.max_distance(a, b).alias("far"), G.margin(a).alias("margin"), G.intersection(a, b).xlo.alias("none"), G.touches(a, G.fixed_box(0, 9, 9, 11)).alias("touch"),
        G.same_point(G.Point(F.lit(1.0), F.lit(1.0)), G.Point(F.lit(1.0), F.lit(1.0 + 1e-8))).alias("same"), costs.combined_cost(F.lit(3.0), F.lit(0.4), 0.5, 0.0).alias("text"),
    ).first()
    assert row["near"] == pytest.approx(math.hypot(1, 4)) and row["far"] == pytest.approx(math.hypot(4, 7)) and row["margin"] == 8
    assert row["none"] is None and row["touch"] and row["same"] and row["text"] == pytest.approx(0.6)
    assert costs.relevance_floor(0.2, 0.5) == pytest.approx(0.6) and costs.distance_ceiling(0.2, 0.0, 1.0) == math.inf


def test_set_distance(spark):
    ids = lambda *v: F.array(*map(F.lit, v)).cast("array<int>")
    row = spark.range(1).select(costs.set_distance(ids(1, 2), ids(2, 3)).alias("a"), costs.set_distance(ids(), ids(1)).alias("b"), costs.set_distance(ids(), ids()).alias("c")).first()
    assert row["a"] == pytest.approx(2 / 3) and row["b"] == 1.0 and row["c"] == 0.0


def test_clustered_relevance(spark):
    w = spark.createDataFrame([(1, "100", 0.4, 0), (1, "200", 0.9, 1)], "id long, term string, w double, cluster int")
    q = query_frame(spark, [{"qid": 1, "x": 0, "y": 0, "keywords": [("100", 1.0), ("200", 1.0)]}])
    data = SpatioTextual(spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double"), w, 1.0)
    assert ranking.relevance(data, q, "precise", by_cluster=True).first()["ir"] == pytest.approx(0.9)


def test_scans(spark, tmp_path):
    (tmp_path / "loc.csv").write_text("3,1.5,2\n1,4,5,extra\nbad,1,2\n2,7\n1,9,9\n4,x,1\n")
    assert sorted(map(tuple, objects.read_places(spark, str(tmp_path / "loc.csv")).collect())) == [(1, 4.0, 5.0), (3, 1.5, 2.0)]
    (tmp_path / "kw.csv").write_text("1,5,5,6\n2\n1,9\n3,7\n")
    assert sorted(map(tuple, objects.read_keywords(spark, str(tmp_path / "kw.csv")).collect())) == [(1, "5"), (1, "5"), (1, "6"), (3, "7")]


def test_samplers(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    ids = lambda df: sorted(r["k"] for r in df.collect())
    assert ids(sampling.systematic(rows, ["k"], 0.1)) == [i for i in range(100) if (i + 1) * 10 // 100 > i * 10 // 100]
    assert ids(sampling.contiguous(rows, ["k"], 0.1, 95)) == list(range(90, 100))
    assert ids(sampling.contiguous(rows, ["k"], 2.0, -5)) == list(range(100))
    assert ids(sampling.randomised(rows, "k", 0.3, 1)) == ids(sampling.randomised(rows.repartition(7), "k", 0.3, 1))
    assert sampling.target_size(10, 0.25) == 3 and sampling.systematic(rows.limit(0), ["k"], 0.5).count() == 0


def test_validation(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (5, 5)], "id long, line int")
    assert {(r["line"], r["new_id"]) for r in validation.repair(rows, "line").collect()} == {(1, 1), (2, 6), (3, 2), (4, 7), (5, 5)}
    many = spark.range(4000).select((F.col("id") % 3).alias("id"), (F.col("id") * 7 % 4001).alias("line"))
    want, seen, top = {}, set(), 2
    for r in sorted(many.collect(), key=lambda r: r["line"]):
        top += r["id"] in seen
        want[r["line"]] = top if r["id"] in seen else r["id"]
        seen.add(r["id"])
    assert {r["line"]: r["new_id"] for r in validation.repair(many, "line").collect()} == want
    same = spark.createDataFrame([(1,), (2,)], "id long")
    assert validation.validate(same, same).first()["valid"] and not validation.validate(rows, same).first()["valid"]


def test_kmeans(spark):
    rows = [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.9), (2, 8, 1.0), (2, 9, 1.0), (3, 8, 0.8), (3, 9, 1.0)]
    w = spark.createDataFrame([(i, str(t), v) for i, t, v in rows], "id long, term string, w double")
    for init in clustering.INITS:
        first = {r["id"]: r["cluster"] for r in clustering.spherical_kmeans(w, 2, seed=1, init=init).collect()}
        assert first == {r["id"]: r["cluster"] for r in clustering.spherical_kmeans(w.repartition(3), 2, seed=1, init=init).collect()}
        assert len(first) == 4 and set(first.values()) <= {0, 1}
    plus = {r["id"]: r["cluster"] for r in clustering.spherical_kmeans(w, 2, seed=3).collect()}
    assert plus[0] == plus[1] != plus[2] == plus[3]
    for bad, k in ((w, 5), (w, 0), (w.limit(0), 1)):
        with pytest.raises(ValueError):
            clustering.spherical_kmeans(bad, k)
    with pytest.raises(ValueError):
        clustering.spherical_kmeans(w, 2, init="other")


def test_kmeans_against_plain_code(spark):
    """Rounds of assignment and means from the same start; an empty centre starts from a document again."""
    rng = random.Random(4)
    vectors = {i: {str(rng.randrange(12)): rng.uniform(0.1, 1) for _ in range(4)} for i in range(30)}
    w = spark.createDataFrame([(i, t, v) for i, d in vectors.items() for t, v in d.items()], "id long, term string, w double")
    norm = lambda d: math.sqrt(sum(v * v for v in d.values()))
    cos = lambda a, b: round(sum(v * b.get(t, 0) for t, v in a.items()) / (norm(a) * norm(b)), 12)
    norms = clustering._norms(w, "id")
    centres = clustering.centres_of(w, [3, 8, 21])
    plain = [vectors[i] for i in (3, 8, 21)]
    for _ in range(3):
        placed = clustering.assign(w, norms, centres)
        want = {i: max(range(3), key=lambda k: (cos(d, plain[k]), -k)) for i, d in vectors.items()}
        assert {r["id"]: r["cluster"] for r in placed.collect()} == want
        groups = [[vectors[i] for i in vectors if want[i] == k] for k in range(3)]
        plain = [{t: sum(d.get(t, 0) for d in g) / len(g) for t in {t for d in g for t in d}} for g in groups]
        centres = clustering.means(w, placed)
    same = spark.createDataFrame([(i, "a", 1.0) for i in range(5)], "id long, term string, w double")
    found = clustering.spherical_kmeans(same, 3, seed=2, iterations=4)
    assert {r["cluster"] for r in found.collect()} == {0} and found.count() == 5


def test_partition_quality(spark):
    boxes = box_rows(spark, [(1, (0, 0, 2, 2)), (2, (0, 1, 1, 6)), (3, (8, 0, 9, 1)), (4, (8, 9, 10, 10))])
    tiles = {(r["tile_x"], r["tile_y"]): r for r in spatial.partition_quality(boxes, 2, 2, "grid").collect()}
    assert {k: r["n"] for k, r in tiles.items()} == {(0, 0): 2, (1, 0): 1, (1, 1): 1}
    assert [tiles[k]["overlap"] for k in ((0, 0), (1, 0))] == [0.0, 0.0] and not any(r["violation"] for r in tiles.values())
    tall = box_rows(spark, [(1, (0, 0, 2, 6)), (2, (0, 5, 2, 9)), (3, (9, 0, 10, 1))])
    row = spatial.quality_summary(spatial.partition_quality(tall, 2, 4, "grid")).first()
    assert (row["tiles"], row["entries"], row["overlap"], row["violations"]) == (3, 3, 2.0, 0)
    points = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(35)], "id long, x double, y double")
    assert sum(r["n"] for r in spatial.partition_quality(points, 3, 2).collect()) == 35
    with pytest.raises(ValueError):
        spatial.partition_quality(points, 2, 2, "other")


def test_generator():
    source = generate.Source.of((0, 0, 100, 50), [(1, 1), (99, 49)], ["a", "b"], [*(f"w{i}" for i in range(48)), "a", "b"])
    one, two = (generate.Generator(source, 4).single(5, 4, 0.01, 20) for _ in range(2))
    assert one == two
    for q in one:
        assert sum(w for _, w in q["keywords"]) == pytest.approx(1) and len({t for t, _ in q["keywords"]}) == 4
        assert 0 <= q["x"] <= 100 and 0 <= q["y"] <= 50
    for g in generate.Generator(source, 4).groups(2, 3, 2, 4, 20):
        assert g["weight"] == pytest.approx(1 / 3)
    for j in generate.Generator(source, 4).joins(3, 4, 0.01, 20, dense=False):
        assert 0 <= j["window"][0] <= j["window"][2] <= 100
    assert generate.subgroup_size(10, 60) == 6 and generate.area_fraction(4) == 0.04


def test_vocabulary_beyond_ten_thousand_words(spark):
    words = [f"{chr(97 + i % 26)}{i:06d}é" for i in range(12_000)] + ["", "x", "日本"]
    terms = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, term string")
    ranked = {r["i"]: r["term"] for r in harness.ranked_vocabulary(terms).collect()}
    assert [ranked[i] for i in range(len(words))] == sorted(words)
    places = terms.select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    source = harness.source_of(SpatioTextual(places, terms, 1.0), terms, (0, 0, 10, 10))
    assert source.size == len(words) and source.words([0, 11_999]) == {0: "", 11_999: ranked[11_999]}
    drawn = [generate.Generator(source, s).keywords(4, 1) for s in range(3)]
    assert all(len(set(d)) == 4 and set(d) <= set(words) for d in drawn)


def test_config_and_sweep():
    c = config.load('{"dataset": "SPORTS", "secondary": {"name": "PART", "usage": 0.5}, "smoothing": 0, "params": {"numberOfKeywords": 2}, "sweeps": {"topk": [1, 5]}, "overrides": {"ranked": {"alpha": 0.9}}}')
    assert c.smoothing == 0.2 and c.params.keywords == 2 and config.load(config.save(c)) == c
    assert c.dataset.name == "SPORTS" and c.secondary.share == 0.5 and config.DatasetConfig(usage=7).share == 1.0
    plans = list(harness.sweep(c, "ranked"))
    assert [(n, v, p.k, p.alpha) for n, v, p in plans] == [("defaults", "", 10, 0.9), ("k", 1, 1, 0.9), ("k", 5, 5, 0.9)]
    both = config.Config(sweeps={"join_distance": [1.0, 2.0, 3.0], "join_similarity": [0.1, 0.2], "combined": True})
    found = [(v, p.join_distance, p.join_similarity) for n, v, p in harness.sweep(both, "join") if n == "combined"]
    assert found == [("1.000 / 0.10", 1.0, 0.1), ("2.000 / 0.20", 2.0, 0.2)]
    pairs = config.Config(sweeps={"combined": [[0.5, 0.9]]})
    assert [v for n, v, _ in harness.sweep(pairs, "join") if n == "combined"] == ["0.500 / 0.90"]


def test_experiment_over_two_data_sets(spark, tmp_path):
    (tmp_path / "p.csv").write_text("".join(f"{i},{i % 9},{i % 7}\n" for i in range(60)))
    (tmp_path / "k.csv").write_text("".join(f"{i},red,t{i % 5}\n" for i in range(60)))
    files = config.DatasetConfig("HOTELS", str(tmp_path / "p.csv"), str(tmp_path / "k.csv"), 0.5)
    data, terms, box = harness.load_dataset(spark, "", files, 0.2)
    assert data.objects.count() == 30 and box == (-159.0, 19.0, -68.0, 70.0) and data.max_distance == pytest.approx(math.hypot(91, 51))
    c = config.Config(dataset=config.DatasetConfig("", str(tmp_path / "p.csv"), str(tmp_path / "k.csv")), secondary=files, params=config.QueryParams(join_distance=1.5, join_similarity=0.1, keyword_space=100, keywords=2), experiments=["join_two", "ranked"], iterations=2)
    metrics = harness.run(spark, c, "")
    rows = metrics.where("experiment = 'join_two'").collect()
    assert len(rows) == 2 and rows[0]["rows"] == rows[1]["rows"] > 0 and rows[0]["scanned"] > 0 and rows[0]["spatial"] is not None
    shown = harness.detailed(metrics)
    assert shown.columns == ["queryType", "value", "numIterations", "totalTimeMs", "medianTimeMs", "minTimeMs", "maxTimeMs", "avgTimeMs", "totalNodesVisited", "avgNodesVisited", "avgSpatialCost", "avgTextualCost", "avgIRCost", "totalResults", "avgResults", "totalReturnedPairs", "avgReturnedPairs", "memoryDeltaBytes"]
    assert [(r["queryType"], r["value"], r["numIterations"]) for r in shown.collect()] == [("join_two", "default", 2), ("ranked", "default", 2)]
    with pytest.raises(ValueError):
        harness.load_dataset(spark, "", config.DatasetConfig("PARKS"), 0.2)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.5)], "iteration int, swept string, seconds double")
    assert writers.metrics_table(rows).columns == ["iteration", "a", "b"]
    writers.write_results(rows, str(tmp_path / "out"), ";", ",")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "1;a;0,5" in text
    writers.write_text(rows, str(tmp_path / "lines"))
    assert "plot" in writers.plot_script("t", "f.csv", ["a", "b"])
