"""Queries over the driver's tables, by name, and the SQL that says the same.

Objects are the parts, placed by a formula of their key, with the words of their name, type and brand as
terms; text-rich queries use the documents. Each SQL text is written from the definitions, by plain joins
over all pairs, and shares no plan with the DataFrame code. Doubles are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs
from ..functions import geometry as G
from ..operators import boolean, clustering, group, joins, ranking, spatial, weights
from ..operators.frame import SpatioTextual, place_frame, query_frame, shared_folder
from ..sources import config, objects, sampling, validation
from . import generate, harness

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SINGLE = [
    {"qid": 1, "x": 10.0, "y": 20.0, "keywords": [("red", 0.6), ("gear", 0.4)]},
    {"qid": 2, "x": -60.0, "y": 40.0, "keywords": [("small", 0.5), ("plate", 0.3), ("promo", 0.2)]},
    {"qid": 3, "x": 120.0, "y": -30.0, "keywords": [("blue", 1.0)]},
]
TEXTUAL = [
    {"qid": 1, "x": 0.0, "y": 0.0, "keywords": [("the", 0.3), ("and", 0.7)]},
    {"qid": 2, "x": -90.0, "y": 10.0, "keywords": [("und", 0.5), ("die", 0.5)]},
]
MEMBERS = [
    (1, 1, 1.0, 10.0, 20.0, (("red", 0.6), ("gear", 0.4))),
    (1, 2, 0.5, 30.0, 10.0, (("blue", 0.5), ("bolt", 0.5))),
    (1, 3, 2.0, -20.0, 35.0, (("hot", 1.0),)),
    (2, 4, 1.0, -100.0, -40.0, (("small", 0.7), ("ring", 0.3))),
    (2, 5, 1.0, -80.0, -45.0, (("anvil", 1.0),)),
    (2, 6, 1.0, -95.0, -20.0, (("promo", 0.5), ("new", 0.5))),
]
KEYWORDS = (("red", 0.8), ("small", 0.6), ("promo", 0.5), ("gear", 0.3))
WINDOW = (-90.0, -60.0, 120.0, 70.0)
ALPHA, REACH, FLOOR, TOP = 0.5, 5.0, 0.3, 20


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- the data, in Spark ---


_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, d: str, name: str, terms: Callable[[], DataFrame], smoothing: float = 0.0) -> DataFrame:
    """The weights of a collection, written in the order of terms when a session first asks for them: its queries share them like an index."""
    key = (spark.sparkContext.applicationId, d, name, smoothing)
    if key not in _stored:
        path = f"{shared_folder(spark)}/weights-{name}-{uuid.uuid4().hex}"
        weights.store(weights.tfidf(terms(), smoothing), path)
        _stored[key] = path
    return weights.load(spark, _stored[key])


def parts(spark: SparkSession, d: str) -> SpatioTextual:
    return objects.world(objects.part_objects(spark, d), stored(spark, d, "part", lambda: objects.part_terms(spark, d)))


def documents(spark: SparkSession, d: str) -> SpatioTextual:
    return objects.world(objects.document_objects(spark, d), stored(spark, d, "documents", lambda: objects.document_terms(spark, d)))


def halves(spark: SparkSession, d: str) -> tuple[SpatioTextual, SpatioTextual]:
    data = parts(spark, d)
    return objects.with_ids(data, lambda i: i % 2 == 0), objects.with_ids(data, lambda i: i % 2 == 1)


def clustered(data: SpatioTextual) -> SpatioTextual:
    """Postings with a cluster number, by the object's id and the term's length, so that an object has postings in several."""
    return SpatioTextual(data.objects, data.weights.withColumn("cluster", ((F.col("id") + F.length("term")) % 3).cast("int")), data.max_distance)


def members(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [{"qid": q, "weight": w, "x": x, "y": y, "keywords": kw} for _, q, w, x, y, kw in MEMBERS]
    gids = spark.createDataFrame([(q, g) for g, q, *_ in MEMBERS], "qid int, gid int")
    return place_frame(spark, rows).join(F.broadcast(gids), "qid"), query_frame(spark, rows).drop("weight", "x", "y")


# --- the data, in SQL ---


def place_sql(table: str, key: str) -> str:
    return f"""SELECT {key} AS id, (({key}*{key}*31 + {key}*7919) % 36000) / 1e2 - 180 AS x, (({key}*{key}*17 + {key}*104729) % 18000) / 1e2 - 90 AS y FROM {table}"""


PART_TERMS = "SELECT p_partkey AS id, unnest(list_concat(string_split(p_name, ' '), [lower(p_type), lower(p_brand)])) AS term FROM part"
DOC_TERMS = "SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents"
STATS = """tf AS (SELECT id, term, count(*) AS f FROM terms GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df, sum(f) AS cf FROM tf GROUP BY term),
st AS (SELECT tf.id, tf.term, f, df, cf, max(f) OVER (PARTITION BY tf.id) AS max_f, sum(f) OVER (PARTITION BY tf.id) AS len, n, total
  FROM tf JOIN dfs USING (term), (SELECT count(DISTINCT id) AS n, count(*) AS total FROM terms))"""


def weights_sql(smoothing: float = 0.0) -> str:
    raw = "(1e-1 + 9e-1 * f / max_f) * (1 + ln(n / df::DOUBLE)) * (1 + ln(1 + f))"
    if smoothing:
        raw = f"{1 - smoothing}::DOUBLE * ({raw}) + {smoothing}::DOUBLE * (cf / (n * len)::DOUBLE)"
    return f"{STATS},\nraw AS (SELECT id, term, {raw} AS r FROM st),\nwt AS (SELECT id, term, 1e-1 + 9e-1 * sqrt(r / max(r) OVER (PARTITION BY id)) AS w FROM raw)"


PARTS = f"objects AS ({place_sql('part', 'p_partkey')}),\nterms AS ({PART_TERMS}),\n{weights_sql()}"
DOCS = f"objects AS ({place_sql('documents', 'doc_id')}),\nterms AS ({DOC_TERMS}),\n{weights_sql()}"
MAX_DISTANCE = "sqrt(360.0 * 360 + 180 * 180)"


def values(rows) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return ", ".join(f"({', '.join(map(show, r))})" for r in rows)


def queries_sql(queries: list[dict]) -> str:
    rows = [(q["qid"], q["x"], q["y"], t, w) for q in queries for t, w in q["keywords"]]
    return f"q(qid, x, y, term, qw) AS (VALUES {values(rows)}),\nplaces AS (SELECT DISTINCT qid, x, y FROM q)"


DIST = "sqrt(({0}.x - {1}.x) * ({0}.x - {1}.x) + ({0}.y - {1}.y) * ({0}.y - {1}.y))"


def cost_sql(dist: str, ir: str, alpha: float = ALPHA) -> str:
    return f"({alpha}::DOUBLE * ({dist}) / {MAX_DISTANCE} + {1 - alpha}::DOUBLE * (1 - ({ir})))"


# --- sources ---


@query("scan_terms", f"WITH terms AS ({DOC_TERMS}) SELECT id, term, count(*) AS n FROM terms GROUP BY id, term")
def _(s, d):
    return objects.document_terms(s, d).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("scan_places", f"SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM ({place_sql('documents', 'doc_id')})")
def _(s, d):
    return rounded(objects.document_objects(s, d))


def written_lines(lines: DataFrame, name: str) -> str:
    """One text file of the lines (order, value) in their order, in the shared folder."""
    path = f"{shared_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.orderBy("line").select("value").coalesce(1).write.text(path)
    return path


@query("csv_places", f"SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM ({place_sql('documents', 'doc_id')})")
def _(s, d):
    """Places written as lines and scanned again: repeated ids, short lines and bad numbers go."""
    places = objects.document_objects(s, d)
    good = places.select(F.col("id").alias("line"), F.concat_ws(",", "id", "x", "y").alias("value"))
    again = places.where("id % 3 = 0").select((F.col("id") + 10_000_000).alias("line"), F.concat_ws(",", "id", F.lit("1.5"), F.lit("2.5"), F.lit("more")).alias("value"))
    short = places.where("id % 5 = 0").select((-1 - F.col("id")).alias("line"), F.concat_ws(",", F.col("id") + 50_000_000, F.lit("7")).alias("value"))
    bad = places.where("id % 7 = 0").select((-1 - F.col("id")).alias("line"), F.concat_ws(",", F.col("id") + 60_000_000, F.lit("x"), F.lit("3")).alias("value"))
    return rounded(objects.read_places(s, written_lines(good.unionByName(again).unionByName(short).unionByName(bad), "places")))


@query("csv_keywords", f"WITH terms AS ({DOC_TERMS}) SELECT id, term, count(*) AS n FROM terms GROUP BY id, term")
def _(s, d):
    """Term lines written and scanned again, with later lines of the same ids, which go."""
    lists = objects.document_terms(s, d).groupBy("id").agg(F.concat_ws(",", F.collect_list("term")).alias("t"))
    good = lists.select(F.col("id").alias("line"), F.concat_ws(",", "id", "t").alias("value"))
    again = lists.where("id % 3 = 0").select((F.col("id") + 10_000_000).alias("line"), F.concat_ws(",", "id", F.lit("later")).alias("value"))
    terms = objects.read_keywords(s, written_lines(good.unionByName(again), "keywords"))
    return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("validate_good", "SELECT count(*) AS place_lines, count(*) AS keyword_lines, 0::BIGINT AS repeated_places, 0::BIGINT AS repeated_keywords, 0::BIGINT AS only_places, 0::BIGINT AS only_keywords, true AS valid FROM part")
def _(s, d):
    ids = objects.part_objects(s, d).select("id")
    return validation.validate(ids, ids)


@query("first_wins", "SELECT k, arg_min(c, ts) AS c FROM (SELECT o_custkey AS k, o_orderkey AS c, o_orderkey AS ts FROM orders) GROUP BY k")
def _(s, d):
    rows = objects.table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("c"), F.col("o_orderkey").alias("ts"))
    return objects.first_wins(rows, "k", ["ts"])


@query("sample_systematic", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE ((i + 1) * ceil(n * 7e-2)::BIGINT) // n > (i * ceil(n * 7e-2)::BIGINT) // n")
def _(s, d):
    return sampling.systematic(objects.table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.07)


@query("sample_contiguous", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE i >= least(1000000, n - ceil(n * 5e-2)) AND i < least(1000000, n - ceil(n * 5e-2)) + ceil(n * 5e-2)")
def _(s, d):
    return sampling.contiguous(objects.table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.05, 1_000_000)


@query("sample_randomised")
def _(s, d):
    return sampling.randomised(objects.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 0.1, 42)


@query("target_size", "SELECT share, CASE WHEN share >= 1 THEN n ELSE ceil(n * share)::BIGINT END AS m FROM (SELECT count(*) AS n FROM orders), (VALUES (0.25::DOUBLE), (0.333::DOUBLE), (1.0::DOUBLE)) v(share)")
def _(s, d):
    n = objects.table(s, d, "orders").count()
    return s.createDataFrame([(v, sampling.target_size(n, v)) for v in (0.25, 0.333, 1.0)], "share double, m long")


@query("validate_dataset", """WITH p AS (SELECT o_custkey AS id, count(*) AS p FROM orders GROUP BY 1), k AS (SELECT c_custkey AS id, count(*) AS k FROM customer GROUP BY 1), b AS (SELECT p, k FROM p FULL JOIN k USING (id))
SELECT sum(p)::BIGINT AS place_lines, sum(k)::BIGINT AS keyword_lines, sum(coalesce(p - 1, 0))::BIGINT AS repeated_places, sum(coalesce(k - 1, 0))::BIGINT AS repeated_keywords,
 sum((k IS NULL)::INT)::BIGINT AS only_places, sum((p IS NULL)::INT)::BIGINT AS only_keywords, false AS valid FROM b""")
def _(s, d):
    return validation.validate(objects.table(s, d, "orders").select(F.col("o_custkey").alias("id")), objects.table(s, d, "customer").select(F.col("c_custkey").alias("id")))


@query("repair_dataset", """WITH r AS (SELECT o_custkey AS id, o_orderkey AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, max(o_custkey) OVER () AS top FROM orders),
a AS (SELECT id, line, top + row_number() OVER (ORDER BY line) AS new_id FROM r WHERE k > 1) SELECT id, line, id AS new_id FROM r WHERE k = 1 UNION ALL SELECT * FROM a""")
def _(s, d):
    return validation.repair(objects.table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("line")), "line")


#: What the catalogue must have (fixed values): name, extent, objects, vocabulary.
CATALOGUE = [
    ("PAPER", 0.0, 0.0, 27.0, 30.0, 7, 5), ("TESTING", -4.0, -5.0, 8.0, 5.0, 10, 7), ("ORIGINAL", -4.0, -5.0, 5.0, 5.0, 8, 6), ("HOTELS", -159.0, 19.0, -68.0, 70.0, 20000, 600),
    ("POSTAL_CODES", -176.0, -55.0, 180.0, 74.0, 171000, 549405), ("SPORTS", -180.0, -90.0, 180.0, 79.0, 1750000, 452950), ("PARKS", -180.0, -90.0, 180.0, 81.0, 9960000, 1002722),
]


@query("catalogue", f"SELECT name, xlo, ylo, xhi, yhi, objects, vocabulary, round(sqrt((xhi - xlo) * (xhi - xlo) + (yhi - ylo) * (yhi - ylo)), 6) AS diagonal FROM (VALUES {values(CATALOGUE)}) v(name, xlo, ylo, xhi, yhi, objects, vocabulary)")
def _(s, d):
    rows = [(p.name, *p.box, p.objects, p.vocabulary, p.max_distance) for p in config.CATALOGUE.values()]
    return rounded(s.createDataFrame(rows, "name string, xlo double, ylo double, xhi double, yhi double, objects int, vocabulary int, diagonal double"))


# --- statistics and weights ---


@query("term_frequency", f"WITH terms AS ({PART_TERMS}) SELECT id, term, count(*) AS f FROM terms GROUP BY id, term")
def _(s, d):
    return weights.term_frequency(objects.part_terms(s, d))


@query("document_frequency", f"WITH terms AS ({DOC_TERMS}) SELECT term, count(DISTINCT id) AS df FROM terms GROUP BY term")
def _(s, d):
    return weights.document_frequency(objects.document_terms(s, d))


@query("collection_frequency", f"WITH terms AS ({DOC_TERMS}) SELECT term, count(*) AS cf FROM terms GROUP BY term")
def _(s, d):
    return weights.collection_frequency(objects.document_terms(s, d))


@query("max_frequency", f"WITH terms AS ({DOC_TERMS}) SELECT id, max(f) AS max_f FROM (SELECT id, term, count(*) AS f FROM terms GROUP BY id, term) GROUP BY id")
def _(s, d):
    return weights.max_frequency(objects.document_terms(s, d))


@query("tfidf", f"WITH {DOCS} SELECT id, term, round(w, 6) AS w FROM wt")
def _(s, d):
    return rounded(weights.tfidf(objects.document_terms(s, d)))


@query("tfidf_smoothed", f"WITH terms AS ({DOC_TERMS}), {weights_sql(0.2)} SELECT id, term, round(w, 6) AS w FROM wt")
def _(s, d):
    return rounded(weights.tfidf(objects.document_terms(s, d), 0.2))


@query("language_model", f"WITH terms AS ({DOC_TERMS}), {STATS} SELECT id, term, round(pow(8e-1 * f / len + 2e-1 * cf / total, f), 6) AS w FROM st")
def _(s, d):
    return rounded(weights.language_model(objects.document_terms(s, d), 0.2))


@query("keyword_summary", f"WITH terms AS ({DOC_TERMS}), c AS (SELECT term, count(*) AS cf FROM terms GROUP BY term) SELECT term, cf, row_number() OVER (ORDER BY cf DESC, term)::INT AS rank, (SELECT count(*) FROM terms) AS total, (SELECT count(*) FROM c) AS vocabulary FROM c ORDER BY cf DESC, term LIMIT 10")
def _(s, d):
    return weights.keyword_summary(objects.document_terms(s, d))


@query("bounding_box", f"WITH objects AS ({place_sql('part', 'p_partkey')}) SELECT round(min(x), 6) AS xlo, round(min(y), 6) AS ylo, round(max(x), 6) AS xhi, round(max(y), 6) AS yhi, count(*) AS n FROM objects")
def _(s, d):
    return rounded(validation.extent(objects.part_objects(s, d)))


@query("dense_regions", f"""WITH objects AS ({place_sql('part', 'p_partkey')}), b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM objects),
c AS (SELECT least(floor((x - x0) / ((x1 - x0) / 20)), 19)::INT AS cx, least(floor((y - y0) / ((y1 - y0) / 20)), 19)::INT AS cy, x0, x1, y0, y1 FROM objects, b)
SELECT cx, cy, round(x0 + (cx + 5e-1) * (x1 - x0) / 20, 6) AS x, round(y0 + (cy + 5e-1) * (y1 - y0) / 20, 6) AS y, count(*) AS n FROM c GROUP BY cx, cy, x0, x1, y0, y1 ORDER BY n DESC, cx, cy LIMIT 10""")
def _(s, d):
    return rounded(validation.dense_regions(objects.part_objects(s, d)))


CLUSTER = "((id + length(term)) % 3)::INT"
CELL = "floor(x / 45)::BIGINT || ':' || floor(y / 45)::BIGINT"


@query("pseudo_documents", f"WITH {PARTS} SELECT {CELL} AS cell, term, round(max(w), 6) AS w FROM wt JOIN objects USING (id) GROUP BY 1, 2")
def _(s, d):
    p = parts(s, d)
    return rounded(weights.pseudo_documents(validation.grid_cells(p.objects, 45.0), p.weights))


@query("pseudo_documents_clustered", f"WITH {PARTS} SELECT {CELL} AS cell, {CLUSTER} AS cluster, term, round(max(w), 6) AS w FROM wt JOIN objects USING (id) GROUP BY 1, 2, 3")
def _(s, d):
    p = clustered(parts(s, d))
    return rounded(weights.pseudo_documents(validation.grid_cells(p.objects, 45.0), p.weights, "cluster"))


@query("posting_statistics", f"WITH {PARTS} SELECT term, count(*) AS postings, round(max(w), 6) AS max_w, round(sum(w), 6) AS sum_w, round(sqrt(sum(w * w)), 6) AS norm FROM wt GROUP BY term")
def _(s, d):
    return rounded(weights.posting_statistics(parts(s, d).weights))


@query("signatures", f"WITH terms AS ({PART_TERMS}), c AS (SELECT id, length(term)::BIGINT * 7 + ascii(term) AS c FROM terms), b AS (SELECT id, unnest([c % 64, (c * 31 + 17) % 64])::INT AS b FROM c) SELECT id, bit_or(CASE WHEN b = 63 THEN (-9223372036854775808)::BIGINT ELSE (1::BIGINT << b) END) AS signature FROM b GROUP BY id")
def _(s, d):
    return weights.signatures(objects.part_terms(s, d), lambda t: F.length(t).cast("long") * 7 + F.ascii(t))


# --- geometry ---

REGIONS = f"WITH p AS (SELECT o.*, p_size / 1e1 AS s FROM ({place_sql('part', 'p_partkey')}) o JOIN part ON p_partkey = id), regions AS (SELECT id, x AS xlo, y AS ylo, x + s AS xhi, y + s / 2 AS yhi FROM p)"
AREA = (-40.0, -30.0, 60.0, 45.0)
E_ = "1.192092896e-07"


@query("box_predicates", f"""{REGIONS} SELECT id, (xlo <= 60 + {E_} AND xhi >= -40 - {E_} AND ylo <= 45 + {E_} AND yhi >= -30 - {E_}) AS meets, (xlo >= -40 - {E_} AND xhi <= 60 + {E_} AND ylo >= -30 - {E_} AND yhi <= 45 + {E_}) AS inside,
 (xlo BETWEEN -40 AND 60 AND ylo BETWEEN -30 AND 45) AS corner, (abs(xlo + 40) < {E_} OR abs(xhi - 60) < {E_} OR abs(ylo + 30) < {E_} OR abs(yhi - 45) < {E_}) AS touch,
 (id % 2 = 0 OR abs(xlo + 40) < {E_} OR abs(xhi - 60) < {E_} OR abs(ylo + 30) < {E_} OR abs(yhi - 45) < {E_}) AS touch_moved, (id % 3 <> 0) AS same, (id % 5 = 0) AS touch_point, (id % 5 <> 1) AS same_point, false AS in_point FROM regions""")
def _(s, d):
    w, b = G.fixed_box(*AREA), G.box()
    moved = G.Box(F.when(F.col("id") % 2 == 0, F.lit(AREA[0])).otherwise(b.xlo), b.ylo, b.xhi, b.yhi)
    shift = F.when(F.col("id") % 3 == 0, F.lit(1e-3)).otherwise(F.lit(1e-9))  # one is above the tolerance, the other below
    p = G.Point(b.xlo, b.ylo)
    aside = G.Point(b.xlo + F.when(F.col("id") % 5 == 1, F.lit(1e-3)).otherwise(F.lit(1e-9)), b.ylo)
    return objects.part_regions(s, d).select(
        "id", G.intersects(w, b).alias("meets"), G.contains(w, b).alias("inside"), G.contains_point(w, p).alias("corner"), G.touches(w, b).alias("touch"), G.touches(w, moved).alias("touch_moved"),
        G.same_box(G.Box(b.xlo + shift, b.ylo, b.xhi, b.yhi - shift), b).alias("same"), G.touches_point(b, G.Point(b.xlo + F.when(F.col("id") % 5 == 0, 0.0).otherwise((b.xhi - b.xlo) / 2), (b.ylo + b.yhi) / 2)).alias("touch_point"),
        G.same_point(p, aside).alias("same_point"), G.point_contains(p, aside).alias("in_point"),
    )


@query("box_measures", f"""{REGIONS}, g AS (SELECT *, greatest(xlo - 60, -40 - xhi, 0) AS dx, greatest(ylo - 45, -30 - yhi, 0) AS dy, greatest(abs(xhi + 40), abs(60 - xlo)) AS fx, greatest(abs(yhi + 30), abs(45 - ylo)) AS fy FROM regions)
SELECT id, round(sqrt(dx * dx + dy * dy), 6) AS near, round(sqrt(fx * fx + fy * fy), 6) AS far, round((xhi - xlo) * (yhi - ylo), 6) AS area, round(2 * (xhi - xlo) + 2 * (yhi - ylo), 6) AS margin,
 round(sqrt((xhi - xlo) * (xhi - xlo) + (yhi - ylo) * (yhi - ylo)), 6) AS diagonal, round(greatest(xhi - xlo, yhi - ylo), 6) AS side, round((xlo + xhi) / 2, 6) + 0 AS cx, round((ylo + yhi) / 2, 6) + 0 AS cy,
 round(greatest(least(xhi, 60) - greatest(xlo, -40), 0) * greatest(least(yhi, 45) - greatest(ylo, -30), 0), 6) AS common,
 round((greatest(xhi, 60) - least(xlo, -40)) * (greatest(yhi, 45) - least(ylo, -30)), 6) AS joint, round((xhi - xlo + 2) * (yhi - ylo + 2), 6) AS grown FROM g""")
def _(s, d):
    w, b = G.fixed_box(*AREA), G.box()
    c = G.center(b)
    return rounded(
        objects.part_regions(s, d).select(
            "id", G.min_distance(w, b).alias("near"), G.max_distance(w, b).alias("far"), G.area(b).alias("area"), G.margin(b).alias("margin"), G.diagonal(b).alias("diagonal"),
            G.longest_side(b).alias("side"), c.x.alias("cx"), c.y.alias("cy"), G.intersection_area(w, b).alias("common"), G.area(G.union(w, b)).alias("joint"), G.area(G.expand(b, 1.0)).alias("grown"),
        )
    )


@query("combined_cost", f"WITH {PARTS}, {queries_sql(SINGLE)} SELECT objects.id, qid, round({cost_sql(DIST.format('objects', 'places'), '2e-1', 0.3)}, 6) AS cost, round(greatest(0, least(1, 1 - k.c / 7e-1)), 6) AS floor, k.c AS cost_limit FROM objects, places, (VALUES (4e-1), (9e-1), (-1e-1)) k(c)")
def _(s, d):
    data, q = parts(s, d), place_frame(s, SINGLE).select("qid", F.col("x").alias("qx"), F.col("y").alias("qy"))
    dist = G.distance(G.point(), G.Point(F.col("qx"), F.col("qy")))
    floors = s.createDataFrame([(c, costs.relevance_floor(c, 0.3)) for c in (0.4, 0.9, -0.1)], "cost_limit double, floor double")
    rows = data.objects.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(floors))
    return rounded(rows.select("id", "qid", costs.combined_cost(dist, F.lit(0.2), 0.3, data.max_distance).alias("cost"), "floor", "cost_limit"))


@query("set_distance", f"WITH terms AS ({PART_TERMS}), l AS (SELECT id, list_distinct(list(term)) AS t FROM terms GROUP BY id), k AS (SELECT ['red', 'gear', 'promo'] AS k) SELECT id, round(1 - len(list_intersect(t, k))::DOUBLE / len(list_distinct(list_concat(t, k))), 6) AS dist FROM l, k")
def _(s, d):
    rows = objects.part_terms(s, d).groupBy("id").agg(F.collect_set("term").alias("t"))
    return rounded(rows.select("id", costs.set_distance(F.col("t"), F.array(*map(F.lit, ("red", "gear", "promo")))).alias("dist")))


# --- spatial queries ---


@query("containment", f"{REGIONS} SELECT id FROM regions WHERE xlo >= -40 - {E_} AND xhi <= 60 + {E_} AND ylo >= -30 - {E_} AND yhi <= 45 + {E_}")
def _(s, d):
    return spatial.containment(objects.part_regions(s, d), G.fixed_box(*AREA)).select("id")


@query("intersection", f"{REGIONS} SELECT id FROM regions WHERE xlo <= 60 + {E_} AND xhi >= -40 - {E_} AND ylo <= 45 + {E_} AND yhi >= -30 - {E_}")
def _(s, d):
    return spatial.intersection(objects.part_regions(s, d), G.fixed_box(*AREA)).select("id")


@query("point_location", f"{REGIONS} SELECT id FROM regions WHERE 29.53 BETWEEN xlo - {E_} AND xhi + {E_} AND 49.365 BETWEEN ylo - {E_} AND yhi + {E_}")
def _(s, d):
    return spatial.point_location(objects.part_regions(s, d), G.Point(F.lit(29.53), F.lit(49.365))).select("id")


NEAR = "greatest(xlo - 10, 10 - xhi, 0) AS dx, greatest(ylo - 20, 20 - yhi, 0) AS dy"


@query("nearest", f"{REGIONS}, g AS (SELECT id, {NEAR} FROM regions), r AS (SELECT id, round(sqrt(dx * dx + dy * dy), 9) AS dist FROM g) SELECT id, round(dist, 6) AS dist FROM (SELECT id, dist, rank() OVER (ORDER BY dist) AS k FROM r) WHERE k <= 15")
def _(s, d):
    return rounded(spatial.nearest(objects.part_regions(s, d), G.fixed_box(10.0, 20.0, 10.0, 20.0), 15).select("id", "dist"))


@query("nearest_custom", f"{REGIONS}, r AS (SELECT id, round(abs((xlo + xhi) / 2 - 10) + abs((ylo + yhi) / 2 - 20), 9) AS dist FROM regions) SELECT id, round(dist, 6) AS dist FROM (SELECT id, dist, rank() OVER (ORDER BY dist) AS k FROM r) WHERE k <= 15")
def _(s, d):
    manhattan = lambda a, b: F.abs(G.center(a).x - G.center(b).x) + F.abs(G.center(a).y - G.center(b).y)
    return rounded(spatial.nearest(objects.part_regions(s, d), G.fixed_box(10.0, 20.0, 10.0, 20.0), 15, manhattan).select("id", "dist"))


@query("join_intersection", f"""{REGIONS} SELECT a.id AS id1, b.id AS id2 FROM regions a JOIN regions b ON a.id < b.id AND a.xlo <= b.xhi + {E_} AND a.xhi >= b.xlo - {E_} AND a.ylo <= b.yhi + {E_} AND a.yhi >= b.ylo - {E_}
WHERE greatest(a.xlo, b.xlo) <= 60 + {E_} AND least(a.xhi, b.xhi) >= -40 - {E_} AND greatest(a.ylo, b.ylo) <= 45 + {E_} AND least(a.yhi, b.yhi) >= -30 - {E_}""")
def _(s, d):
    return spatial.self_join_intersection(objects.part_regions(s, d), G.fixed_box(*AREA))


def gap(a: str, b: str) -> str:
    dx, dy = f"greatest({b}.xlo - {a}.xhi, {a}.xlo - {b}.xhi, 0)", f"greatest({b}.ylo - {a}.yhi, {a}.ylo - {b}.yhi, 0)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


@query("join_min_distance", f"{REGIONS}, w AS (SELECT -40 AS xlo, -30 AS ylo, 60 AS xhi, 45 AS yhi), c AS (SELECT regions.* FROM regions, w WHERE {gap('regions', 'w')} <= 1) SELECT a.id AS id1, b.id AS id2, round({gap('a', 'b')}, 6) AS dist FROM c a JOIN c b ON a.id < b.id WHERE {gap('a', 'b')} <= 1")
def _(s, d):
    return rounded(spatial.self_join_distance(objects.part_regions(s, d), G.fixed_box(*AREA), 1.0))


@query("insert_delete", f"{REGIONS} SELECT id, round(xlo, 6) AS xlo FROM regions WHERE id % 10 <> 3 UNION ALL SELECT id + 1000000, round(xlo, 6) FROM regions WHERE id % 10 = 3")
def _(s, d):
    r = objects.part_regions(s, d)
    moved = r.where("id % 10 = 3").withColumn("id", F.col("id") + 1_000_000)
    return rounded(spatial.delete(spatial.insert(r, moved), r.where("id % 10 = 3")).select("id", "xlo"))


TILES = f"""{REGIONS}, m AS (SELECT *, (xlo + xhi) / 2 AS mx, (ylo + yhi) / 2 AS my FROM regions), e AS (SELECT min(mx) AS x0, max(mx) AS x1, min(my) AS y0, max(my) AS y1 FROM m),
t AS (SELECT least(floor((mx - x0) / (x1 - x0) * 4), 3)::INT AS tile_x, least(floor((my - y0) / (y1 - y0) * 5), 4)::INT AS tile_y, xlo, ylo, xhi, yhi FROM m, e),
b AS (SELECT tile_x, tile_y, count(*) AS n, min(xlo) AS xlo, min(ylo) AS ylo, max(xhi) AS xhi, max(yhi) AS yhi FROM t GROUP BY 1, 2),
o AS (SELECT b.tile_x, b.tile_y, sum(greatest(least(b.xhi, c.xhi) - greatest(b.xlo, c.xlo), 0) * greatest(least(b.yhi, c.yhi) - greatest(b.ylo, c.ylo), 0)) AS overlap FROM b JOIN b c ON b.tile_x = c.tile_x AND b.tile_y <> c.tile_y GROUP BY 1, 2)"""


@query("partition_quality", f"""{TILES} SELECT tile_x, tile_y, n, round(xlo, 6) AS xlo, round(ylo, 6) AS ylo, round(xhi, 6) AS xhi, round(yhi, 6) AS yhi, round((xhi - xlo) * (yhi - ylo), 6) AS area, round(2 * (xhi - xlo) + 2 * (yhi - ylo), 6) AS margin,
 round(coalesce(overlap, 0), 6) AS overlap, false AS violation FROM b LEFT JOIN o USING (tile_x, tile_y)""")
def _(s, d):
    return rounded(spatial.partition_quality(objects.part_regions(s, d), 4, 5, "grid"))


@query("partition_quality_summary", f"{TILES} SELECT count(*) AS tiles, sum(n)::BIGINT AS entries, round(sum((xhi - xlo) * (yhi - ylo)), 4) AS area, round(sum(coalesce(overlap, 0)) / 2, 4) AS overlap, 0::BIGINT AS violations FROM b LEFT JOIN o USING (tile_x, tile_y)")
def _(s, d):
    return rounded(spatial.quality_summary(spatial.partition_quality(objects.part_regions(s, d), 4, 5, "grid")), 4)


@query("partition_quality_sorted")
def _(s, d):
    return rounded(spatial.partition_quality(objects.part_objects(s, d), 4, 4))


# --- boolean queries ---

MATCHING = f"""full_ AS (SELECT qid, id FROM wt JOIN q USING (term) GROUP BY qid, id HAVING count(*) = (SELECT count(*) FROM q q2 WHERE q2.qid = q.qid)),
hit AS (SELECT f.qid, f.id, {DIST.format("objects", "places")} AS dist FROM full_ f JOIN objects ON objects.id = f.id JOIN places ON places.qid = f.qid)"""


@query("boolean_filter", f"WITH {PARTS}, {queries_sql(SINGLE)} SELECT qid, id, count(*) AS matched FROM wt JOIN q USING (term) GROUP BY qid, id")
def _(s, d):
    return boolean.match_counts(parts(s, d), query_frame(s, SINGLE))


@query("brsk", f"WITH {PARTS}, {queries_sql(SINGLE)}, {MATCHING} SELECT qid, id, round(dist, 6) AS dist FROM hit WHERE dist <= 90")
def _(s, d):
    return rounded(boolean.range_query(parts(s, d), query_frame(s, SINGLE), 90.0))


@query("bksk", f"WITH {PARTS}, {queries_sql(SINGLE)}, {MATCHING}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id)::INT AS rank FROM hit) SELECT qid, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 5")
def _(s, d):
    return rounded(boolean.nearest_matching(parts(s, d), query_frame(s, SINGLE), 5))


@query("brsk_documents", f"WITH {DOCS}, {queries_sql(TEXTUAL)}, {MATCHING} SELECT qid, id, round(dist, 6) AS dist FROM hit WHERE dist <= 60")
def _(s, d):
    return rounded(boolean.range_query(documents(s, d), query_frame(s, TEXTUAL), 60.0))


@query("bksk_documents", f"WITH {DOCS}, {queries_sql(TEXTUAL)}, {MATCHING}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id)::INT AS rank FROM hit) SELECT qid, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 8")
def _(s, d):
    return rounded(boolean.nearest_matching(documents(s, d), query_frame(s, TEXTUAL), 8))


# --- ranking ---


def ranked_sql(data: str, queries: list[dict], gain: str, k: int) -> str:
    return f"""WITH {data}, {queries_sql(queries)}, irs AS (SELECT qid, id, sum({gain}) AS ir FROM wt JOIN q USING (term) GROUP BY qid, id),
s AS (SELECT irs.qid, irs.id, ir, {DIST.format("objects", "places")} AS dist FROM irs JOIN objects ON objects.id = irs.id JOIN places ON places.qid = irs.qid WHERE ir > 0),
c AS (SELECT *, {cost_sql("dist", "ir")} AS cost FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cost, 9), id)::INT AS rank FROM c),
best AS (SELECT qid, id, round(ir, 6) AS ir, round(dist, 6) AS dist, round(cost, 6) AS cost, rank FROM r WHERE rank <= {k})"""


@query("tksk", ranked_sql(PARTS, SINGLE, "w * qw", 10) + " SELECT * FROM best")
def _(s, d):
    return rounded(ranking.top_ranked(parts(s, d), query_frame(s, SINGLE), 10, ALPHA, "precise"))


@query("tksk_fast", ranked_sql(PARTS, SINGLE, "qw", 10) + " SELECT * FROM best")
def _(s, d):
    return rounded(ranking.top_ranked(parts(s, d), query_frame(s, SINGLE), 10, ALPHA, "fast"))


@query("tksk_documents", ranked_sql(DOCS, TEXTUAL, "w * qw", 10) + " SELECT * FROM best")
def _(s, d):
    return rounded(ranking.top_ranked(documents(s, d), query_frame(s, TEXTUAL), 10, ALPHA, "precise"))


@query("lkt", ranked_sql(PARTS, SINGLE, "w * qw", 10) + " SELECT qid, id, ir, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INT AS rank FROM best")
def _(s, d):
    return rounded(ranking.top_ranked_by_distance(parts(s, d), query_frame(s, SINGLE), 10, ALPHA, "precise"))


@query("relevance_clustered", f"WITH {PARTS}, {queries_sql(SINGLE)}, c AS (SELECT qid, id, {CLUSTER} AS cluster, sum(w * qw) AS ir FROM wt JOIN q USING (term) GROUP BY 1, 2, 3) SELECT qid, id, round(max(ir), 6) AS ir FROM c GROUP BY qid, id")
def _(s, d):
    return rounded(ranking.relevance(clustered(parts(s, d)), query_frame(s, SINGLE), "precise", by_cluster=True))


# --- group queries ---

GROUPS = f"""m(gid, qid, weight, x, y) AS (VALUES {values([r[:5] for r in MEMBERS])}), q(qid, term, qw) AS (VALUES {values([(r[1], t, w) for r in MEMBERS for t, w in r[5]])}),
irs AS (SELECT qid, id, sum(qw) AS ir FROM wt JOIN q USING (term) GROUP BY qid, id),
mc0 AS (SELECT gid, m.qid, weight, objects.id, coalesce(ir, 0) AS ir, {DIST.format("objects", "m")} AS dist FROM objects CROSS JOIN m LEFT JOIN irs ON irs.qid = m.qid AND irs.id = objects.id),
mc AS (SELECT *, {cost_sql("dist", "ir")} AS cost FROM mc0), ranked_ AS (SELECT *, row_number() OVER (PARTITION BY gid, id ORDER BY round(cost, 9), qid) AS rn FROM mc)"""
SUMS = "sum(ir * weight) AS ir, sum(dist * weight) AS dist, sum(cost * weight) AS cost"
TOPS = ", ".join(f"arg_max({c} * weight, (round(cost * weight, 9), -qid)) AS {c}" for c in ("ir", "dist", "cost"))


def group_sql(agg: str, k: int = 5) -> str:
    return f"""WITH {PARTS}, {GROUPS}, a AS (SELECT gid, id, {agg}, string_agg(qid::VARCHAR, ',' ORDER BY qid) AS member_ids FROM mc GROUP BY gid, id),
r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY round(cost, 9), id)::INT AS rank FROM a) SELECT gid, id, round(ir, 6) AS ir, round(dist, 6) AS dist, round(cost, 6) AS cost, member_ids, rank FROM r WHERE rank <= {k}"""


def subgroup_sql(agg: str, low: int, high: int, k: int = 5) -> str:
    return f"""WITH {PARTS}, {GROUPS}, sizes(size) AS (SELECT unnest(range({low}, {high + 1}))::INT), a AS (SELECT gid, size, id, {agg}, string_agg(qid::VARCHAR, ',' ORDER BY rn) AS member_ids FROM ranked_, sizes WHERE rn <= size GROUP BY gid, size, id),
r AS (SELECT *, row_number() OVER (PARTITION BY gid, size ORDER BY round(cost, 9), id)::INT AS rank FROM a) SELECT gid, size, id, round(ir, 6) AS ir, round(dist, 6) AS dist, round(cost, 6) AS cost, member_ids, rank FROM r WHERE rank <= {k}"""


@query("gnnk_sum", group_sql(SUMS))
def _(s, d):
    return rounded(group.group_nearest(parts(s, d), *members(s), 5, "SUM", ALPHA))


@query("gnnk_max", group_sql(TOPS))
def _(s, d):
    return rounded(group.group_nearest(parts(s, d), *members(s), 5, "MAX", ALPHA))


@query("gnnk_baseline", f"SELECT gid, id, cost, rank FROM ({group_sql(SUMS)})")
def _(s, d):
    return rounded(group.group_nearest(parts(s, d), *members(s), 5, "SUM", ALPHA)).select("gid", "id", "cost", "rank")


@query("sgnnk_sum", subgroup_sql(SUMS, 2, 2))
def _(s, d):
    return rounded(group.subgroup_nearest(parts(s, d), *members(s), 2, 5, "SUM", ALPHA))


@query("sgnnk_max", subgroup_sql(TOPS, 2, 2))
def _(s, d):
    return rounded(group.subgroup_nearest(parts(s, d), *members(s), 2, 5, "MAX", ALPHA))


@query("sgnnk_baseline", f"SELECT gid, size, id, cost, rank FROM ({subgroup_sql(SUMS, 2, 2)})")
def _(s, d):
    return rounded(group.subgroup_nearest(parts(s, d), *members(s), 2, 5, "SUM", ALPHA)).select("gid", "size", "id", "cost", "rank")


@query("sgnnk_ex", subgroup_sql(SUMS, 1, 3))
def _(s, d):
    return rounded(group.subgroup_nearest(parts(s, d), *members(s), 1, 5, "SUM", ALPHA, up_to=3))


@query("sgnnk_ex_max", subgroup_sql(TOPS, 1, 3))
def _(s, d):
    return rounded(group.subgroup_nearest(parts(s, d), *members(s), 1, 5, "MAX", ALPHA, up_to=3))


@query("sgnnk_each", subgroup_sql(SUMS, 1, 3))
def _(s, d):
    return rounded(group.subgroup_nearest_each(parts(s, d), *members(s), 1, 3, 5, name="SUM", alpha=ALPHA))


@query("aggregate_value", "SELECT name, round(CASE name WHEN 'SUM' THEN 4 * 25e-2 ELSE 25e-2 END, 6) AS value FROM (VALUES ('SUM'), ('MAX')) v(name)")
def _(s, d):
    return s.createDataFrame([(n, float(group.aggregate_value(n, 0.25, 4))) for n in group.AGGREGATORS], "name string, value double")


# --- similarities ---

VECTORS = "vs AS (SELECT id, sum(w) AS s, sqrt(sum(w * w)) AS nrm FROM wt GROUP BY id)"
SIMILARITY = {"sum": "m", "jaccard": "m / (s1 + s2 - m)", "cosine": "dp / (n1 * n2)"}


def pair_sims(kind: str) -> str:
    """From cand(id1, id2, dist) to sims(id1, id2, dist, sim), pairs without a shared term left out."""
    return f"""{VECTORS}, mm AS (SELECT id1, id2, dist, sum(least(a.w, b.w)) AS m, sum(a.w * b.w) AS dp FROM cand JOIN wt a ON a.id = id1 JOIN wt b ON b.id = id2 AND b.term = a.term GROUP BY id1, id2, dist),
sims AS (SELECT id1, id2, dist, {SIMILARITY[kind]} AS sim FROM (SELECT mm.*, u.s AS s1, u.nrm AS n1, v.s AS s2, v.nrm AS n2 FROM mm JOIN vs u ON u.id = id1 JOIN vs v ON v.id = id2))"""


def candidates(where: str, reach: float | None, left: str = "objects", right: str = "objects") -> str:
    near = f" AND {DIST.format('a', 'b')} <= {reach}::DOUBLE" if reach is not None else ""
    return f"cand AS (SELECT a.id AS id1, b.id AS id2, {DIST.format('a', 'b')} AS dist FROM {left} a JOIN {right} b ON {where}{near})"


for _kind in ("sum", "jaccard", "cosine"):

    @query(f"similarity_{_kind}", f"WITH {PARTS}, {candidates('a.id < b.id', 2.0)}, {pair_sims(_kind)} SELECT id1, id2, round(sim, 6) AS sim FROM sims")
    def _(s, d, kind=_kind):
        return joins.near_similarity(parts(s, d), kind, 2.0, 6)


@query("similarity_sets", f"WITH {PARTS}, {candidates('a.id < b.id', 2.0)}, l AS (SELECT id, list(DISTINCT term) AS t FROM terms GROUP BY id) SELECT id1, id2, round(1 - len(list_intersect(u.t, v.t))::DOUBLE / len(list_distinct(list_concat(u.t, v.t))), 6) AS dist FROM cand JOIN l u ON u.id = id1 JOIN l v ON v.id = id2")
def _(s, d):
    data = parts(s, d)
    return joins.near_set_distance(data, 2.0, 6)


SCORE = {
    "sum": "sum(qw * w / tm)",
    "jaccard": "sum(least(qw, w)) / (any_value(qall) + sum(greatest(qw, w) - qw))",
    "cosine": "sum(w * qw) / (sqrt(sum(w * w)) * sqrt(any_value(qsq)))",
}


def scores_sql(kind: str, by: str = "0") -> str:
    """The scores of objects; by cluster, the best of an object's scores."""
    return f"""kw(term, qw) AS (VALUES {values(KEYWORDS)}), tops AS (SELECT term, max(w) AS tm FROM wt GROUP BY term),
part_scores AS (SELECT id, {by} AS c, {SCORE[kind]} AS score FROM wt JOIN kw USING (term) JOIN tops USING (term), (SELECT sum(qw) AS qall, sum(qw * qw) AS qsq FROM kw) GROUP BY 1, 2),
scores AS (SELECT id, max(score) AS score FROM part_scores GROUP BY id)"""


for _kind in ("sum", "jaccard", "cosine"):

    @query(f"keyword_score_{_kind}", f"WITH {PARTS}, {scores_sql(_kind)} SELECT id, round(score, 6) AS score FROM scores")
    def _(s, d, kind=_kind):
        return rounded(joins.keyword_scores(parts(s, d), joins.JoinQuery(kind, "textual", KEYWORDS)))

    @query(f"keyword_score_clustered_{_kind}", f"WITH {PARTS}, {scores_sql(_kind, CLUSTER)} SELECT id, round(score, 6) AS score FROM scores")
    def _(s, d, kind=_kind):
        return rounded(joins.clustered_keyword_scores(clustered(parts(s, d)), joins.JoinQuery(kind, "textual", KEYWORDS)))


# --- joins ---

IN_WINDOW = f"x BETWEEN {WINDOW[0]} AND {WINDOW[2]} AND y BETWEEN {WINDOW[1]} AND {WINDOW[3]}"
PAIR_COLUMNS = f"id1, id2, round(dist, 6) AS dist, round(sim, 6) AS sim, round({cost_sql('dist', 'sim')}, 6) AS combined"


def sides(mode: str, two: bool) -> tuple[str, str, str, str]:
    """(definition, left, right, join condition) of what takes part."""
    where = f" WHERE {IN_WINDOW}" if mode in ("spatial", "all") else ""
    base = f"inside AS (SELECT * FROM objects{where})"
    if mode in ("textual", "all"):
        base = f"inside AS (SELECT objects.* FROM objects SEMI JOIN scores USING (id){where})"
    if not two:
        return base, "inside", "inside", "a.id < b.id"
    return base, "(SELECT * FROM inside WHERE id % 2 = 0)", "(SELECT * FROM inside WHERE id % 2 = 1)", "true"


def join_sql(kind: str, mode: str, reach: float | None, two: bool) -> str:
    base, left, right, on = sides(mode, two)
    scores = scores_sql(kind) + ", " if mode in ("textual", "all") and not two else ""
    if mode in ("textual", "all") and two:  # the largest weight of a term is that of its own side
        scores = f"""kw(term, qw) AS (VALUES {values(KEYWORDS)}), tops AS (SELECT id % 2 AS side, term, max(w) AS tm FROM wt GROUP BY 1, 2),
scores AS (SELECT id, {SCORE[kind]} AS score FROM wt JOIN kw USING (term) JOIN tops ON tops.term = wt.term AND side = id % 2, (SELECT sum(qw) AS qall, sum(qw * qw) AS qsq FROM kw) GROUP BY id), """
    cand = candidates(on, reach, left, right)
    if mode in ("textual", "all"):
        sims = "sims AS (SELECT id1, id2, dist, least(u.score, v.score) AS sim FROM cand JOIN scores u ON u.id = id1 JOIN scores v ON v.id = id2)"
    else:
        sims = pair_sims(kind)
    return f"WITH {PARTS}, {scores}{base}, {cand}, {sims}"


def threshold_sql(kind: str, mode: str, two: bool, reach: float = REACH, floor: float = FLOOR) -> str:
    return f"{join_sql(kind, mode, reach, two)} SELECT {PAIR_COLUMNS} FROM sims WHERE sim >= {floor}::DOUBLE AND sim > 0"


def top_sql(kind: str, mode: str, two: bool, k: int = TOP) -> str:
    return f"""{join_sql(kind, mode, None, two)}, r AS (SELECT *, row_number() OVER (ORDER BY round({cost_sql("dist", "sim")}, 9), id1, id2)::INT AS rank FROM sims WHERE sim > 0)
SELECT {PAIR_COLUMNS}, rank FROM r WHERE rank <= {k}"""


def join_query(kind: str, mode: str) -> joins.JoinQuery:
    return joins.JoinQuery(kind, mode, KEYWORDS, WINDOW, ALPHA)


for _name, _kind, _mode in (("jaccard", "jaccard", "full"), ("sum", "sum", "full"), ("cosine", "cosine", "full"), ("textual", "jaccard", "textual"), ("textual_sum", "sum", "textual"), ("spatial", "jaccard", "spatial"), ("all", "cosine", "all")):

    @query(f"stsj_{_name}", threshold_sql(_kind, _mode, False))
    def _(s, d, kind=_kind, mode=_mode):
        return joins.threshold_join(parts(s, d), None, join_query(kind, mode), REACH, FLOOR, digits=6)

    @query(f"stsj_multiset_{_name}", threshold_sql(_kind, _mode, True))
    def _(s, d, kind=_kind, mode=_mode):
        return joins.threshold_join(*halves(s, d), join_query(kind, mode), REACH, FLOOR, digits=6)

    @query(f"topk_stsj_{_name}", top_sql(_kind, _mode, False))
    def _(s, d, kind=_kind, mode=_mode):
        return rounded(joins.top_k_join(parts(s, d), None, join_query(kind, mode), TOP))

    @query(f"topk_stsj_ex_{_name}", top_sql(_kind, _mode, True))
    def _(s, d, kind=_kind, mode=_mode):
        return rounded(joins.top_k_join(*halves(s, d), join_query(kind, mode), TOP))


@query("stsj_distance_only", f"WITH {PARTS}, {candidates('a.id < b.id', REACH)}, sims AS (SELECT *, 1e0 AS sim FROM cand) SELECT {PAIR_COLUMNS} FROM sims")
def _(s, d):
    return joins.threshold_join(parts(s, d), None, join_query("jaccard", "full"), REACH, 0.0, digits=6)


@query("stsj_nested", threshold_sql("jaccard", "full", False))
def _(s, d):
    return joins.threshold_join(parts(s, d), None, join_query("jaccard", "full"), REACH, FLOOR, plan="nested", digits=6)


@query("knn_join", f"""{join_sql("cosine", "full", None, True)}, r AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY round({cost_sql("dist", "sim")}, 9), id2)::INT AS rank FROM sims WHERE sim > 0)
SELECT {PAIR_COLUMNS}, rank FROM r WHERE rank <= 2""")
def _(s, d):
    return rounded(joins.nearest_join(*halves(s, d), join_query("cosine", "full"), 2))


# --- clustering, generation, harness ---


@query("kmeans")
def _(s, d):
    return clustering.spherical_kmeans(weights.tfidf(objects.part_terms(s, d)), 8, seed=7, iterations=8)


def _source(s, d) -> generate.Source:
    terms = objects.part_terms(s, d)
    return harness.source_of(SpatioTextual(objects.part_objects(s, d), terms, 1.0), terms, objects.WORLD)


@query("ranked_vocabulary", f"WITH terms AS ({DOC_TERMS}) SELECT row_number() OVER (ORDER BY term) - 1 AS i, term FROM (SELECT DISTINCT term FROM terms)")
def _(s, d):
    return harness.ranked_vocabulary(objects.document_terms(s, d))


@query("generated_queries")
def _(s, d):
    return query_frame(s, generate.Generator(_source(s, d), 3).single(20, 4, 0.01, 50))


@query("generated_groups")
def _(s, d):
    rows = generate.Generator(_source(s, d), 3).groups(4, 5, 3, 0.01, 50, 60)
    return query_frame(s, rows).join(s.createDataFrame([(r["qid"], r["gid"]) for r in rows], "qid int, gid int"), "qid")


@query("experiment")
def _(s, d):
    c = config.Config(params=config.QueryParams(queries=3, keywords=1, keyword_space=100, radius=40.0), sweeps={"k": [1, 10]}, experiments=["nearest", "ranked"])
    return harness.summary(harness.run(s, c, d)).select("experiment", "swept", "value", "rows")


@query("experiment_two_sets")
def _(s, d):
    """A join over two data sets, distance and similarity swept together; the detailed metrics' names and counts."""
    second = config.DatasetConfig("PART", usage=0.5)
    c = config.Config(secondary=second, params=config.QueryParams(join_similarity=0.3), sweeps={"combined": [[1.0, 0.3], [2.0, 0.4]]}, experiments=["join_two"])
    return harness.detailed(harness.run(s, c, d)).select("queryType", "value", "numIterations", "totalResults", "totalReturnedPairs")
