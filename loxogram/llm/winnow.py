"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Of every window of consecutive k-grams of words the least hash is kept (of equal ones the last). With
``window`` = ``span`` - ``gram`` + 1 any run of ``span`` words that a document shares with a benchmark item
contains a fingerprint that both keep at the same place of the run. Document and item fingerprints
are joined, and each meeting is extended to both sides, word by word, as far as a span needs; what reaches
``span`` words is hit. Items under ``span`` words are one window of their own length, for which every k-gram
of that length is kept (a winnowing window of one).

A fingerprint is one long: the upper bits are the hash, the lower ones the place counted downwards, so
that the least value of a window is the least hash and the last place. Equal upper bits propose; the
words themselves decide.

Benchmark fingerprints are broadcast while their number and bytes prove them small, and shuffled otherwise. A
document's own fingerprints leave its row only as (key, value); matches are gathered per document, which
its length and the number of items that share its passages bound.

Defined cases: null and empty texts have no words; items without words have no window; repeated rows each
get a row, repeated items count once for each distinct id; empty tables give no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

SPAN, GRAM = 10, 5
PLACE_BITS = 30
#: Benchmark fingerprints are broadcast up to so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: What does not belong to a word, once A-Z are lower case.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def pack_place(value: Column, place: Column) -> Column:
    top = (1 << PLACE_BITS) - 1
    return F.shiftleft(F.shiftright(value, PLACE_BITS), PLACE_BITS).bitwiseOR(F.lit(top).cast("long") - place.cast("long"))


def gram_values(hashes: str, k: int) -> Column:
    """Packed hashes of all k-grams of the column ``hashes`` (an array of word hashes)."""
    h = F.col(hashes)
    n = F.size(h) - k + 1
    each = lambda i: pack_place(F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)]), i)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), each)).otherwise(F.array().cast("array<long>"))


def winnowed(values: str, window: int) -> Column:
    """The least value of every window; of fewer values than a window, none."""
    v = F.col(values)
    n = F.size(v) - window + 1
    each = lambda i: F.least(*[F.get(v, i + j) for j in range(window)]) if window > 1 else F.get(v, i)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), each))).otherwise(F.array().cast("array<long>"))


def fingerprints(rows: DataFrame, keep: list[str], lengths: list[int], span: int, gram: int) -> DataFrame:
    """(keep..., n_words, k, value): fingerprints for full spans (k = gram) and for short windows (k = their length)."""
    rows = rows.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_h"))
    rows = rows.select(*keep, "_h", gram_values("_h", gram).alias("_v"))
    sets = [F.struct(F.lit(0).alias("k"), winnowed("_v", span - gram + 1).alias("values"))]
    sets += [F.struct(F.lit(k).alias("k"), gram_values("_h", k).alias("values")) for k in lengths]
    exploded = rows.select(*keep, F.explode(F.array(*sets)).alias("_s")) if lengths else rows.select(*keep, sets[0].alias("_s"))
    return exploded.select(*keep, F.col("_s.k").alias("k"), F.explode("_s.values").alias("value"))


def place_of(value: str) -> Column:
    top = (1 << PLACE_BITS) - 1
    return (F.lit(top).cast("long") - F.col(value).bitwiseAND(F.lit(top).cast("long"))).cast("int")


def matches(docs: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    """(rid, matches): for each document with a proposal, the places that met and the items' words around them."""
    items = items.select(F.col("item_id"), words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    items = materialize(items.withColumn("_n", F.size("_w")), "items")
    short = items.where(F.col("_n") < span)
    lengths = sorted(r["_n"] for r in short.select("_n").distinct().collect())  # under span values
    as_text = lambda df: df.select("item_id", "_w", F.array_join("_w", " ").alias("text"))
    full = fingerprints(as_text(items.where(F.col("_n") >= span)), ["item_id", "_w"], [], span, gram)
    prints = full
    for k in lengths:
        own = as_text(short.where(F.col("_n") == k)).select("item_id", "_w", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
        prints = prints.unionByName(own.select("item_id", "_w", F.lit(k).alias("k"), F.explode(gram_values("_h", k)).alias("value")))
    q = place_of("value")
    reach = span - gram
    first = F.greatest(q - reach, F.lit(0))
    around = F.when(F.col("k") == 0, F.slice("_w", first + 1, q - first + gram + reach)).otherwise(F.col("_w"))
    prints = prints.select(
        "item_id", "k", F.shiftright("value", PLACE_BITS).alias("hash"), around.alias("around"), F.when(F.col("k") == 0, q - first).otherwise(0).alias("before")
    )
    # the same words around the same fingerprint are compared once, however many items have them
    prints = prints.groupBy("k", "hash", "around", "before").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    prints = materialize(prints, "item_prints")
    keyed = docs.select(doc_key().alias("rid"), "text")
    found = fingerprints(keyed, ["rid"], lengths, span, gram)
    found = found.select("rid", "k", F.shiftright("value", PLACE_BITS).alias("hash"), place_of("value").alias("p"))
    rows, size = prints.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.array_join("around", " ")) + 8 * F.size("around") + 8 * F.size("item_ids"))).first()
    small = rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    met = found.join(F.broadcast(prints) if small else prints, ["k", "hash"])
    return met.groupBy("rid").agg(F.collect_set(F.struct("k", "p", "around", "before", "item_ids")).alias("matches"))


def doc_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.struct(doc_id.alias("d"), F.xxhash64(text).alias("h"))


def extended(span: int, gram: int) -> Column:
    """For each proposal (start, end, item_ids) of the words it hits; none where the words differ."""

    def one(m: Column) -> Column:
        k = F.when(m["k"] == 0, F.lit(gram)).otherwise(m["k"])
        need = F.when(m["k"] == 0, F.lit(span)).otherwise(m["k"])
        first = m["p"] - m["before"]  # where the item's words around would start in the document
        size = F.size(m["around"])
        same = F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.when(first + j >= 0, F.coalesce(F.get("_w", first + j) == F.get(m["around"], j), F.lit(False))).otherwise(False))
        # the run of equal words that holds the k-gram: from behind the last difference before it to the first one after
        differs = F.filter(F.transform(same, lambda s, j: F.when(~s, j)), lambda j: j.isNotNull())
        left = F.coalesce(F.array_max(F.filter(differs, lambda j: j < m["before"] + k)), F.lit(-1)) + 1
        right = F.coalesce(F.array_min(F.filter(differs, lambda j: j >= m["before"] + k)), size)
        good = (left <= m["before"]) & (right - left >= need)
        return F.when(good, F.struct((first + left).alias("a"), (first + right).alias("b"), m["item_ids"].alias("ids")))

    return F.filter(F.transform("matches", one), lambda x: x.isNotNull())


def count_covered(spans: str) -> Column:
    """Words in the union of [a, b), from the spans sorted by a: each adds what lies behind the furthest end so far."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["b"]).alias("end"))
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs`` with n_words, n_hit, _spans (hit words as [a, b) with item ids) and item_ids, which replace columns of these names.

    Other columns may have any names: the work is done under names of its own.
    """
    names, added = docs.columns, ["n_words", "n_hit", "_spans", "item_ids"]
    own = [f"_c{i}" for i in range(len(names))]
    doc_id, text = (F.col(own[names.index(c)]) for c in ("doc_id", "text"))
    found = matches(docs, items, span, gram).withColumnRenamed("rid", "_rid")
    joined = docs.toDF(*own).withColumn("_rid", doc_key(doc_id, text)).join(found, "_rid", "left").drop("_rid")
    joined = joined.withColumn("_w", words(text))
    joined = joined.withColumn("n_words", F.size("_w").cast("long"))
    joined = joined.withColumn("_spans", F.when(F.col("matches").isNotNull(), extended(span, gram)))
    joined = joined.withColumn("n_hit", F.coalesce(count_covered("_spans").cast("long"), F.lit(0)))
    ids = F.array_distinct(F.flatten(F.transform("_spans", lambda s: s["ids"])))
    joined = joined.withColumn("item_ids", F.coalesce(ids, F.array().cast("array<long>")))
    return joined.select(*[F.col(c).alias(n) for c, n in zip(own, names, strict=True) if n not in added], *added)


def op8_winnow(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    sorted_ids = F.array_join(F.sort_array(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(sorted_ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs`` without the rows that share a window with an item, all columns kept.

    Only documents with a proposal are judged. The verdicts are written before they filter: a filter on them
    would be pushed below the words and split the text anew for every word it compares.
    """
    proposed = docs.select(doc_key().alias("rid"), "text").join(matches(docs, items, span, gram), "rid").withColumn("_w", words(F.col("text")))
    judged = materialize(proposed.select("rid", extended(span, gram).alias("spans")).select("rid", (F.size("spans") > 0).alias("hit")), "judged")
    gone = judged.where("hit").select(F.col("rid").alias("_rid")).distinct()
    return docs.withColumn("_rid", doc_key()).join(gone, "_rid", "left_anti").drop("_rid")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: All windows of all texts, joined as they are: no fingerprints.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {SPAN}) AS n, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS i, w FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
met AS (SELECT doc_id, dw.n, i, item_id FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM dw) dw JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
