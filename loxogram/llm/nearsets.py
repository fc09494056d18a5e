"""Near-duplicates by the similarity of word shingles, for the pipeline.

Two documents link where the Jaccard similarity of their sets of five-word shingles is ``SIMILARITY`` or
more. SimHash comes first: fingerprints of the shingle sets, linked by the generalised pigeonhole of ``simhash``,
and each link checked by the whole shingle sets (64-bit hashes). Its radius reaches few of the pairs at 0.8, so
MinHash finds the rest: 128 least values in ``BANDS`` bands of ``ROWS``; documents that agree in a band are
compared, again by their whole sets. A pair at similarity 0.8 shares no band with a chance of
(1 - 0.8^4)^32, about 5 in 100 million; closer pairs less.

Equal sets are one node. A shingle that no other compared set has can be in no intersection, so a set that keeps under ``SIMILARITY``
of its shingles without them leaves the bands. Within a band's value that holds several components, all nodes of other components are compared
with one head, that with the least part of such shingles. What is still in different components is compared pair by
pair, each pair in the first band it shares, where the sizes allow the similarity: of the shingles that both can have, some are in the head
and some not, and both counts are bounded by what either has of each kind.

Defined cases: white space and the case of A-Z do not count; texts under five words are one shingle; null
or empty texts and texts of white space alone are copies of one another; of each component the row of the
least doc_id stays (of equal ids one row, and one row where no id is known).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key
from .simhash import components, links

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 4
_draws = np.random.default_rng(20240229)
MASKS, FACTORS = (_draws.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
MIX = _draws.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; that of no words is 0."""
    import xxhash

    words = (data or b"").lower().split()
    if not words:
        return np.zeros(1, dtype="<u8")
    of, joined = xxhash.xxh64_intdigest, b" ".join(words)
    at = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    return np.unique(np.array([of(joined[a : b - 1], 42) for a, b in zip(at, at[min(shingle, len(words)) :], strict=False)], dtype="<u8"))


def set_id(found: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def set_print(found: np.ndarray) -> int:
    """The SimHash of the set: a bit is 1 if it is in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(found), 4096):
        ones += np.unpackbits(found[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def band_values(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), 1024):
        part = (found[None, k : k + 1024] ^ MASKS[:, None]) * FACTORS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    mixed = (least >> np.uint64(17)) * MIX[np.arange(BANDS * ROWS) % ROWS]
    return (mixed ^ (mixed >> np.uint64(29))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sids, sizes, prints, bands = [], [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            sids.append(set_id(found))
            sizes.append(len(found))
            prints.append(set_print(found))
            bands.append(band_values(found))
        values = pa.array(np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sids) + 1) * BANDS, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), lists], names=["rid", "sid", "n", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 500):
            found = [shingles(t.as_py()) for t in whole.column(0).slice(a, 500)]
            cuts = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([set_id(f) for f in found], pa.int64()), lists], names=["sid", "items"])


def alike(n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of these sizes can be so similar."""
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def reaching(common: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of these sizes with no more than so many common shingles can be so similar."""
    return common >= similarity / (1 + similarity) * (n + m) - 1e-9


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with i, the size of their intersection, and t, the sum of their sizes."""
    left = sets.select(F.col("sid").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("t"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    return overlaps(pairs, sets).where(F.col("i") >= similarity * (F.col("t") - F.col("i")) - 1e-9).select("a", "b")


def lone_shingles(sets: DataFrame) -> DataFrame:
    """(sid, lone): how many shingles of a set no other of ``sets`` has; sets without any have no row."""
    held = sets.select("sid", F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("sid").alias("sid"))
    return held.where("c = 1").groupBy("sid").agg(F.count(F.lit(1)).cast("int").alias("lone"))


def divided(points: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``points`` (k, v, sid, n, core) of values that hold several components, with their root and the value's head."""
    placed = points.select("k", "v", "sid", "n", "core").join(roots, F.col("sid") == roots.node, "left")
    placed = materialize(placed.select("k", "v", "sid", "n", "core", F.coalesce("root", "sid").alias("root")), "placed")
    head = F.min_by(F.struct("sid", "n", "core", "root"), F.struct((F.col("n") - F.col("core")) / F.col("n"), "sid"))
    split = placed.groupBy("k", "v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), head.alias("head")).where("lo != hi")
    return materialize(placed.join(materialize(split.select("k", "v", "head"), "split"), ["k", "v"]), "left")


def print_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): the sets that SimHash links, through the least set of each fingerprint."""
    prints = rows.select("fp", "sid").distinct()
    least = materialize(prints.groupBy("fp").agg(F.min("sid").alias("head")), "prints")
    same = prints.join(least, "fp").where("sid != head").select(F.col("head").alias("a"), F.col("sid").alias("b"))
    one, two = (least.select(F.col("fp").alias(c), F.col("head").alias(f"s{c}")) for c in "ab")
    linked = links(least.select("fp")).join(one, "a").join(two, "b").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))
    return same.unionByName(linked).distinct()


def similar_components(docs: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the shingle sets that have a link; ``rows`` are the sketches of ``docs``."""
    tried = materialize(print_pairs(rows), "pairs")
    nodes = rows.dropDuplicates(["sid"]).select("sid", "n", F.posexplode("bands").alias("k", "v"))
    shared = nodes.groupBy("k", "v").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo != hi").select("k", "v")
    points = materialize(nodes.join(materialize(shared, "shared"), ["k", "v"]), "points")
    wanted = points.select("sid").unionByName(tried.select(F.explode(F.array("a", "b")).alias("sid"))).distinct()
    chosen = rows.groupBy("sid").agg(F.min("rid").alias("rid")).join(wanted, "sid").select("rid")
    texts = docs.select(row_key("doc_id", "text").alias("rid"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(chosen, "rid", "left_semi").dropDuplicates(["rid"])
    sets = materialize(texts.select("text").mapInArrow(_sets, "sid long, items array<long>"), "sets")

    near = materialize(verified(tried, sets, similarity), "near")
    roots = components(near)
    points = points.join(lone_shingles(sets), "sid", "left").withColumn("core", F.col("n") - F.coalesce("lone", F.lit(0)))
    left = divided(points.where(F.col("core") >= similarity * F.col("n") - 1e-9), roots)
    if left.isEmpty():
        return roots
    other = left.where("root != head.root").where(alike(F.col("n"), F.col("head.n"), similarity))
    other = other.where(reaching(F.least("core", "head.core"), F.col("n"), F.col("head.n"), similarity))
    pairs = other.select(F.least("sid", "head.sid").alias("a"), F.greatest("sid", "head.sid").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    near = near.unionByName(materialize(verified(materialize(pairs, "pairs"), sets, similarity), "near"))
    roots = components(near)
    left = divided(left, roots)
    if left.isEmpty():
        return roots
    left = left.withColumn("pivot", F.col("head.sid")).drop("head")
    held = overlaps(left.select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct(), sets)
    held = materialize(held.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "i"), "held")
    bands = rows.join(left.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"]).select("sid", "bands")
    left = materialize(left.join(held, ["sid", "pivot"]).join(bands, "sid"), "left")
    other = left.select("k", "v", F.col("sid").alias("b"), F.col("n").alias("m"), F.col("core").alias("most"), F.col("i").alias("j"), F.col("root").alias("to"), F.col("bands").alias("others"))
    common = F.least("i", "j") + F.greatest(F.least(F.col("core") - F.col("i"), F.col("most") - F.col("j")), F.lit(0))
    sooner = reduce(or_, [(F.col("k") > k) & (F.col("bands")[k] == F.col("others")[k]) for k in range(BANDS - 1)])
    more = left.join(other, ["k", "v"]).where("sid < b and root != to").where(alike(F.col("n"), F.col("m"), similarity))
    more = more.where(reaching(F.least("core", "most"), F.col("n"), F.col("m"), similarity)).where(reaching(common, F.col("n"), F.col("m"), similarity)).where(~sooner)
    return components(near.unionByName(verified(materialize(more.select(F.col("sid").alias("a"), "b"), "pairs"), sets, similarity)))


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component, all columns kept."""
    rows = docs.select(row_key("doc_id", "text").alias("rid"), F.col("text").cast("binary").alias("text"))
    schema = f"rid {rows.schema['rid'].dataType.simpleString()}, sid long, n int, fp long, bands array<long>"
    rows = materialize(rows.mapInArrow(_sketches, schema), "sketches")
    least = rows.groupBy("sid").agg(F.min(F.struct(F.col("rid.d").isNull().alias("unknown"), "rid")).alias("least"))
    roots = similar_components(docs, rows, similarity)
    known = least.join(roots, least.sid == roots.node, "left").select(F.coalesce("root", "sid").alias("root"), "least")
    stay = known.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.rid").alias("_rid"))
    keyed = docs.withColumn("_rid", row_key("doc_id", "text"))
    return keyed.join(stay, "_rid").dropDuplicates(["_rid"]).drop("_rid")
