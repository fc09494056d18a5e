"""Near-duplicates by SimHash, found with the generalised pigeonhole principle.

A fingerprint has 64 bits; two documents link at ``radius`` or fewer differing bits. The bits are
grouped into partitions of correlated bits, and each partition gets a threshold of its own: if the
thresholds sum to radius - partitions + 1, any two fingerprints within the radius are within the
threshold in at least one partition. A dynamic program picks the thresholds (and the number of
partitions) whose estimated work is least: probes to write plus candidates to verify. The estimates
come from the bit counts and bit-pair counts of all fingerprints, so the choice follows the data; the
links found are the same for any choice.

Probing: at threshold 0 fingerprints meet at the partition's value, at 1 at the value with one bit
masked out, at 2 at any value one bit away (two balls of radius one meet within distance two). Only
distinct fingerprints are probed, so copies cost nothing. Within a meeting point candidates are verified
by a popcount, and only a spanning forest of the links goes out, never all pairs of a group. A point
with more than ``GROUP`` fingerprints is not gathered: its fingerprints are dealt into blocks, and pairs of blocks are
verified by separate tasks.

Components come from the star contraction of the links (large-star, small-star), each round written to
the shared folder.

Defined cases: null or empty texts and texts of white space alone have fingerprint zero and link as any
other; texts under four words are one shingle; an empty table gives no rows; repeated rows each get a
row; where no doc_id of a component is known its id is null; other columns are not looked at (names
that start with _rid are the operator's own); of a very long text one task holds the words and 4,096 hashes at a time in bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, table

BITS, RADIUS, SHINGLE, GROUP = 64, 4, 4, 20_000
#: Cost of writing and sorting one probe, in units of verifying one candidate (measured, order of magnitude).
PROBE_COST = 40.0


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Lower-cases A-Z, splits at white space of ASCII, hashes word shingles by XXH64 (seed 42)."""
    import xxhash

    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    at = starts.tolist()
    last = at[min(shingle, len(words)) :]
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a : b - 1], 42) for a, b in zip(at, last, strict=False)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text, shingle: int = SHINGLE):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")(text.cast("binary"))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of set bits and of pairs of set bits; the last row is the number of fingerprints."""
    total, gram = 0, np.zeros((BITS, BITS))
    for batch in batches:
        fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
        for k in range(0, len(fp), 8192):
            bits = np.unpackbits(fp[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            gram += bits.T @ bits
            total += len(bits)
    counts = np.append(gram.ravel(), total).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int32()), pa.array(counts)], names=["i", "c"])


def group_bits(gram: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Greedily gathers the bits that correlate most into partitions of near equal width."""
    p = np.diag(gram) / max(1, total)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((gram / max(1, total) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = BITS * (k + 1) // parts - BITS * k // parts
        group = [max(sorted(free), key=lambda b: corr[b].sum())]
        free.remove(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def estimated_work(p: np.ndarray, total: int, bits: list[int], threshold: int) -> float:
    """Probes and candidates of a partition; distances are taken as sums of independent bits."""
    if threshold < 0:
        return 0.0
    near = np.zeros(len(bits) + 1)
    near[0] = 1.0
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        near[1:] = near[1:] * (1 - differ) + near[:-1] * differ
        near[0] *= 1 - differ
    probes = (1, len(bits), len(bits) + 1)[threshold]
    return total * probes * PROBE_COST + 0.5 * total * total * near[: threshold + 1].sum()


def allocate(p: np.ndarray, total: int, parts: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """Thresholds from -1 to 2 that sum to radius - len(parts) + 1, at the least estimated work."""
    goal = radius - len(parts) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in parts:
        then: dict[int, tuple[float, list[int]]] = {}
        for spent, (work, chosen) in best.items():
            for t in (-1, 0, 1, 2):
                more = (work + estimated_work(p, total, bits, t), [*chosen, t])
                if spent + t not in then or more[0] < then[spent + t][0]:
                    then[spent + t] = more
        best = then
    return best.get(goal, (float("inf"), []))


def plan_probes(gram: np.ndarray, total: int, radius: int) -> tuple[list[list[int]], list[int]]:
    p = np.diag(gram) / max(1, total)
    plans = []
    for m in range(max(1, (radius + 3) // 3), radius + 2):
        parts = group_bits(gram, total, m)
        work, thresholds = allocate(p, total, parts, radius)
        plans.append((work, parts, thresholds))
    _, parts, thresholds = min(plans, key=lambda x: x[0])
    return parts, thresholds


def probes(fp, parts: list[list[int]], thresholds: list[int]):
    """An array of (partition and mask, value): fingerprints that share an entry are candidates."""
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    out, place = [], 0
    entry = lambda k, value: F.struct(F.lit(k).alias("k"), value.alias("v"))
    for bits, t in zip(parts, thresholds, strict=True):
        mask = sum(1 << b for b in bits)
        value = fp.bitwiseAND(F.lit(signed(mask)))
        if t == 0 or t == 2:
            out.append(entry(place, value))
        if t == 1:
            out += [entry(place + 1 + j, fp.bitwiseAND(F.lit(signed(mask & ~(1 << b))))) for j, b in enumerate(bits)]
        if t == 2:
            out += [entry(place, value.bitwiseXOR(F.lit(signed(1 << b)))) for b in bits]
        place += 1 + len(bits)
    return F.array(*out)


def forest(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components within each group. ``group`` is sorted; rows of one are adjacent."""
    n = len(fp)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a_out: list[int] = []
    b_out: list[int] = []
    left, d = np.arange(n - 1), 1
    while len(left):
        left = left[left + d < n]
        left = left[group[left] == group[left + d]]
        close = left[np.bitwise_count(fp[left] ^ fp[left + d]) <= radius]
        close = close[root[close] != root[close + d]]
        for a in close.tolist():
            x, y = find(a), find(a + d)
            if x != y:
                root[max(x, y)] = min(x, y)
                a_out.append(a)
                b_out.append(a + d)
        if len(close):
            while (root != (up := root[root])).any():
                root = up
        d += 1
    return fp[a_out], fp[b_out]


def _verify(radius: int, limit: int, keys: int):
    """Rows come sorted by their first ``keys`` columns; the last is the fingerprint.

    Yields links (kind 0), and for a group beyond the limit one row that defers it (kind 1).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            at = rows.iloc[:, :keys].to_numpy()
            new = np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)])
            a, b = forest(np.cumsum(new), rows["fp"].to_numpy().astype(np.int64).view(np.uint64), radius)
            return pd.DataFrame({"kind": 0, "a": a.view(np.int64), "b": b.view(np.int64)}).astype({"kind": "int32"})

        held: list[pd.DataFrame] = []
        count, over = 0, None  # over: the key of a group that is being passed over
        for rows in batches:
            while len(rows):
                at = rows.iloc[:, :keys].to_numpy()
                if over is not None:
                    skip = int((at == over).all(axis=1).cumprod().sum())
                    over = None if skip < len(rows) else over
                    rows = rows.iloc[skip:]
                    continue
                held.append(rows)
                count += len(rows)
                last, rows = at[-1], rows.iloc[:0]
                if count < limit:
                    continue
                whole = pd.concat(held, ignore_index=True)
                tail = int((whole.iloc[:, :keys].to_numpy() == last).all(axis=1)[::-1].cumprod().sum())
                if tail < len(whole):
                    yield solve(whole.iloc[: len(whole) - tail])
                held = [whole.iloc[len(whole) - tail :]]
                count = tail
                if tail > limit and keys == 2:  # a dealt group's cells are never dealt again
                    yield pd.DataFrame({"kind": [1], "a": [int(last[0])], "b": [int(last[1])]}).astype({"kind": "int32"})
                    held, count, over = [], 0, last
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def links(distinct: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) of each component."""
    counted = dict(distinct.mapInArrow(_gram, "i int, c long").groupBy("i").agg(F.sum("c")).collect())  # 4097 rows
    total = counted.get(BITS * BITS, 0)
    gram = np.array([counted.get(i, 0) for i in range(BITS * BITS)], dtype=float).reshape(BITS, BITS)
    parts, thresholds = plan_probes(gram, total, radius)
    points = distinct.select(F.explode(probes(F.col("fp"), parts, thresholds)).alias("at"), "fp").select("at.k", "at.v", "fp")
    found = points.repartition("k", "v").sortWithinPartitions("k", "v").mapInPandas(_verify(radius, group, 2), "kind int, a long, b long")
    found = materialize(found, "links")
    near = found.where("kind = 0").select("a", "b")
    deferred = found.where("kind = 1").select(F.col("a").cast("int").alias("k"), F.col("b").alias("v"))
    if not deferred.isEmpty():
        hot = points.join(deferred, ["k", "v"])
        sizes = hot.groupBy("k", "v").agg(F.ceil(F.count(F.lit(1)) * 4 / group).cast("int").alias("n"))
        hot = hot.join(sizes, ["k", "v"]).withColumn("i", F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("n")).cast("int"))
        hot = hot.select("k", "v", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), "fp")
        hot = hot.select("k", "v", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp")
        cells = hot.repartition("k", "v", "lo", "hi").sortWithinPartitions("k", "v", "lo", "hi")
        near = near.unionByName(cells.mapInPandas(_verify(radius, 4 * group, 4), "kind int, a long, b long").select("a", "b"))
    return near.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) can reach. Nodes without a link have no row."""
    now = materialize(edges.where("a != b").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """(doc_id, rid, fp, root, component_id) for each row of ``docs``; root names the component."""
    rows = materialize(docs.select("doc_id", row_key("doc_id", "text").alias("rid"), fingerprint_column(F.col("text"), shingle).alias("fp")), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints.select("fp"), radius, group))
    known = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = materialize(known, "roots")
    of_root = materialize(known.groupBy("root").agg(F.min("least").alias("component_id")), "components")  # written, so that the join with it can be split at a large component
    by_print = known.join(of_root, "root").select("fp", "root", "component_id")
    return rows.join(by_print, "fp")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the row of the least doc_id of each component (of equal ids, one row), all columns kept."""
    stay = simhash_components(docs, radius, shingle).where("doc_id <=> component_id").groupBy("root").agg(F.min("rid").alias("_rid")).select("_rid")
    keyed = docs.withColumn("_rid", row_key("doc_id", "text"))
    return keyed.join(stay, "_rid").dropDuplicates(["_rid"]).drop("_rid")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
