"""Substring deduplication by suffix order and longest previous factors.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere: anywhere
(``keep="none"``), or earlier in the order of (doc_id, text hash, place) (``keep="first"``: the longest
previous factor at the string's start has ``length`` bytes or more, so the first copy stays).

A suffix array over all documents would be one huge sort. Instead every window of ``length`` bytes has an
owner, the least hash of its ``gram``-byte strings: equal windows have equal owners at the same place, so
suffixes need comparing only within the group of one owner hash. Owners whose hash occurs once are settled by a
count. For the others there is the context, the bytes that the owner's windows cover. Contexts that
are equal as a whole (128-bit hashes, counted before the shuffle) are one class, of which all windows recur; so a
group of copies is one row from here on. Only where a group has several classes, the contexts of their first
members are brought together, aligned at the owner, and the suffixes are sorted column by column from the
right (a stable radix step each), which gives the suffix order at every place.

In that order, neighbours with a common prefix of ``length`` bytes form runs. Within a run a suffix has a previous
factor of that length if a smaller position stands before it (previous smaller value) or behind it
(next smaller value); with the positions negated the same routine finds later factors, and ``keep="none"``
removes what has either. Common prefixes are found by rolling hashes and proved on the bytes.

A group above ``group`` classes is not gathered: its windows are hashed (128 bits) and counted by an
aggregation, which combines before the shuffle. It gives the place of each window that stays; all others of the group's
contexts go, so that nothing is joined back. Both ways give the same bytes.

Shorter passages stay, but the same order shows them: n_shared counts the bytes in strings of ``floor`` bytes that
the context of the same owner in another document has too, at every ``step``-th place from the owner. It misses a
passage under ``length`` bytes where no window around it has the same owner in both documents (a few in a
hundred of 300 bytes and more), and finds nothing in texts under ``length`` bytes.

Defined cases: null is the empty text; texts under ``length`` bytes lose nothing; overlapping repeats count;
repeated rows are further copies, under ``keep="first"`` rows equal in id and text are treated
alike (as the first of them is); an empty table gives no rows; other columns of any name are kept by
``drop_repeats``. Long texts are read in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

LENGTH, FLOOR, STEP, GRAM, CHUNK, GROUP = 400, 256, 16, 32, 8192, 2000
PIECE, TOGETHER = 1 << 20, 1 << 19  # windows of a text hashed at once, and bytes of short texts; places must fit into PLACE bits
PLACE = 24
_BYTES = np.random.Generator(np.random.PCG64(97)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASES = _BASE, np.uint64(0xA0761D6478BD642F)
EMPTY = np.zeros(0, dtype=np.int64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all strings of ``gram`` (a power of two) bytes, by doubling."""
    x = _BYTES[data]
    step = 1
    with np.errstate(over="ignore"):
        while step < gram:
            x = x[:-step] * (_FACTOR + np.uint64(2 * step)) + x[step:]
            x ^= x >> np.uint64(29)
            step *= 2
        return x * _FACTOR


def owners(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` bytes, the place of its least gram hash (of equal ones the last), and the hashes."""
    h = gram_hashes(data, gram)
    width, low = length - gram + 1, np.uint64((1 << PLACE) - 1)
    v = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    full = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(v)] = v
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - width + 1
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (low - (least & low)).astype(np.int64), h


_known: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n - 1); what was computed is kept, at most for two pieces."""
    found = _known.get(int(base))
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        found[0] = 1
        found = np.cumprod(found, dtype=np.uint64)
        if n <= 2 * PIECE:
            _known[int(base)] = found
    return found[:n]


def range_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, bases: tuple = _BASES) -> list[np.ndarray]:
    """A 64-bit hash by each base of every data[start:stop], the same wherever it stands."""
    out, values = [], _BYTES[data]
    for base in bases:
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * powers(base, len(data)), dtype=np.uint64)])
        inverse = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(data) + 1)
        x = (total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * _FACTOR
        out.append((x ^ (x >> np.uint64(29))).view(np.int64))
    return out


def anchors(texts: list[bytes], length: int, gram: int, bases: tuple = _BASES) -> list[np.ndarray]:
    """(index of the text, owner's hash, a hash of its context by each base, its place, first and last window that it owns); places are in the text."""
    out: list[list[np.ndarray]] = []
    group: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        data = np.frombuffer(b"".join(d for _, _, d in group), dtype=np.uint8)
        sizes = np.array([len(d) for _, _, d in group])
        ends = np.cumsum(sizes)
        place, h = owners(data, length, gram)
        start = np.arange(len(place))
        doc = np.repeat(np.arange(len(group)), sizes)[: len(place)]
        whole = start + length <= ends[doc]
        start, place, doc = start[whole], place[whole], doc[whole]
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(start)) - 1
        owner = doc[a]
        base = (ends - sizes)[owner] - np.array([o for _, o, _ in group])[owner]
        hashes = range_hashes(data, start[a], start[b] + length, bases)
        out.append([np.array([i for i, _, _ in group])[owner], h[place[a]].view(np.int64), *hashes, place[a] - base, start[a] - base, start[b] - base])
        group.clear()

    held = 0
    for i, text in enumerate(texts):
        for o in range(0, max(0, len(text) - length + 1), PIECE):
            piece = text[o : o + PIECE + length - 1]
            group.append((i, o, piece))
            held += len(piece)
            if held > TOGETHER:
                flush()
                held = 0
    if group:
        flush()
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [EMPTY] * (5 + len(bases))


def _slices(batches: Iterator[pa.RecordBatch], column: int, length: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for whole in batches:
        for a in range(0, whole.num_rows, 500):
            batch = whole.slice(a, 500)
            yield batch, [t if t is not None and len(t) >= length else b"" for t in batch.column(column).to_pylist()]


def _anchor_keys(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches, 0, length):
            _, h, one, *_ = anchors(texts, length, gram, _BASES[:1])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(one)], names=["h", "c1"])

    return run


SPOT = "doc_id long, th long, h long, c1 long, c2 long, p int, first int, last int"


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches, 2, length):
            who, *hashes, p, first, last = anchors(texts, length, gram)
            who = pa.array(who, pa.int64())
            places = [pa.array(x.astype(np.int32)) for x in (p, first, last)]
            columns = [batch.column(0).take(who), batch.column(1).take(who), *map(pa.array, hashes), *places]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "h", "c1", "c2", "p", "first", "last"])

    return run


CONTEXT = "doc_id long, th long, h long, p int, first int, last int, data binary"


def _contexts(length: int, hot: bool):
    """The context of each owner that stands for its class, in groups within the limit or above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                batch = whole.slice(a, 200)
                spots, counts = batch.column(3).flatten(), pc.list_value_length(batch.column(3)).to_numpy()
                field = lambda name, spots=spots: spots.field(name).to_numpy(zero_copy_only=False)
                chosen = np.flatnonzero(field("rep") & (field("hot") == hot))
                row = np.repeat(np.arange(len(counts)), counts)[chosen]
                h, p, first, last = (field(name)[chosen] for name in ("h", "p", "first", "last"))
                texts: dict[int, bytes] = {k: batch.column(2)[k].as_py() for k in np.unique(row).tolist()}
                data = [texts[k][x:y] for k, x, y in zip(row.tolist(), first.tolist(), (last + length).tolist(), strict=True)]
                who = pa.array(row)
                columns = [batch.column(0).take(who), batch.column(1).take(who), *map(pa.array, (h, p, first, last)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "h", "p", "first", "last", "data"])

    return run


def previous_factors(linked: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, whether a smaller position stands before it (previous smaller value) or behind it (next).

    ``linked[i]`` says that suffixes i and i + 1 have the common prefix asked for, so it looks within runs of linked
    ones: each run's positions are moved below those of the runs that the sweep has passed.
    """
    run = np.concatenate([[0], np.cumsum(~linked)])
    step = rank.max() - rank.min() + 1
    found = np.zeros(len(rank), dtype=bool)
    for sweep, turns in ((slice(None), run[-1] - run), (slice(None, None, -1), run)):
        value = (rank + step * turns)[sweep]
        found[sweep][1:] |= np.minimum.accumulate(value)[:-1] < value[1:]
    return found


class _Prefixes:
    """Finds neighbours with a common prefix of ``length`` bytes, as the columns are worked off from the right."""

    def __init__(self, cells: np.ndarray, columns: np.ndarray, length: int):
        self.cells, self.columns, self.length = cells, columns, length
        self.rolled, self.met = np.zeros(len(cells), dtype=np.uint64), np.full(len(cells), -1)
        self.top = powers(_BASE, length + 1)[-1]

    def move(self, c: int) -> None:
        self.rolled = self.rolled * _BASE + _BYTES[self.columns[c]]
        if c + self.length < len(self.columns):
            self.rolled -= _BYTES[self.columns[c + self.length]] * self.top

    def linked(self, c: int, here: np.ndarray, chained: bool = True) -> np.ndarray:
        """``here`` are rows in suffix order at column c that have so many bytes. Equal hashes are proved on the bytes.

        ``chained``: the column to the right was asked for as well, and what was proved there holds here but for a byte.
        """
        x, y = here[:-1], here[1:]
        good = self.rolled[x] == self.rolled[y]
        at = np.flatnonzero(good)
        x, y = x[at], y[at]
        known = (self.met[x] == y) & chained
        same = self.columns[c][x] == self.columns[c][y]
        for k in range(0, len(new := np.flatnonzero(~known)), 4096):
            some = new[k : k + 4096]
            same[some] = (self.cells[x[some], c : c + self.length] == self.cells[y[some], c : c + self.length]).all(axis=1)
        good[at] = same
        self.met[:] = -1
        self.met[x[same]] = y[same]
        return good


def repeated_windows(data: list[bytes], before: np.ndarray, windows: np.ndarray, rank: np.ndarray, doc: np.ndarray, length: int, floor: int, step: int, gram: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two tables by row and by the column at which a string starts: strings of ``length`` bytes that are to go, and
    those of ``floor`` bytes, at every ``step``-th column from the owner's, that another document has.

    Row i has ``windows[i]`` windows, the first one ``before[i]`` bytes before the owner, which stands in the
    same column in all rows. ``rank`` orders the rows by position, ``doc`` numbers their documents.
    """
    n, side = len(data), length - gram
    cells = np.zeros((n, side + length), dtype=np.uint8)
    first = side - before
    last, end = first + windows - 1, first + np.array([len(x) for x in data])
    for i, (x, a) in enumerate(zip(data, first.tolist(), strict=True)):
        cells[i, a : a + len(x)] = np.frombuffer(x, dtype=np.uint8)
    columns = np.ascontiguousarray(cells.T)
    gone, shared = np.zeros((len(columns), n), dtype=bool), np.zeros((len(columns), n), dtype=bool)
    long, short = _Prefixes(cells, columns, length), _Prefixes(cells, columns, floor)
    order, lowest, highest = np.arange(n), int(first.min()), int(last.max())
    for c in range(len(columns) - 1, lowest - 1, -1):
        order = order[np.argsort(columns[c][order], kind="stable")]
        long.move(c)
        short.move(c)
        if (c - side) % step == 0:
            here = order[(first[order] <= c) & (c + floor <= end[order])]
            linked = short.linked(c, here, step == 1) if len(here) > 1 else np.zeros(0, dtype=bool)
            if linked.any():
                run = np.concatenate([[0], np.cumsum(~linked)])
                starts = np.flatnonzero(np.concatenate([[True], ~linked]))
                of = doc[here]
                shared[c, here] = (np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts))[run]
        if c <= highest:
            here = order[(first[order] <= c) & (c <= last[order])]
            linked = long.linked(c, here) if len(here) > 1 else np.zeros(0, dtype=bool)
            if linked.any():
                found = previous_factors(linked, rank[here])
                gone[c, here] = found if keep_first else found | previous_factors(linked, -rank[here])
    return gone.T, shared.T


MARK = "doc_id long, th long, kind byte, a int, b int"


def _verify(length: int, floor: int, step: int, gram: int, keep_first: bool, chunk: int):
    """Rows of CONTEXT come sorted by h, whose groups are of bounded size. Yields bytes [a, b) that go (kind 0) or that other documents have (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            doc, th, _, p, first, last, data = zip(*rows, strict=True)
            p, first, last = (np.array(x, dtype=np.int64) for x in (p, first, last))
            keys = (p, np.array(th, dtype=np.int64), np.array([d or 0 for d in doc], dtype=np.int64), np.array([d is not None for d in doc]))
            at = np.lexsort(keys)
            news = [np.concatenate([[False], k[at][1:] != k[at][:-1]]) for k in keys]
            other = news[1] | news[2] | news[3]
            rank, number = np.empty(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
            rank[at], number[at] = np.cumsum(other | news[0]), np.cumsum(other)
            out = []
            for kind, marks in enumerate(repeated_windows(list(data), p - first, last - first + 1, rank, number, length, floor, step, gram, keep_first)):
                row, a = np.nonzero(marks)
                b = a + (length, floor)[kind]
                # strings that touch are one stretch
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (a[1:] > b[:-1])])[: len(row)]
                last_of = np.append(new[1:], True)[: len(row)]
                shift = (p - (length - gram))[row[new]]
                out.append((row[new], np.full(int(new.sum()), kind, dtype=np.int8), a[new] + shift, b[last_of] + shift))
            row, kind, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            who = [pa.array([x[i] for i in row.tolist()], pa.int64()) for x in (doc, th)]
            return pa.RecordBatch.from_arrays([*who, pa.array(kind), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["doc_id", "th", "kind", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if len(held) >= chunk and row[2] != held[-1][2]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def _window_hashes(length: int, floor: int, step: int):
    """The hashes of all strings of ``length`` bytes in a context, and of those of ``floor`` bytes at every ``step``-th place from the owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                batch = whole.slice(a, 200)
                p, first = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
                data = batch.column(6).to_pylist()
                sizes = np.array([len(x) for x in data], dtype=np.int64)
                begin, joined = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(data), dtype=np.uint8)
                for kind, size, by, skip in ((0, length, 1, np.zeros_like(p)), (1, floor, step, (p - first) % step)):
                    counts = np.maximum((sizes - size - skip) // by + 1, 0)
                    row = np.repeat(np.arange(len(data)), counts)
                    inside = skip[row] + by * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
                    at = begin[row] + inside
                    one, two = range_hashes(joined, at, at + size)
                    who = pa.array(row)
                    places = [pa.array((first[row] + inside + k).astype(np.int32)) for k in (0, size)]
                    columns = [batch.column(0).take(who), batch.column(1).take(who), pa.array(np.full(len(row), kind, dtype=np.int8)), *places, pa.array(one), pa.array(two)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "kind", "a", "b", "w1", "w2"])

    return run


def same_row(frame: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """A join on doc_id and th where a null id equals a null id."""
    other = other.withColumnsRenamed({"doc_id": "_d", "th": "_h"})
    return frame.join(other, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")), how).drop("_d", "_h")


def candidates(docs: DataFrame, length: int, gram: int, keep: str, group: int) -> DataFrame:
    """(doc_id, th, data, spots): documents with an owner whose hash recurs, and these owners.

    A spot's windows go altogether (whole), are all in another document (across), or are to be compared (rep),
    in a group above the limit (hot).
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("data"))
    keys = keyed.select("data").mapInArrow(_anchor_keys(length, gram), "h long, c1 long")
    often = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("c1") != F.max("c1")).alias("several")).where("n > 1").select("h", "several")
    spots = keyed.mapInArrow(_anchor_rows(length, gram), SPOT).join(materialize(often, "often"), "h")
    spots = materialize(spots, "spots")
    place, who = F.struct("doc_id", "th", "p"), F.struct("doc_id", "th")
    classes = spots.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least"), (F.min(who) != F.max(who)).alias("across"), F.max("several").alias("several"))
    classes = materialize(classes, "classes")
    hot = classes.where("several").groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > group).select("h", F.lit(True).alias("hot"))
    classes = classes.join(materialize(hot, "hot"), "h", "left").drop("several")
    met = spots.join(classes, ["h", "c1", "c2"])
    leading = F.col("least") == place
    whole = (F.col("n") > 1) & (F.lit(True) if keep == "none" else ~leading)
    flags = [whole.alias("whole"), "across", (F.col("several") & leading).alias("rep"), F.coalesce("hot", F.lit(False)).alias("hot")]
    met = met.select("doc_id", "th", "h", "p", "first", "last", *flags).where("whole or across or rep")
    of_doc = met.groupBy("doc_id", "th").agg(F.collect_set(F.struct("h", "p", "first", "last", "whole", "across", "rep", "hot")).alias("spots"))
    return materialize(same_row(keyed, of_doc).select("doc_id", "th", "data", "spots"), "candidates")


def repeats(found: DataFrame, length: int, floor: int, step: int, gram: int, keep: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, th, kind, a, b), from contexts that are not wholly equal: bytes that go (kind 0) and that another document has (kind 1);
    in groups above the limit, the strings that stay (kind 2) and that no other document has (kind 3), all others being of kind 0 or 1.
    """
    keep_first = {"first": True, "none": False}[keep]
    some = lambda hot: found.where(F.exists("spots", lambda s: s["rep"] & (s["hot"] == hot)))
    contexts = lambda hot: some(hot).select("doc_id", "th", "data", "spots").mapInArrow(_contexts(length, hot), CONTEXT)
    dealt = contexts(False).repartition("h").sortWithinPartitions("h")
    marked = dealt.mapInArrow(_verify(length, floor, step, gram, keep_first, chunk), MARK)
    if not some(True).isEmpty():
        windows = materialize(contexts(True).mapInArrow(_window_hashes(length, floor, step), f"{MARK}, w1 long, w2 long"), "windows")
        strings = windows.where("kind = 0").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "a", "b")).alias("least"))
        stay = strings.where(F.lit(keep_first) | (F.col("n") == 1)).select("least.doc_id", "least.th", F.lit(2).cast("byte").alias("kind"), "least.a", "least.b")
        of_doc = windows.where("kind = 1").groupBy("w1", "w2", "doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("places"))
        of_all = of_doc.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", F.sort_array("places").alias("places"))).alias("least"))
        own = of_all.where("n = 1").select("least.doc_id", "least.th", F.lit(3).cast("byte").alias("kind"), F.inline("least.places"))
        marked = marked.unionByName(stay).unionByName(own)
    return marked


def merged(ranges) -> list[tuple[int, int]]:
    """Maximal runs of the union of [a, b)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


CUT = "n_removed long, n_spans long, n_shared long, kept binary, kept_sha256 string"


def others(spots: list, kept: set[int], size: int, step: int, length: int) -> list[tuple[int, int]]:
    """The strings of ``size`` bytes at every ``step``-th place from the owner, in contexts of groups above the limit, that do not start at ``kept``."""
    hot = (s for s in spots if s["rep"] and s["hot"])
    starts = (a for s in hot for a in range(s["first"] + (s["p"] - s["first"]) % step, s["last"] + length - size + 1, step))
    return [(a, a + size) for a in starts if a not in kept]


def _cut(length: int, floor: int, step: int):
    def run(data: pd.Series, spots: pd.Series, marks: pd.Series) -> pd.DataFrame:
        out = []
        for x, own, more in zip(data, spots, marks, strict=True):
            of: list[list[tuple[int, int]]] = [[], [], [], []]
            for m in [] if more is None else more:
                of[m["kind"]].append((m["a"], m["b"]))
            stay, alone = ({a for a, _ in of[kind]} for kind in (2, 3))
            gone = [(s["first"], s["last"] + length) for s in own if s["whole"]]
            runs = merged(gone + of[0] + others(own, stay, length, 1, length))
            also = [(s["first"], s["last"] + length) for s in own if s["across"]]
            shared = merged(also + of[1] + others(own, alone, floor, step, length))
            kept = kept_bytes(bytes(x), runs)
            out.append((sum(b - a for a, b in runs), len(runs), sum(b - a for a, b in shared), kept, sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "n_shared", "kept", "kept_sha256"])

    return F.pandas_udf(run, CUT)


def cut_documents(docs: DataFrame, length: int = LENGTH, floor: int | None = None, step: int = STEP, gram: int = GRAM, keep: str = "first", chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """(doc_id, th, n_removed, n_spans, n_shared, kept, kept_sha256) of documents that lose or share bytes; kept holds what remains.

    n_shared counts the bytes in strings of ``floor`` bytes (by default ``length``) that another document has around the same owner.
    """
    found = candidates(docs, length, gram, keep, group)
    marks = repeats(found, length, floor or length, step, gram, keep, chunk).groupBy("doc_id", "th").agg(F.collect_set(F.struct("kind", "a", "b")).alias("marks"))
    once = same_row(found, marks, "left").dropDuplicates(["doc_id", "th"])
    cut = once.select("doc_id", "th", _cut(length, floor or length, step)("data", "spots", "marks").alias("c")).select("doc_id", "th", "c.*")
    return cut.where("n_removed > 0 or n_shared > 0")


def drop_repeats(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with text cut (bytes that no longer form UTF-8 become U+FFFD), all columns kept."""
    cut = cut_documents(docs, **how).where("n_removed > 0").select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), F.decode("kept", "UTF-8").alias("_text"))
    joined = docs.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h")), "left")
    return joined.select(*[F.coalesce("_text", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op9_lpf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = cut_documents(docs, floor=FLOOR, keep="none").drop("kept").withColumnsRenamed({"doc_id": "_d", "th": "_h"})
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha"))
    joined = base.join(cut, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("doc_id", "n_bytes", count("n_removed"), count("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), count("n_shared"))
