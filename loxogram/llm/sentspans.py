"""Substring deduplication over sliding spans of sentences.

Every run of ``span`` consecutive sentences is hashed; a run under ``min_words`` words goes on by further
sentences until it has them, since short ones ("Yes. No. Yes.") recur by chance. Runs are joined globally by
their hashes (128 bits). Of equal runs the first in the order of (doc_id, text hash, place) stays, and every
sentence that another one covers is removed.

Sentences do not show a passage that starts or ends inside one, or that has fewer than ``span``. So passages
of ``window`` words that different documents share are found as well, wherever they start: each window is named by
its least hash of ``gram`` consecutive words, which stands at the same place in equal windows, and the
stretch of windows that one such gram names is a unit like a run. Stretches that are equal as a whole are settled
by that; of each kind of stretch around a shared gram only the first one's windows are compared one by one. Of
equal windows the first by (doc_id, text hash) stays, and the words that another document's window covers go,
with the white space that follows them.

A word is what white space separates; in scripts without spaces each character is a word. A sentence ends after a word
whose last character is one of . ! ? (or their full-width forms) and at a line break.

All counts are aggregated before the shuffle, so a unit that a third of the documents share is a few rows there;
where rows meet the repeated hashes, adaptive execution splits what one key holds. Only repeated
units go on, and per document the removed places are gathered, which its own length bounds.

Defined cases: null, empty and blank texts have no words and stay as they are; a document of fewer words than
``min_words`` and ``window`` loses nothing; repeated rows are copies, of which the first keeps its
sentences only if the copies differ in id or text: rows equal in both keep or lose them all alike;
columns named n_sentences and n_removed are replaced, other columns are kept as they are; an empty table gives no
rows. A text is held whole by one task, at about 100 bytes a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

SPAN, MIN_WORDS = 3, 40
#: Words of a passage that is found wherever it starts, and of the grams that name it.
WINDOW, GRAM = 51, 8
#: Marks that end a sentence.
ENDS = ".!?。！？"
#: Scripts that put no spaces between words: Thai to Burmese, Khmer, kana, Han.
UNSPACED = (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)
#: Characters of the texts that are worked on at once (a longer text is taken alone).
TOGETHER = 1 << 20
_SPACE, _ALONE, _END, _LINE = 1, 2, 4, 8
_CHAR, _RUN, _OTHER, _MIX = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x9E3779B97F4A7C15))
_LOW = 26  # bits of a place in the words of one group


def _kinds() -> np.ndarray:
    kinds = np.zeros(0x110000, dtype=np.uint8)
    kinds[[c for c in range(0x10000) if chr(c).isspace()]] = _SPACE
    for low, high in UNSPACED:
        kinds[low : high + 1] = _ALONE
    kinds[[ord(c) for c in ENDS]] |= _END
    kinds[ord("\n")] |= _LINE
    return kinds


KINDS = _kinds()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """The words of several texts, in order: where each starts in its text, its text, its hash, whether it ends a sentence."""

    start: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    ends: np.ndarray
    n_docs: int

    @property
    def cuts(self) -> np.ndarray:
        """The first word of each text, and the number of words."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def sentences(self) -> np.ndarray:
        """The first word of each sentence."""
        if not len(self.doc):
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(np.concatenate([[True], self.ends[:-1] | (self.doc[1:] != self.doc[:-1])]))

    def sums(self, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """What ``span_hash`` needs."""
        n, inverse = len(self.hash), np.uint64(pow(int(base), -1, 1 << 64))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.hash * _powers(base, n), dtype=np.uint64)])
        return total, _powers(inverse, n + 1)


def span_hash(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of words [start, stop), the same wherever they stand."""
    total, inverse = sums
    return _mixed((total[stop] - total[start]) * inverse[start])


def words_of(texts: list[str | None]) -> Words:
    texts = [t or "" for t in texts]
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    kinds = KINDS[points]
    solid, alone = (kinds & _SPACE) == 0, (kinds & _ALONE) != 0
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | alone[1:] | alone[:-1]
    at = np.flatnonzero(opens)
    if not len(at):
        return Words(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, bool)), len(texts))
    place = np.arange(len(points))
    offset = place - np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(points)]])))
    value = _mixed(points.astype(np.uint64) + np.uint64(1)) * _powers(_CHAR, int(offset.max()) + 1)[offset]
    value[~solid] = 0
    hashes = _mixed(np.add.reduceat(value, at))
    closing = np.flatnonzero(solid & np.append(opens[1:] | ~solid[1:], True))
    ends = (kinds[closing] & _END) != 0
    lines = np.concatenate([[0], np.cumsum((kinds & _LINE) != 0)])
    ends |= lines[np.append(at[1:], len(points))] > lines[at]
    doc = np.searchsorted(begin, at, side="right") - 1
    return Words(at - begin[doc], doc, hashes, ends, len(texts))


def sentence_runs(words: Words, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of each run, as words."""
    first = words.sentences()
    if not len(first):
        return first, first
    bounds = np.append(first, len(words.doc))
    stop = np.maximum(np.arange(len(first)) + span, np.searchsorted(bounds, first + min_words))
    fits = stop <= len(first)
    start, stop = first[fits], bounds[stop[fits]]
    same = words.doc[start] == words.doc[stop - 1]
    return start[same], stop[same]


def gram_stretches(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of a gram, first and last window that it names), windows by their first word."""
    n = len(words.hash) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64) for _ in range(2))
    at = np.arange(len(words.hash) - gram + 1)
    hashes = span_hash(words.sums(_RUN), at, at + gram)
    low, width = np.uint64((1 << _LOW) - 1), window - gram + 1
    ordered = (hashes & ~low) | (low - at.astype(np.uint64))
    full = np.full(-(-len(ordered) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(ordered)] = ordered
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    owner = (low - (least & low)).astype(np.int64)
    whole = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    if not len(whole):
        return np.zeros(0, dtype=np.uint64), whole, whole
    owner, doc = owner[whole], words.doc[whole]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(whole)) - 1
    return hashes[owner[a]], whole[a], whole[b]


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The rows in slices of about ``TOGETHER`` characters, with the words of a column's texts."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        ends = np.cumsum([len(t or "") + 1 for t in texts])
        a = 0
        while a < len(texts):
            base = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, base + TOGETHER, side="right")))
            yield batch.slice(a, b - a), words_of(texts[a:b])
            a = b


@dataclass(frozen=True)
class Spans:
    """What counts as a passage."""

    span: int = SPAN
    min_words: int = MIN_WORDS
    window: int = WINDOW
    gram: int = GRAM

    def units(self, words: Words) -> tuple[np.ndarray, ...]:
        """(kind, hash, second hash, first word, end) of runs (kind 0) and of stretches (kind 1)."""
        a, b = sentence_runs(words, self.span, self.min_words)
        g, first, last = gram_stretches(words, self.window, self.gram)
        one, two = words.sums(_RUN), words.sums(_OTHER)
        stop = last + self.window
        kind = np.concatenate([np.zeros(len(a), dtype=np.int8), np.ones(len(g), dtype=np.int8)])
        start, end = np.concatenate([a, first]), np.concatenate([b, stop])
        return kind, np.concatenate([span_hash(one, a, b), g]), span_hash(two, start, end), start, end


UNIT = "doc_id long, th long, kind byte, h1 long, h2 long, pos int, stop int"


def _unit_keys(spans: Spans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _groups(batches, 0):
            kind, h1, *_ = spans.units(words)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(h1.view(np.int64))], names=["kind", "h1"])

    return run


def _units(spans: Spans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _groups(batches, 2):
            kind, h1, h2, start, stop = spans.units(words)
            who = words.doc[start] if len(start) else start
            base = words.cuts[who]
            at = pa.array(who)
            columns = [kind, h1.view(np.int64), h2.view(np.int64), (start - base).astype(np.int32), (stop - base).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, columns)], names=["doc_id", "th", "kind", "h1", "h2", "pos", "stop"])

    return run


def _windows(spans: Spans):
    """Hashes of the windows within the stretches of the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _groups(batches, 2):
            stretches, cuts = batch.column(3), words.cuts
            who = np.repeat(np.arange(batch.num_rows), [len(s) for s in stretches])
            flat = stretches.flatten()
            pos, stop = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            counts = stop - pos - spans.window + 1
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            start, who = np.repeat(pos, counts) + inside, np.repeat(who, counts)
            at = start + cuts[who]
            h1, h2 = (span_hash(words.sums(b), at, at + spans.window).view(np.int64) for b in (_RUN, _OTHER))
            rows = pa.array(who)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(h1), pa.array(h2)], names=["doc_id", "th", "pos", "h1", "h2"])

    return run


def same_row(frame: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """A join on doc_id and th where a null id equals a null id."""
    other = other.withColumnsRenamed({"doc_id": "_d", "th": "_h"})
    return frame.join(other, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")), how).drop("_d", "_h")


def repeated_spans(docs: DataFrame, spans: Spans | None = None) -> DataFrame:
    """(doc_id, th, pos, stop): words [pos, stop) to remove; th is the text's hash."""
    spans = spans or Spans()
    keyed = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    keys = keyed.select("text").mapInArrow(_unit_keys(spans), "kind byte, h1 long")
    often = materialize(keys.groupBy("kind", "h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "h1"), "often")
    shared = materialize(keyed.mapInArrow(_units(spans), UNIT).join(often, ["kind", "h1"]), "shared")
    place = F.struct("doc_id", "th", "pos", "stop")
    grouped = shared.groupBy("kind", "h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    grouped = materialize(grouped, "grouped")
    # a run must not be its group's first; a stretch must not be in the first one's document
    again = shared.join(grouped.where("first != last"), ["kind", "h1", "h2"])
    again = again.where(F.when(F.col("kind") == 0, F.col("first") != place).otherwise(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th")))))

    stretches = grouped.where("kind = 1")
    several = stretches.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1")
    firsts = stretches.join(materialize(several, "several"), "h1").select("first.*")
    firsts = firsts.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "stop")).alias("stretches"))
    met = same_row(keyed, firsts).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "text", "stretches")
    windows = materialize(met.mapInArrow(_windows(spans), "doc_id long, th long, pos int, h1 long, h2 long"), "windows")
    who = F.struct("doc_id", "th")
    first = windows.groupBy("h1", "h2").agg(F.min(who).alias("first"), F.max(who).alias("last")).where("first != last").drop("last")
    moved = windows.join(materialize(first, "first"), ["h1", "h2"]).where(F.col("first") != who)
    return again.select("doc_id", "th", "pos", "stop").unionByName(moved.select("doc_id", "th", "pos", (F.col("pos") + spans.window).alias("stop")))


def cut_text(text: str | None, words: Words, ranges) -> tuple[str | None, int]:
    """``text`` without the words of the ranges and the white space after them, and the sentences that lost words."""
    change = np.zeros(len(words.start) + 1, dtype=np.int64)
    pos, stop = (np.array([r[k] for r in ranges], dtype=np.int64) for k in ("pos", "stop"))
    np.add.at(change, pos, 1)
    np.add.at(change, stop, -1)
    gone = np.cumsum(change)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    bounds = np.append(words.start, len(text))
    bounds[0] = 0
    at = [0, *bounds[edge].tolist(), len(text)]
    kept = "".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
    return kept, int(np.logical_or.reduceat(gone, words.sentences()).sum())


def _cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    texts = [t if isinstance(t, str) else None for t in texts]
    kept, total, removed = list(texts), np.zeros(len(texts), dtype=np.int32), np.zeros(len(texts), dtype=np.int32)
    sizes = np.cumsum([len(t or "") + 1 for t in texts])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + TOGETHER, side="right")))
        words = words_of(texts[a:b])
        cuts, first = words.cuts, words.sentences()
        if len(first):
            total[a:b] = np.bincount(words.doc[first], minlength=b - a)
        for k in range(a, b):
            if ranges.iloc[k] is not None and len(ranges.iloc[k]):
                own = slice(cuts[k - a], cuts[k - a + 1])
                one = Words(words.start[own], words.doc[own], words.hash[own], words.ends[own], 1)
                kept[k], removed[k] = cut_text(texts[k], one, ranges.iloc[k])
        a = b
    return pd.DataFrame({"text": pd.Series(kept, dtype=object), "n_sentences": total, "n_removed": removed})


def drop_repeated_runs(docs: DataFrame, spans: Spans | None = None) -> DataFrame:
    """``docs`` with text cut, and the columns n_sentences and n_removed: sentences before, and those that went or lost words."""
    ranges = repeated_spans(docs, spans).groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "stop")).alias("_ranges"))
    ranges = ranges.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "_ranges")
    joined = docs.join(ranges, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h")), "left")
    cut = F.pandas_udf(_cut, "text string, n_sentences int, n_removed int")(F.col("text"), F.col("_ranges"))
    kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    joined = joined.withColumn("_cut", cut)
    return joined.select(*[F.col("_cut.text").alias("text") if c == "text" else F.col(c) for c in kept], "_cut.n_sentences", "_cut.n_removed")


def op3_spans(spark, sf_dir: str) -> DataFrame:
    return drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
