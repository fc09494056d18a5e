"""Sequence packing by the sum-of-squares rule.

Documents become token ids plus an end id; those longer than a sequence are cut, the others stay
whole. Pieces are dealt by a seeded hash into groups of bounded size, and each group is packed by
itself: pieces in descending length go, one by one, to the open bin (or a new one) that leaves the sum
over residual gaps of the squared number of open bins smallest. A group leaves a few bins open, so the
loss against one global packing is those bins over the tens of thousands that a group fills.

Defined cases: a null text is empty and yields the end id alone; an empty table yields no rows;
repeated rows are packed each for itself; equal lengths are taken in the order of (doc_id, piece).
Columns other than the id and the text are ignored, so their names can't clash; a very long text is encoded whole
by one task, and its pieces are rows of their own from there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

SEQUENCE, END_ID, GROUP_PIECES, BATCH_BYTES = 4096, 1, 50_000, 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"

_encoders: dict[str, WordCache] = {}


class Known:
    """Strings and what each stands for, as Arrow arrays: a few bytes a string, where a dictionary takes hundreds."""

    def __init__(self, limit: int, longest: int, learn: Callable[[pa.Array], pa.Array]):
        self.limit, self.longest, self.learn = limit, longest, learn
        self.keys, self.values = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def get(self, strings: pa.Array) -> pa.Array:
        """The values of distinct strings; those not met before are learnt, and kept if short.

        Beyond the limit, those stay that these strings name.
        """
        at = pc.index_in(strings, value_set=self.keys)
        missing = at.is_null()
        new = strings.filter(missing)
        if not len(new):
            return self.values.take(at)
        learnt = self.learn(new)
        places = pc.fill_null(at, 0).to_numpy().copy()
        places[missing.to_numpy(zero_copy_only=False)] = len(self.keys) + np.arange(len(new), dtype=places.dtype)
        found = pa.concat_arrays([self.values, learnt]).take(pa.array(places))
        if len(self.keys) + len(new) > self.limit:
            self.keys, self.values, new, learnt = self.keys[:0], self.values[:0], strings[: self.limit], found[: self.limit]
        short = pc.less_equal(pc.binary_length(new), self.longest)
        self.keys = pa.concat_arrays([self.keys, new.filter(short)])
        self.values = pa.concat_arrays([self.values, learnt.filter(short)])
        return found


def cut_up(raw: bytes | pa.Buffer, cuts: np.ndarray) -> pa.Array:
    """The strings of bytes between cuts."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)])


def laid_out(values: pa.Array) -> tuple[pa.Buffer | bytes, np.ndarray]:
    """The bytes of all values, and where each begins and ends. Either buffer can be left out where there is none."""
    _, cuts, raw = values.buffers()
    if not len(values):
        return b"", np.zeros(1, dtype=np.int64)
    return raw or b"", np.frombuffer(cuts, dtype=np.int64)[values.offset : values.offset + len(values) + 1]


class WordCache:
    """Ids of texts by way of their whitespace-separated words.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    words in order. A word of printable ASCII and Latin-1 letters splits further into the tokenizer's own
    pre-tokens, which need its merges alone. Only what was not met before is encoded, many words in one
    call. The cache holds a bounded number of words and of pre-tokens.
    """

    LIMIT, LONG, CALL = 300_000, 48, 500
    #: The pre-tokenizer's pattern for these characters after lower-casing (fixed value of the vocabulary file).
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+|\n")
    PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
    #: Arrow parts words at the first four, the tokenizer doesn't; the others it reads as special ids.
    ODD = "[\\x1c-\\x1f]|<\\|(startoftext|endoftext)\\|>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        def merges(*steps) -> Tokenizer:
            t = Tokenizer(self.tokenizer.model)  # the same one, not a copy
            t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), *steps])
            return t

        self.tokenizer = Tokenizer.from_file(path)
        self.ascii_merges = merges()
        self.latin_merges = merges(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Known(self.LIMIT, self.LONG, self.learn)
        self.parts = Known(self.LIMIT, self.LONG, self.learn_parts)

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn_words(self, new: list[str]) -> pa.Array:
        """Any words: offsets tell which word a token comes from."""
        raw, cuts = [], [np.zeros(1, dtype=np.int64)]
        for k in range(0, len(new), self.CALL):
            some = new[k : k + self.CALL]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in some])
            at = np.searchsorted(ends, [a for a, _ in e.offsets], side="right")
            cuts.append(cuts[-1][-1] + 4 * np.searchsorted(at, np.arange(1, len(some) + 1)))
            raw.append(np.array(e.ids, dtype="<u4").tobytes())
        return cut_up(b"".join(raw), np.concatenate(cuts))

    def learn_parts(self, new: pa.Array) -> pa.Array:
        """Lower-case pre-tokens: the last token of each is one that ends a word. The line's end has none."""
        kinds = np.where(pc.string_is_ascii(new).to_numpy(zero_copy_only=False), 1, 2)
        kinds[pc.equal(new, "\n").to_numpy(zero_copy_only=False)] = 0
        ids, sizes = [], [np.zeros(np.count_nonzero(kinds == 0), dtype=np.int64)]
        for kind, merges in ((1, self.ascii_merges), (2, self.latin_merges)):
            some = listed(new.filter(pa.array(kinds == kind)))
            calls = [np.array(merges.encode_batch_fast([" ".join(some[k : k + self.CALL])], add_special_tokens=False)[0].ids, dtype="<u4") for k in range(0, len(some), self.CALL)]
            own = np.concatenate([np.zeros(0, dtype="<u4"), *calls])
            ids.append(own)
            sizes.append(np.diff(np.flatnonzero(self.ends_word[own]) + 1, prepend=0))
        cuts = np.concatenate([[0], np.cumsum(4 * np.concatenate(sizes))])
        return reordered(cut_up(np.concatenate(ids).tobytes(), cuts), kinds)

    def learn(self, new: pa.Array) -> pa.Array:
        """Plain words are split in one go, a line each; their ids are those of their parts, joined."""
        plain = pc.match_substring_regex(new, self.PLAIN)
        others = self.learn_words(listed(new.filter(pc.invert(plain))))
        flat = pa.array(self.PARTS.findall("\n".join([*listed(new.filter(plain)), ""]).lower()), pa.string()).dictionary_encode()
        joined = self.parts.get(flat.dictionary).take(flat.indices)
        lines = pc.equal(flat.dictionary, "\n").to_numpy(zero_copy_only=False)[flat.indices.to_numpy()]
        raw, cuts = laid_out(joined)
        words = cut_up(raw, np.concatenate([[0], cuts[1:][lines]]))
        return reordered(pa.concat_arrays([words, others]), pc.invert(plain).to_numpy(zero_copy_only=False))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each begins and ends. Distinct words are looked up once."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.ODD)
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        lines = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        words = split.flatten().dictionary_encode()
        del split
        raw, cuts = laid_out(self.words.get(words.dictionary).take(words.indices))
        cuts = cuts[lines] // 4
        ids = np.frombuffer(raw, dtype="<u4", count=cuts[-1])
        if pc.any(odd).as_py():
            out = [self.direct(t) if o else ids[a:b].tobytes() for t, o, a, b in zip(texts.to_pylist(), odd.to_pylist(), cuts, cuts[1:], strict=False)]
            cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])])
            ids = np.frombuffer(b"".join(out), dtype="<u4")
        return ids, cuts


def listed(strings: pa.Array) -> list[str]:
    """to_pylist() makes a scalar of each string first."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def reordered(values: pa.Array, kinds: np.ndarray) -> pa.Array:
    """Values that come kind by kind, in the order of the kinds given."""
    back = np.empty(len(kinds), dtype=np.int64)
    back[np.argsort(kinds, kind="stable")] = np.arange(len(kinds))
    return values.take(pa.array(back))


def _pieces(tokenizer: str, sequence: int, end_id: int, with_ids: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(tokenizer, None) or WordCache(tokenizer)
        _encoders[tokenizer] = encoder
        end = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for batch in bounded(whole):
                ids, cuts = encoder.batch(batch.column(1))
                out: list[tuple] = []
                for doc, a, b in zip(batch.column(0).to_pylist(), cuts.tolist(), cuts[1:].tolist(), strict=False):
                    raw = ids[a:b].tobytes() + end
                    for k, c in enumerate(range(0, len(raw), 4 * sequence)):
                        part = raw[c : c + 4 * sequence]
                        out.append((doc, k, c // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                doc, k, start, length, crc, parts = zip(*out, strict=True) if out else [()] * 6
                columns = [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(parts, pa.binary())] if with_ids else [])], names=[*names, *(["ids"] if with_ids else [])])

    return run


def bounded(batch: pa.RecordBatch, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text, or of one row where that is longer."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + size, side="right")))
        yield batch.slice(a, b - a)
        a = b


def sum_of_squares(lengths: np.ndarray, sequence: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, taken in the given order.

    Putting a piece of length s into a bin of gap g changes the sum of squares by
    ``2 (n[g-s] - n[g]) + 2``, a new bin by ``2 n[sequence-s] + 1``; full bins do not count.
    Among equals the smallest gap is taken, and a new bin only if it is strictly better.
    """
    n = np.zeros(sequence + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(sequence + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made, far = 0, np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        best = 0
        if s < sequence:
            here = n[s:]
            change = np.where(here > 0, 2 * (n[: sequence + 1 - s] - here) + 2, far)
            change[0] = 1 - 2 * here[0] if here[0] else far
            k = int(change.argmin())
            if change[k] != far and change[k] <= 2 * n[sequence - s] + 1:
                best = k + s
        if best:
            b = open_bins[best].pop()
            n[best] -= 1
        else:
            b, best = made, sequence
            made += 1
        bins[i], offsets[i] = b, sequence - best
        if left := best - s:
            open_bins[left].append(b)
            n[left] += 1
    return bins, offsets


def _pack_group(sequence: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(group["length"].to_numpy(), sequence)
        return group.assign(sequence_id=group["g"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns="g")

    return run


def cut_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, written; with their ids (little-endian unsigned 32 bits) if asked for."""
    schema = f"{PIECES}, ids binary" if with_ids else PIECES
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_pieces(tokenizer, sequence, end_id, with_ids), schema)
    return materialize(cut, "pieces")


def placed(cut: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """PACKED for the pieces."""
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.select("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "ids_crc32", "start"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(_pack_group(sequence), PACKED)


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """Pieces of all documents with the sequence and the place that each is given."""
    return placed(cut_documents(docs, tokenizer, sequence, end_id), sequence, group_pieces, seed)


def packed_sequences(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, each of at most ``sequence`` ids.

    Pieces that agree in all that names them (repeated rows) have the same ids, so any of them fills any of their places.
    """
    cut = cut_documents(docs, tokenizer, sequence, end_id, with_ids=True)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    places = materialize(placed(cut, sequence, group_pieces, seed), "placed").withColumnsRenamed({c: f"_{c}" for c in names})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    met = places.join(cut.dropDuplicates(names), same[0] & same[1] & same[2] & same[3] & same[4])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p))
    return met.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def op10_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
