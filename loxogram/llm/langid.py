"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a generator that its code point seeds. An
n-gram's vector binds (multiplies) the vectors of its letters, each permuted (rolled) by its place; a
document's vector bundles (adds) those of its n-grams; a language's prototype bundles the vectors of
its training documents. A document gets the language whose prototype has the greatest cosine with it.

Training documents are sampled by a hash of the id, up to ``per_language`` for each language on average
(a bounded sample); prototypes are added up by Spark, and the driver gets one vector per language.
Prediction is a map over the rows without a shuffle. n-grams of a batch are counted first and multiplied
as one matrix; vectors of recent n-grams are kept in a cache of bounded size.

Defined cases: a null text and one without a letter get ``und`` and score 0, as does every row if no
training row has a letter; ties go to the language first in order; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, table

DIMENSION, ORDER, PER_LANGUAGE, SEED = 1024, 3, 4000, 11
UNKNOWN = "und"
SPACE = 32


class Profiles:
    """n-gram vectors, with a bounded cache."""

    LIMIT = 40_000
    letters: np.ndarray | None = None

    def __init__(self, dimension: int = DIMENSION, order: int = ORDER, seed: int = SEED):
        self.dimension, self.order, self.seed = dimension, order, seed
        self.items: dict[int, np.ndarray] = {}
        self.codes, self.vectors = np.empty(0, dtype=np.uint64), np.empty((0, dimension), dtype=np.int8)

    @classmethod
    def is_letter(cls, code: np.ndarray) -> np.ndarray:
        if cls.letters is None:
            cls.letters = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
        return cls.letters[code]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """n-gram codes and counts: lower case, every run of other characters one space, a space at either end."""
        code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = self.is_letter(code)
        if not letter.any():
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        code = np.concatenate([[SPACE], np.where(letter, code, SPACE), [SPACE]]).astype(np.uint64)
        code = code[np.concatenate([[True], (code[1:] != SPACE) | (code[:-1] != SPACE)])]
        n = len(code) - self.order + 1
        if n < 1:  # a single letter and a long order
            code, n = np.concatenate([code, np.full(1 - n, SPACE, dtype=np.uint64)]), 1
        gram = np.zeros(n, dtype=np.uint64)
        for k in range(self.order):
            gram = (gram << np.uint64(21)) | code[k : k + n]
        return np.unique(gram, return_counts=True)

    def item(self, letter: int) -> np.ndarray:
        if letter not in self.items:
            if len(self.items) > 20_000:
                self.items.clear()
            bits = np.random.Generator(np.random.PCG64([self.seed, letter])).integers(0, 2, self.dimension, dtype=np.int8)
            self.items[letter] = 2 * bits - 1
        return self.items[letter]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.dimension), dtype=np.int8)
        for k in range(self.order):
            letters, at = np.unique((grams >> np.uint64(21 * (self.order - 1 - k))) & np.uint64((1 << 21) - 1), return_inverse=True)
            out *= np.stack([np.roll(self.item(int(x)), k) for x in letters])[at]
        return out

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct n-grams."""
        at = np.searchsorted(self.codes, grams)
        known = np.zeros(len(grams), dtype=bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == grams[inside]
        new = grams[~known]
        if len(new):
            if len(self.codes) + len(new) > self.LIMIT:
                self.codes, self.vectors = self.codes[:0], self.vectors[:0]
                new = grams
            codes = np.concatenate([self.codes, new])
            order = np.argsort(codes, kind="stable")
            self.codes, self.vectors = codes[order], np.concatenate([self.vectors, self.bind(new)])[order]
            at = np.searchsorted(self.codes, grams)
        return self.vectors[at]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text; zero where there is no letter."""
        each = [self.grams(t) for t in texts]
        every, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
        out, cut = np.zeros((len(texts), self.dimension), dtype=np.float64), np.cumsum([0, *(len(g) for g, _ in each)])
        row = np.repeat(np.arange(len(texts)), np.diff(cut))
        count = np.concatenate([c for _, c in each]).astype(np.float32)
        for a in range(0, len(every), 8192):  # bounded memory for texts of very many n-grams
            vectors = self.lookup(every[a : a + 8192]).astype(np.float32)
            dense = np.zeros((len(texts), len(vectors)), dtype=np.float32)
            here = (at >= a) & (at < a + 8192)
            dense[row[here], at[here] - a] = count[here]
            out += dense @ vectors
        return out


_profiles: dict[tuple, Profiles] = {}


def _shared(key: tuple) -> Profiles:
    if key not in _profiles:
        _profiles[key] = Profiles(*key)
    return _profiles[key]


def learn(training: DataFrame, dimension: int = DIMENSION, order: int = ORDER, per_language: int = PER_LANGUAGE, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (rows of length 1) from columns doc_id, text and lang."""
    training = training.where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}  # a row per language
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, per_language / v))]) if sizes else None
    if share is None:
        return [], np.empty((0, dimension))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = training.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        profiles = _shared((dimension, order, seed))
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 64):
                vectors = profiles.bundle(texts[a : a + 64])
                for lang, v in zip(langs[a : a + 64], vectors, strict=True):
                    if v.any():
                        sums[lang] = sums.get(lang, 0) + v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"]
        )

    parts = sample.mapInArrow(add_up, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "v"))
    rows = parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()  # languages x dimension
    langs = sorted({r["lang"] for r in rows})
    prototypes = np.zeros((len(langs), dimension))
    for r in rows:
        prototypes[langs.index(r["lang"]), r["i"]] = r["v"]
    return langs, prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)


def language_column(text: Column, langs: list[str], prototypes: np.ndarray, dimension: int = DIMENSION, order: int = ORDER, seed: int = SEED) -> Column:
    """struct(lang_pred, score); the score is the cosine with the language's prototype, 0 at least."""

    def run(texts: pd.Series) -> pd.DataFrame:
        profiles, lang, score = _shared((dimension, order, seed)), [], []
        for a in range(0, len(texts), 64):
            vectors = profiles.bundle([t if isinstance(t, str) else None for t in texts.iloc[a : a + 64]])
            norms = np.linalg.norm(vectors, axis=1)
            cosines = vectors @ prototypes.T / np.maximum(norms, 1e-9)[:, None] if langs else np.zeros((len(vectors), 1))
            best = cosines.argmax(axis=1)
            known = (norms > 0) & bool(langs)
            lang += [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            score += np.where(known, cosines[np.arange(len(best)), best], 0).clip(0, 1).tolist()
        return pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": pd.Series(score, dtype=float)})

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, prototypes = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_column(F.col("text"), langs, prototypes).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
