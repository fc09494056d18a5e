"""A quality classifier by Bradley-Terry pairwise ranking.

Pairs of a labelled good and a labelled bad document say that the first is preferred. Scores are linear
in features of the text, and the weights minimise the logistic loss on feature differences of the pairs
(Newton's method with a ridge). The threshold is a quantile of the training scores, the one with
the fewest errors on the labelled documents; the output maps it to the score ``CUT``.

Fitting takes a bounded sample of labelled rows (``per_class`` of each label on average, drawn by a hash of the
id) and a bounded number of pairs, so the driver holds a few thousand feature rows at any size of
corpus. Scoring is a map over all rows without a shuffle and reads whole texts.

Defined cases: null and empty texts have the features of no words and get a score like any other;
without labels of both kinds every score is 0.5; labels that are null are not used; repeated rows score alike, and
repeated labels weigh as often as they occur; an empty table gives no rows; other columns are kept under any names but _score;
a very long text is held whole by one task, with its distinct words and pairs of words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, table

PER_CLASS, PAIRS, SEED, CUT, RIDGE = 6000, 100_000, 5, 0.3, 1e-3

_KIND = np.zeros(256, dtype=np.int64)  # 0 other
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"\"'()-"), 1):
    _KIND[list(_bytes)] = _k
_KIND[128:] = 10
_KINDS = 11


def features(text: str | None) -> list[float]:
    """Shares of kinds of characters, word and line statistics, repetition."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=_KINDS) / n
    share = counts[counts > 0] / n
    words = data.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = data.split(b"\n")
    return [
        *kinds.tolist(),
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        np.log1p(float(lengths.max())),
        distinct / w,
        distinct / w**0.8,
        pairs / max(1, w - 1),
        len(set(lines)) / len(lines),
        np.log1p(w / len(lines)),
        float(-(share * np.log(share)).sum()),
        w / n,
        kinds[2] / max(1e-9, kinds[1] + kinds[2] + kinds[10]) if data else 0.0,
        float(counts.max() / n),
        float(lengths.min() if words else 0),
    ]


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and their squares: bad text can lie on either side of good."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, z * z / 6])


class Ranker:
    """score() maps raw Bradley-Terry scores so that the chosen quantile lies at CUT."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = SEED, sizes: dict[int, int] | None = None):
        """``sizes``: how many labelled rows of each kind the sample stands for; by them errors weigh in the choice of the quantile."""
        good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
        self.fitted = len(good) > 0 and len(bad) > 0
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = _expand(x, self.mean, self.scale)
        diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad = -(diff * p[:, None]).mean(axis=0) + ridge * w
            hess = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.w, raw = w, z @ w
        order, weight = np.argsort(raw, kind="stable"), sizes or {0: len(bad), 1: len(good)}
        gain = np.concatenate([[0.0], np.cumsum(np.where(y[order] == 0, weight[0] / len(bad), -weight[1] / len(good)))])
        k = int(np.flatnonzero(gain >= gain.max() - 1e-9 * sum(weight.values())).mean())
        ranked = raw[order]
        self.quantile = k / len(raw)  # rejected share of the training rows
        self.cut = (ranked[max(0, k - 1)] + ranked[min(len(raw) - 1, k)]) / 2
        self.spread = max(float(np.std(raw)), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        raw = _expand(x, self.mean, self.scale) @ self.w
        return 1 / (1 + np.exp(np.clip(-(2 * (raw - self.cut) / self.spread + np.log(CUT / (1 - CUT))), -30, 30)))


def _feature_rows(texts: pd.Series) -> np.ndarray:
    return np.array([features(t if isinstance(t, str) else None) for t in texts], dtype=float).reshape(len(texts), -1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> Ranker:
    """Learns from labelled rows that are not held out."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("quality") == 1, per_class / max(1, sizes.get(1, 1))).otherwise(per_class / max(1, sizes.get(0, 1)))
    sample = F.broadcast(known.where(draw < share))  # about 2 x per_class rows of two numbers
    featured = F.pandas_udf(lambda texts: pd.Series(list(_feature_rows(texts))), "array<double>")(F.col("text"))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("quality", featured.alias("x")).collect()
    if not rows:
        return Ranker(np.empty((0, 1)), np.empty(0))
    rows.sort(key=lambda r: (r["quality"], r["x"]))  # the fit does not depend on the order of tasks
    return Ranker(np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows]), seed=seed, sizes=sizes)


def score_column(text: Column, ranker: Ranker) -> Column:
    return F.pandas_udf(lambda texts: pd.Series(ranker.score(_feature_rows(texts)) if ranker.fitted else np.full(len(texts), 0.5)), "double")(text)


def keep_good(docs: DataFrame, ranker: Ranker, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that score under the cut."""
    return docs.withColumn("_score", score_column(F.col("text"), ranker)).where(F.col("_score") >= cut).drop("_score")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), ranker).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
