"""Similarity of weighted term vectors that are held as rows (id, term, w)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("sum", "jaccard", "cosine")


def _known(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"similarity must be one of {KINDS}, not {kind!r}")
    return kind


def joint_weight(kind: str, w: Column) -> Column:
    """Aggregate of a vector's weights that its similarities are measured by: the squares for cosine, else the sum."""
    return F.sum(w * w) if _known(kind) == "cosine" else F.sum(w)


def shared_similarity(kind: str, shared: Column, t1: Column, t2: Column) -> Column:
    """``pair_similarity`` from what the pair shares."""
    if _known(kind) == "sum":
        return shared
    whole = F.sqrt(t1) * F.sqrt(t2) if kind == "cosine" else t1 + t2 - shared
    return F.when(whole > 0, shared / whole).otherwise(0.0)


def pair_similarity(kind: str, w1: Column, w2: Column, t1: Column, t2: Column) -> Column:
    """Aggregate over a pair's shared terms; t1 and t2 are the ``joint_weight`` of its vectors.

    sum: shared weight, the smaller of the two for each term (not bounded by 1);
    jaccard: shared weight over the weight of the union; cosine: the usual one.
    """
    return shared_similarity(_known(kind), F.sum(w1 * w2 if kind == "cosine" else F.least(w1, w2)), t1, t2)


def array_weight(kind: str, vector: Column) -> Column:
    """``joint_weight`` of a vector that is held as an array of (term, w)."""
    squared = _known(kind) == "cosine"
    return F.aggregate(vector, F.lit(0.0), lambda s, e: s + (e["w"] * e["w"] if squared else e["w"]))


def array_shared(kind: str, vector: Column, other: Column) -> Column:
    """What an array of (term, w) and a map of them share, both short, of weights that are not negative."""
    w = lambda e: F.coalesce(F.try_element_at(other, e["term"]), F.lit(0.0))
    return F.aggregate(vector, F.lit(0.0), lambda s, e: s + (e["w"] * w(e) if _known(kind) == "cosine" else F.least(e["w"], w(e))))


def array_similarity(kind: str, vector: Column, other: Column, t1: Column, t2: Column) -> Column:
    """``pair_similarity`` of an array of (term, w) and a map of them, both short, of weights that are not negative."""
    return shared_similarity(kind, array_shared(kind, vector, other), t1, t2)


def packed_vector(vector: Column, width: int) -> list[Column]:
    """Fields c0, w0, c1, ... of an array of at most ``width`` (term, w), c being a hash of the term; what is missing has no weight."""
    out = []
    for i in range(width):
        e = F.get(vector, F.lit(i))
        there = e["term"].isNotNull()
        out += [F.when(there, F.xxhash64(e["term"])).otherwise(F.lit(0).cast("long")).alias(f"c{i}"), F.when(there, e["w"]).otherwise(0.0).alias(f"w{i}")]
    return out


def packed_shared(kind: str, vector: Column, other: Column, width: int) -> Column:
    """``array_shared`` of two structs of ``packed_vector`` fields, written out, which compiles where functions of arrays are interpreted."""
    shared = F.lit(0.0)
    for i in range(width):
        for j in range(width):
            w1, w2 = vector[f"w{i}"], other[f"w{j}"]
            shared += F.when(vector[f"c{i}"] == other[f"c{j}"], w1 * w2 if _known(kind) == "cosine" else F.least(w1, w2)).otherwise(0.0)
    return shared


def similarity_bound(kind: str, rest1: Column, rest2: Column, t1: Column, t2: Column) -> Column:
    """No pair is more similar whose shared terms lie in parts of these joint weights."""
    shared = F.sqrt(rest1) * F.sqrt(rest2) if _known(kind) == "cosine" else F.least(rest1, rest2)
    return shared_similarity(kind, shared, t1, t2)


def weight_bound(kind: str, floor: Column, total: Column) -> Column:
    """The joint weight that a vector's shared terms must have for a similarity of ``floor``."""
    return {"sum": floor, "jaccard": floor * total, "cosine": floor * floor * total}[_known(kind)]


def keyword_score(kind: str, w: Column, qw: Column, term_max: Column, all_qw: float, all_qw_squared: float) -> Column:
    """Aggregate over the matched keywords of a document: its score against the query's keywords alone.

    sum: weights over the term's maximum in the collection; jaccard: shared over joint weight, where a
    keyword that the document lacks counts with its query weight; cosine: over the matched weights and all query weights.
    """
    if kind == "sum":
        return F.sum(F.when(term_max > 0, qw * w / term_max).otherwise(0.0))
    if kind == "jaccard":
        return F.sum(F.least(qw, w)) / (F.lit(all_qw) + F.sum(F.greatest(qw, w) - qw))
    if kind != "cosine":
        raise ValueError(f"similarity must be one of {KINDS}, not {kind!r}")
    return F.sum(w * qw) / (F.sqrt(F.sum(w * w)) * F.sqrt(F.lit(all_qw_squared)))


def sane(score: Column) -> Column:
    """Scores that count: not null, not NaN, finite and positive."""
    return score.isNotNull() & ~F.isnan(score) & (score > 0) & (score < float("inf"))
