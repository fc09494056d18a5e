"""Exact, near and substring duplicates against brute force on the messy table."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loxogram.llm import exact, lpf, simhash

# --- exact ---


@pytest.mark.parametrize("block", [16, 4096])
def test_exact_groups(docs, rows, block):
    found = exact.exact_groups(docs, block).drop("rid").collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert len(found) == len(rows)
    want = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, top, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_exact_drop(docs, rows, empty):
    kept = exact.drop_copies(docs, 64)
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t or "" for _, t, _ in rows})
    assert exact.exact_groups(empty).count() == 0


# --- near ---


def slow_print(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, radius):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_simhash(docs, rows, empty):
    found = simhash.simhash_components(docs).collect()
    prints = [slow_print(t) for _, t, _ in rows]
    root = slow_components(prints, 4)
    least = {}
    for (i, _, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = Counter((i, p, least.get(root[p])) for (i, _, _), p in zip(rows, prints, strict=True))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize(("radius", "group"), [(4, 20_000), (4, 6), (2, 20_000), (0, 20_000)])
def test_links_of_clustered_fingerprints(spark, radius, group):
    rng = random.Random(radius + group)
    values = {rng.getrandbits(64) for _ in range(300)}
    for c in list(values)[:12]:  # chains and clouds around some of them
        for _ in range(30):
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
            values.add(c)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(frame, radius, group)).collect()}
    want = slow_components(values, radius)
    together = lambda root: {frozenset(g) for g in _groups(root).values() if len(g) > 1}
    assert together({v: found.get(v, v) for v in values}) == together(want)


def _groups(root):
    out = defaultdict(set)
    for v, r in root.items():
        out[r].add(v)
    return out


def test_pigeonhole_allocation():
    gram = np.full((64, 64), 25.0) + np.eye(64) * 25
    for radius in (0, 1, 4, 7):
        parts, thresholds = simhash.plan_probes(gram, 100, radius)
        assert sum(thresholds) == radius - len(parts) + 1 and sorted(b for p in parts for b in p) == list(range(64))


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and found[101] == 100


# --- suffix order ---


def slow_marks(texts, length, keep_first=False):
    seen = defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((k, i))
    marks = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        for k, i in places[1 if keep_first else 0 :] if len(places) > 1 else ():
            marks[k][i : i + length] = b"\1" * length
    return marks


def slow_shared(texts, length):
    """Bytes of strings of that length that another text has."""
    seen = defaultdict(set)
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].add(k)
    marks = [bytearray(len(t)) for t in texts]
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                marks[k][i : i + length] = b"\1" * length
    return marks


@pytest.mark.parametrize("group", [60_000, 1])
def test_repeats_against_brute_force(docs, rows, empty, group):
    distinct = list(dict.fromkeys((i, t) for i, t, _ in rows))  # rows equal in id and text are one document of many copies
    found = {(r["doc_id"], r["kept"]): r for r in lpf.cut_documents(docs, 40, step=1, gram=8, keep="none", chunk=50, group=group).collect()}
    marks = slow_marks([(t or "").encode() for _, t, _ in rows], 40)
    shared = dict(zip(distinct, slow_shared([(t or "").encode() for _, t in distinct], 40), strict=True))
    want = set()
    for (i, t, _), m in zip(rows, marks, strict=True):
        if any(m) or any(shared[i, t]):
            kept = bytes(b for b, x in zip((t or "").encode(), m, strict=True) if not x)
            want.add((i, kept))
            assert (i, kept) in found, (i, t[:50])
            r = found[i, kept]
            assert r["n_removed"] == sum(m) and r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
            assert r["n_spans"] == len(re.findall(b"\1+", bytes(m))) and r["n_shared"] == sum(shared[i, t])
    assert set(found) == want and len(want) >= 10
    if group == 1:
        assert lpf.cut_documents(empty, 40, gram=8).count() == 0


@pytest.mark.parametrize(("floor", "group"), [(50, 60_000), (30, 1)])
def test_keeping_the_first(spark, floor, group):
    rng = random.Random(2)
    words = [rng.randbytes(3).hex() for _ in range(60)]
    passage = " ".join(rng.choices(words, k=30))
    texts = [" ".join(rng.choices(words, k=20)) + (passage if i % 2 else "") + " ".join(rng.choices(words, k=9)) for i in range(9)] + ["ab" * 100]
    texts += [texts[4], texts[4], texts[0][:49], texts[3][20:90]]
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, spots string, `a.b` int")
    found = lpf.drop_repeats(frame, length=50, floor=floor, gram=16, keep="first", group=group)
    assert found.columns == frame.columns
    kept = {r["doc_id"]: r["text"] for r in found.collect()}
    marks = slow_marks([t.encode() for t in texts], 50, keep_first=True)
    assert kept == {i: "".join(c for c, m in zip(t, marks[i], strict=True) if not m) for i, t in enumerate(texts)}
    assert passage in kept[1] and passage not in kept[3] and kept[10] == kept[11] == ""


@pytest.mark.parametrize("group", [60_000, 1])
def test_shorter_passages_are_counted(spark, group):
    """Passages under the length stay and are counted, with no more bytes than other texts have; most of them are found."""
    rng = random.Random(12)
    some = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [some(rng.randrange(84, 98)) for _ in range(30)]
    texts = [some(150) + passages[i % 30] + some(130) if i < 150 else some(300) for i in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in lpf.cut_documents(frame, 100, floor=64, step=4, gram=8, keep="none", group=group).collect()}
    shared = slow_shared([t.encode() for t in texts], 64)
    assert set(found) <= set(range(150)) and all(r["n_removed"] == 0 and 0 < r["n_shared"] <= sum(shared[i]) for i, r in found.items())
    assert len(found) >= 140


def test_previous_factors():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        linked, rank = rng.random(n - 1) < 0.6, rng.integers(0, 6, n)
        run = np.concatenate([[0], np.cumsum(~linked)])
        want = [any(run[j] == run[i] and rank[j] < rank[i] for j in range(n)) for i in range(n)]
        assert lpf.previous_factors(linked, rank).tolist() == want


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(lpf, "PIECE", 1000)
    data = random.Random(1).randbytes(7000)
    who, h, one, two, p, first, last = lpf.anchors([b"", data, data[:50]], 100, 16)
    assert set(who) == {1} and first[0] == 0 and last[-1] == 6900 and (first[1:] == last[:-1] + 1).all() and len(h) == len(p)
    whole, _ = lpf.owners(np.frombuffer(data, dtype=np.uint8), 100, 16)
    assert (np.repeat(p, last - first + 1) == whole).all()
    part = data[first[2] : last[2] + 100]
    twice = lpf.anchors([part, b"x" + part], 100, 16)
    assert len({*one, *two}) == 2 * len(one) and one[2] in twice[2] and two[2] in twice[3]


def test_invalid_choice(docs):
    with pytest.raises(KeyError):
        lpf.repeats(docs.select("doc_id", F.lit(0).alias("th")), 40, 40, 4, 8, "all")


@pytest.mark.parametrize("keep", ["none", "first"])
def test_large_groups_are_not_joined_back(docs, keep):
    """Every window of a common passage was a row of a join, in each document that has it."""
    found = lpf.candidates(docs.select("doc_id", "text"), 40, 8, keep, 1)
    marks = lpf.repeats(found, 40, 40, 1, 8, keep)
    assert "Join" not in marks._jdf.queryExecution().toString()
    assert {r["kind"] for r in marks.select("kind").distinct().collect()} >= {2, 3}
