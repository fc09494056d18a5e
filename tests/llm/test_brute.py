"""Queries and stages without SQL against plain code."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq

from loxogram.llm import common, langid, packing, quality, registry, simhash, winnow

SF = "/root/testdata/sf0.001"


def sample():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_languages_against_plain_code(spark):
    """Counters of trigrams, vectors multiplied letter by letter, cosines one by one."""
    profiles, vectors = langid.Profiles(), {}

    def vector(gram):
        if gram not in vectors:
            a, b, c = (profiles.item(ord(x)).astype(int) for x in gram)
            vectors[gram] = a * np.roll(b, 1) * np.roll(c, 2)
        return vectors[gram]

    def bundle(text):
        kept = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        if not kept.strip():
            return None
        padded = " " + re.sub(" +", " ", kept).strip(" ") + " "
        return sum(n * vector(g) for g, n in Counter(padded[i : i + 3] for i in range(len(padded) - 2)).items())

    rows = sample()
    bundles = {r["doc_id"]: bundle(r["text"]) for r in rows}
    prototypes = {}
    for r in rows:
        if r["lang"] is not None and not is_held_out(r["doc_id"]) and bundles[r["doc_id"]] is not None:
            prototypes[r["lang"]] = prototypes.get(r["lang"], 0) + bundles[r["doc_id"]]
    cos = lambda a, b: float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b))
    found = {r["doc_id"]: r for r in registry.QUERIES["op1_langid"](spark, SF).collect()}
    assert len(found) == len(rows)
    for r in rows:
        got, v = found[r["doc_id"]], bundles[r["doc_id"]]
        assert got["held_out"] == is_held_out(r["doc_id"])
        if v is None:
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        scores = {lang: cos(v, p) for lang, p in prototypes.items()}
        assert scores[got["lang_pred"]] >= max(scores.values()) - 1e-9
        assert abs(got["score"] - max(0.0, scores[got["lang_pred"]])) < 1e-6


def test_quality_against_its_definition(spark):
    """The weights are where the gradient of the pairs' logistic loss vanishes (the loss is convex), the cut is the quantile with the fewest errors."""
    rows = sample()
    texts = {r["doc_id"]: r["text"] for r in rows}
    labels = [r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["quality"] in (0, 1) and r["doc_id"] in texts and not is_held_out(r["doc_id"])]
    known = sorted((r["quality"], quality.features(texts[r["doc_id"]])) for r in labels)
    x, y = np.array([f for _, f in known]), np.array([q for q, _ in known])
    ranker = quality.fit(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"))
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), -6, 6)
    z = np.hstack([z, z * z / 6])
    rng = np.random.default_rng(quality.SEED)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    better, worse = rng.choice(good, quality.PAIRS), rng.choice(bad, quality.PAIRS)
    gradient = quality.RIDGE * ranker.w
    for (a, b), n in Counter(zip(better.tolist(), worse.tolist(), strict=True)).items():
        d = z[a] - z[b]
        gradient = gradient - n * d / (1 + np.exp(np.clip(d @ ranker.w, -30, 30))) / quality.PAIRS
    assert np.abs(gradient).max() < 1e-6
    raw = z @ ranker.w
    errors = lambda cut: int(((raw >= cut) != (y == 1)).sum())
    assert errors(ranker.cut) == min(errors(c) for c in [*raw, raw.max() + 1])
    found = {r["doc_id"]: r for r in registry.QUERIES["op7_quality"](spark, SF).collect()}
    assert set(found) == set(texts)
    for i, t in texts.items():
        f = np.clip((np.array(quality.features(t)) - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), -6, 6)
        above = np.hstack([f, f * f / 6]) @ ranker.w - ranker.cut
        want = 1 / (1 + np.exp(np.clip(-(2 * above / ranker.spread + np.log(0.3 / 0.7)), -30, 30)))
        got = found[i]
        assert abs(got["score"] - want) < 1e-9 and got["predicted"] == (got["score"] >= 0.3) and got["held_out"] == is_held_out(i)


def test_contamination_keeps_clashing_columns(spark, docs, rows):
    named = docs.withColumnsRenamed({"fp": "matches", "kept": "n_words", "level": "item_ids", "name": "_w", "piece": "k", "h": "hash"})
    items = spark.createDataFrame([(1, rows[0][1]), (2, "twice the same row")], "item_id long, text string")
    found = winnow.contamination(named, items)
    assert found.columns == [c for c in named.columns if c not in ("n_words", "item_ids")] + ["n_words", "n_hit", "_spans", "item_ids"]
    got = Counter((r["doc_id"], r["text"], r["matches"], r["_w"], r["hash"], r["n_hit"] > 0) for r in found.collect())
    assert sum(got.values()) == len(rows) and {k[2:5] for k in got} == {(1, "n", "h")}
    assert {k[0] for k in got if k[-1]} == {0, 70}
    assert winnow.drop_contaminated(named, items).columns == named.columns


def test_cells_of_dealt_groups_have_no_limit():
    """A cell above the limit is solved as it is."""
    import pandas as pd

    fps = [1 << i for i in range(40)]
    rows = pd.DataFrame({"k": 1, "v": 2, "lo": 0, "hi": 0, "fp": fps})
    out = pd.concat(simhash._verify(2, 8, 4)(iter([rows.iloc[:15], rows.iloc[15:]])))
    assert len(out) == 39 and (out["kind"] == 0).all()


def test_packed_sequences_hold_the_ids(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = packing.WordCache(path).tokenizer
    want = Counter()
    for _, t, _ in rows:
        ids = [*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 1]
        want.update(tuple(ids[k : k + 128]) for k in range(0, len(ids), 128))
    found = packing.packed_sequences(docs, path, 128, group_pieces=40).collect()
    got, places = [np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() for r in found], packing.pack(docs, path, 128, group_pieces=40).collect()
    assert [len(g) for g in got] == [r["length"] for r in found] and all(len(g) <= 128 for g in got)
    assert sum(map(len, got)) == sum(len(k) * n for k, n in want.items()) and len(found) == len({r["sequence_id"] for r in places})
    spans = {}
    for r in places:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    by_id, cut = {r["sequence_id"]: g for r, g in zip(found, got, strict=True)}, Counter()
    for s, parts in spans.items():
        cut.update(tuple(by_id[s][o : o + n]) for o, n in parts)
    assert cut == want


def test_pipeline_on_no_rows_and_other_columns(spark, docs, rows):
    import corpus_pipeline

    for frame in (docs.limit(0), docs):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.materialize(stage(spark, now, SF), f"test-{name}")
            assert now.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
        left = Counter(r["doc_id"] for r in now.collect())
        assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert set(left) == {r["doc_id"] for r in packed.collect()}
    texts = [r["text"] or "" for r in now.collect()]
    assert 10 < len(texts) == len(set(texts)) < len(rows)


def test_very_long_texts(spark):
    import corpus_pipeline

    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(150_000))
    frame = spark.createDataFrame([(1, long), (2, long), (3, long + " end"), (4, None), (5, "x" * 500_000)], "doc_id long, text string")
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(frame).collect()}
    assert groups[1] == groups[2] == groups[3] == 1
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_exact(spark, frame, SF).collect()) == [2, 3, 4, 5]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near(spark, frame, SF).collect()) == [1, 4, 5]
    assert corpus_pipeline.drop_benchmark(spark, frame, SF).count() == 5


def test_scratch_is_cleared(spark, docs):
    import os

    common.materialize(docs.select("doc_id"), "gone")
    assert any(n.startswith("gone-") for n in os.listdir(common.scratch_dir(spark)))
    common.clear_scratch(spark)
    assert not os.path.exists(common.scratch_dir(spark))


def test_benchmarks_beyond_the_byte_bound(spark, docs, rows, monkeypatch):
    items = spark.createDataFrame([(1, rows[0][1]), (2, "twice the same row")], "item_id long, text string")
    count = lambda: Counter((r["doc_id"], r["n_hit"]) for r in winnow.contamination(docs, items).collect())
    small = count()
    monkeypatch.setattr(winnow, "BROADCAST_BYTES", 0)
    assert count() == small
