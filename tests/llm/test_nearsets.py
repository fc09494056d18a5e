"""The pipeline's near stage against all pairs of shingle sets."""

import random

import corpus_pipeline
from loxogram.llm import common, nearsets

SF = "/root/testdata/sf0.001"


def slow_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def slow_roots(sets, similarity=0.8):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def survivors(rows):
    roots, least = slow_roots([slow_set(t) for _, t in rows]), {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return sorted((i for unknown, i in least.values() if not unknown)), len(least)


def test_near_stage_on_edited_texts(spark):
    """Edits that leave a similarity from 0.6 to 0.98: SimHash at radius 4 missed most of those from 0.8."""
    rng, rows = random.Random(5), []
    for base in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(4):
            edited = list(words)
            for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.002, 0.05)))):
                edited[at] = "changed"
            rows.append((len(rows), " ".join(edited)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.drop_near(spark, frame, "")
    want, n = survivors(rows)
    assert sorted(r["doc_id"] for r in found.collect()) == want and 40 < n < 150


def test_near_stage_on_messy_rows(spark, docs, rows, empty):
    found = corpus_pipeline.drop_near(spark, docs, "")
    want, n = survivors([(i, t) for i, t, _ in rows])
    assert found.columns == docs.columns
    assert sorted(r["doc_id"] for r in found.collect() if r["doc_id"] is not None) == want and found.count() == n
    assert corpus_pipeline.drop_near(spark, empty, "").count() == 0


def test_near_stage_on_the_sample(spark):
    docs = common.table(spark, SF, "documents")
    want, _ = survivors([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in nearsets.drop_similar(docs).collect()) == want


def test_simhash_links_come_first(spark, monkeypatch):
    """The stage's SimHash step, which was missing: without any band its links, checked by the sets, still join near copies."""
    monkeypatch.setattr(nearsets, "alike", lambda n, m, similarity: n < 0)
    words = [f"w{i}" for i in range(900)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, " ".join(words[:100])), (4, " ".join(words[::-1]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nearsets.drop_similar(frame).collect()) == [1, 3, 4]


def test_a_large_group_of_near_copies_leaves_no_pairs(spark, monkeypatch):
    """Members that are not similar to the first head were all compared pair by pair."""
    found = []
    verified = nearsets.verified
    monkeypatch.setattr(nearsets, "verified", lambda pairs, *more: found.append(pairs.count()) or verified(pairs, *more))
    rng, words, rows = random.Random(2), [f"w{i}" for i in range(200)], []
    for i in range(300):
        edited = list(words)
        for at in rng.sample(range(200), rng.choice((1, 2, 3, 4, 5))):
            edited[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(edited)))
    kept = nearsets.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == survivors(rows)[0]
    assert sum(found) < 10 * 300 * 10


def test_stragglers_of_a_large_group_are_not_compared_in_pairs(spark, monkeypatch):
    """Near copies too far from one another, with some edits that recur, were all compared pair by pair, in each band that they share."""
    rows, rng, words = [], random.Random(3), [f"w{i}" for i in range(150)]
    for i in range(400):
        edited = list(words)
        for at in rng.sample(range(150), rng.choice((1, 3, 5, 7))):
            edited[at] = rng.choice(("common", f"x{rng.randrange(10**6)}"))
        rows.append((i, " ".join(edited)))
    found, verified = [], nearsets.verified
    monkeypatch.setattr(nearsets, "verified", lambda pairs, *more: found.append(pairs.count()) or verified(pairs, *more))
    kept = nearsets.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == survivors(rows)[0]
    assert found[-1] < 50 * 400


def test_lone_shingles_count_what_no_other_set_has(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4, 5]), (3, [2])], "sid long, items array<long>")
    assert sorted(map(tuple, nearsets.lone_shingles(sets).collect())) == [(1, 1), (2, 2)]
