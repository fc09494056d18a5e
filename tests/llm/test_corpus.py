"""Language, quality, sharding, archives, contamination, packing, and the pipeline."""

import cProfile
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loxogram.llm import common, langid, packing, quality, registry, warc, winnow

SF = "/root/testdata/sf0.001"

# --- language ---


def test_language_profiles(spark, docs, rows, empty):
    langs, prototypes = langid.learn(docs.select("doc_id", "text", "lang"))
    assert langs == ["aa", "bb"] and np.allclose(np.linalg.norm(prototypes, axis=1), 1)
    found = docs.select("doc_id", "text", langid.language_column(F.col("text"), langs, prototypes).alias("p")).select("doc_id", "text", "p.*").collect()
    assert len(found) == len(rows)
    for r in found:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    none = langid.learn(empty.select("doc_id", "text", "lang"))
    assert none[0] == []
    assert {r["p"]["lang_pred"] for r in docs.select(langid.language_column(F.col("text"), *none).alias("p")).collect()} == {"und"}


def test_grams_and_binding():
    p = langid.Profiles(64, 3)
    grams, counts = p.grams("Aba, ABA")
    shown = {"".join(chr(int(g) >> 21 * k & (1 << 21) - 1) for k in (2, 1, 0)): int(c) for g, c in zip(grams, counts, strict=True)}
    assert shown == {" ab": 2, "aba": 2, "ba ": 2, "a a": 1}
    code = grams[:1]
    letters = [int(code[0]) >> 21 * k & (1 << 21) - 1 for k in (2, 1, 0)]
    assert (p.bind(code)[0] == p.item(letters[0]) * np.roll(p.item(letters[1]), 1) * np.roll(p.item(letters[2]), 2)).all()
    p.LIMIT = 3  # a full cache starts anew
    assert (p.lookup(grams) == p.bind(grams)).all() and (p.lookup(grams) == p.bind(grams)).all()
    assert np.allclose(p.bundle(["Aba, ABA"])[0], (p.bind(grams) * counts[:, None]).sum(axis=0))


def test_language_held_out(spark):
    found = registry.QUERIES["op1_langid"](spark, SF)
    truth = common.table(spark, SF, "documents").select("doc_id", "lang")
    held = found.join(truth, "doc_id").where("held_out and lang is not null").collect()
    assert held and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    want = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r["doc_id"] for r in held} <= want


# --- quality ---


def test_quality_held_out(spark):
    found = registry.QUERIES["op7_quality"](spark, SF)
    rows = found.join(common.table(spark, SF, "labels"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_on_messy_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(1, None, None), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    ranker = quality.fit(docs, labels)
    scored = docs.select(quality.score_column(F.col("text"), ranker).alias("s")).collect()
    assert len(scored) == len(rows) and all(0 <= r["s"] <= 1 for r in scored)
    kept = quality.keep_good(docs, ranker)
    assert kept.columns == docs.columns and kept.count() == sum(r["s"] >= 0.3 for r in scored)
    assert not quality.fit(empty, labels).fitted and not quality.fit(docs, labels.limit(0)).fitted
    assert docs.select(quality.score_column(F.col("text"), quality.fit(empty, labels)).alias("s")).where("s = 0.5").count() == len(rows)


def test_ranker_orders_by_preference():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.2 * rng.normal(size=400) > -0.8).astype(int)
    r = quality.Ranker(x, y, pairs=5000)
    s = r.score(x)
    assert s[y == 1].mean() > s[y == 0].mean() + 0.3 and np.mean((s >= quality.CUT) == y) > 0.9
    assert 0 < r.quantile < 1


# --- archives ---

PAGES = [(1, "http://a/é x\r\n", "x" * 1200), (2, None, "x" * 1200), (3, "http://b", "x" * 999), (4, "http://b", "x" * 999), (5, "", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\né" * 200), (None, "n", "x" * 1200)]


@pytest.mark.parametrize("level", [0, 1])
def test_archive_round_trip(spark, tmp_path, level):
    pages = spark.createDataFrame([(*p, 1) for p in [*PAGES, PAGES[6]]], "page_id long, url string, html string, payload int").repartition(2)
    path = str(tmp_path / "w")
    warc.register(spark)
    if level:
        warc.archive(pages, path)
        found = warc.read_pages(spark, path).collect()
        want = Counter()
        for i, _, t in [*PAGES, PAGES[6]]:
            b = (t or "").encode()
            again = t == "x" * 1200 and i != 2
            want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 2 if again else None] += 1
        assert Counter(map(tuple, found)) == want
        uris = {r["target_uri"] for r in spark.read.format("warc").option("payload", "false").load(path).collect()}
        assert uris == {"http://a/é x%0D%0A", None, "http://b", "u", "n", ""}
    else:
        rows = [("response", f"r{k}", f"http://{k}", None, None, hashlib.sha1(b"%d" % k).hexdigest(), 1, b"%d" % k) for k in range(9)]
        frame = spark.createDataFrame(rows, warc.SCHEMA).coalesce(1)
        frame.write.format("warc").option("level", 0).option("max_bytes", 1000).mode("append").save(path)
        back = spark.read.format("warc").load(path)
        assert Counter((*r[:7], bytes(r[7])) for r in back.collect()) == Counter((*r[:7], r[7]) for r in rows)
        assert len(list((tmp_path / "w").glob("*.warc"))) > 1
        assert [r["record_id"] for r in back.where("target_uri = 'http://4'").collect()] == ["r4"]
        assert back.where("payload_length > 1").count() == 0 and back.where("record_id in ('r1', 'r2')").count() == 2


def test_pushed_filters_leave_the_rest():
    from pyspark.sql.datasource import EqualTo, IsNull

    reader = warc.WarcReader({"path": "/x"})
    known, other = EqualTo(("warc_type",), "response"), IsNull(("payload",))
    assert list(reader.pushFilters([known, other])) == [other] and reader.filters == [known]


def test_broken_archives(tmp_path):
    import io

    good = warc.encode("response", "r", "u", None, None, "00" * 20, 3, b"abc")
    assert [r[-1] for r in warc.read_records(io.BytesIO(good), [], True, True)] == [b"abc"]
    for bad in (b"HTTP/1.1", good[:30], good[:-6]):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad), [], True, False))


def test_empty_archive(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive(pages, str(tmp_path / "none"))
    assert warc.read_pages(spark, str(tmp_path / "none")).count() == 0


# --- contamination ---

ITEMS = [(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "W5, w6; W7 w8 w9 w10 w11 w12 w13 w14"), (3, "short one"), (4, "x"), (5, None), (6, "..."), (7, "short one"), (10, "ha " * 30), (11, "É t é 9 " * 4)]


def slow_hits(texts, items, span):
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = word(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    for t in texts:
        w, hit, ids = word(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        yield len(w), len(hit), tuple(sorted(ids))


@pytest.mark.parametrize(("span", "gram"), [(10, 5), (4, 2), (3, 3)])
def test_contamination(spark, docs, rows, span, gram):
    texts = [t for _, t, _ in rows] + ["zz w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 end", "a W5 w6 w7 w8-w9 w10 w11 w12 w13 w14", "short", "a short one x", "ha " * 9, "ha " * 10, "w5 w6 w7 w8 w9 w10 w11 w12 w13", "é T é 9 É t é 9 é t é", "w0 w1 w2 w3 w4 w5 w6 w7 w8 zz w9 w10"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], tuple(sorted(r["item_ids"]))) for r in winnow.contamination(frame, items, span, gram).collect()}
    assert [found[k] for k in range(len(texts))] == list(slow_hits(texts, ITEMS, span))


def test_contamination_drops_rows(spark, docs, rows, empty, monkeypatch):
    items = spark.createDataFrame([(1, rows[0][1]), (2, "twice the same row")], "item_id long, text string")
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)  # the way beyond the bound
    kept = winnow.drop_contaminated(docs, items)
    clean = [t for t, (_, hit, _) in zip([t for _, t, _ in rows], slow_hits([t for _, t, _ in rows], [(1, rows[0][1]), (2, "twice the same row")], 10), strict=True) if not hit]
    assert kept.columns == docs.columns and sorted(r["text"] or "" for r in kept.collect()) == sorted(t or "" for t in clean)
    assert winnow.drop_contaminated(empty, items).count() == 0
    assert winnow.drop_contaminated(docs, items.limit(0)).count() == len(rows)


# --- packing ---


def test_word_cache_equals_the_tokenizer(rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    cache = packing.WordCache(path)
    odd = ["a\x1cb c", "x<|endoftext|>y", "", None, "İstanbul ǅ ẞ straße'S it's don't 12ab 3½ ² ①", "é é ́x a b a\u0085b", "日本語 テキスト ü", "\x00\x01 a\x7fb", "'s't 'RE x'LL !!''s", "​ zero‍width 👩‍👧 flag", "a" * 3000]
    texts = odd + [t for _, t, _ in rows]
    for _ in range(2):
        ids, cuts = cache.batch(pa.array(texts, pa.string()))
        for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True):
            assert ids[a:b].tobytes() == np.array(cache.tokenizer.encode(t, add_special_tokens=False).ids if t else [], dtype="<u4").tobytes(), t and t[:40]


def many_words(n, seed=5):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n)})


def test_words_are_looked_up_as_arrays():
    """No call for each word, whether it is new or known."""
    cache, words = packing.WordCache(public_tokenizers.path("word_bpe_49k.json")), many_words(20_000)
    cache.batch(pa.array(["warm up"]))
    for _ in range(2):
        profile = cProfile.Profile()
        profile.runcall(cache.batch, pa.array([" ".join(words)]))
        assert sum(x.callcount for x in profile.getstats()) < len(words) / 10


def test_known_words_take_few_bytes():
    cache, words = packing.WordCache(public_tokenizers.path("word_bpe_49k.json")), many_words(50_000)
    text = pa.array([" ".join(words)])
    cache.batch(pa.array(["warm up"]))
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    cache.batch(text)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 150 * len(words)


def test_encoding_takes_little_memory():
    """Six texts of 1 MB in one batch, all of different words: what Python and NumPy hold at most."""
    path, words = public_tokenizers.path("word_bpe_49k.json"), many_words(600_000)
    batch = pa.record_batch([pa.array(range(6)), pa.array([" ".join(words[k::6]) for k in range(6)])], names=["doc_id", "text"])
    del words
    run = packing._pieces(path, 4096, 1)
    list(run(iter([batch.slice(0, 0)])))
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter([batch]))) > 6
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    packing._encoders.clear()
    assert peak < 130e6, peak


def test_cache_beyond_its_limit(monkeypatch):
    """A cache of 40 words gives the same ids, stays at 40, and is right for no, null and blank texts as for words without plain ones."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    monkeypatch.setattr(packing.WordCache, "LIMIT", 40)
    cache = packing.WordCache(path)
    word = lambda: "".join(rng.choice("abcdefgxyzABZ'0123!?.,-éÉßÿÀ×日\u0301µ\x85") for _ in range(rng.choice([1, 2, 3, 5, 60])))
    drawn = [[" ".join(word() for _ in range(rng.randrange(30))) for _ in range(5)] for _ in range(60)]
    for texts in [[], [None], ["", " \n"], ["日本"], ["a\x1cb"], ["''", "é"], *drawn]:
        ids, cuts = cache.batch(pa.array(texts, pa.string()))
        assert len(cuts) == len(texts) + 1
        for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True):
            assert ids[a:b].tobytes() == (cache.direct(t) if t else b""), t
        assert max(len(cache.words.keys), len(cache.parts.keys)) <= 40


def check_packing(found, wanted, sequence):
    """wanted: a Counter of (doc_id, piece, start, length, crc)."""
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= sequence
    return len(bins)


@pytest.mark.parametrize(("sequence", "group"), [(4096, 50_000), (64, 20)])
def test_packing(docs, rows, empty, sequence, group):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, wanted = packing.WordCache(path).tokenizer, Counter()
    for i, t, _ in rows:
        ids = [*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 1]
        for k in range(0, len(ids), sequence):
            part = np.array(ids[k : k + sequence], dtype="<u4")
            wanted[i, k // sequence, k, len(part), zlib.crc32(part.tobytes())] += 1
    found = packing.pack(docs, path, sequence, group_pieces=group).collect()
    bins, tokens = check_packing(found, wanted, sequence), sum(n * key[3] for key, n in wanted.items())
    assert bins <= -(-tokens // sequence) * 1.1 + 3
    if group == 20:
        assert packing.pack(empty, path).count() == 0


def test_sum_of_squares_rule():
    rng = random.Random(4)
    lengths = np.array(sorted((rng.randrange(1, 33) for _ in range(300)), reverse=True))
    bins, offsets = packing.sum_of_squares(lengths, 32)
    gaps = {}
    for b, o, s in zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True):
        options = {}
        squares = lambda g: sum(n * n for k, n in Counter(g.values()).items() if k)
        for x in {**{g: k for k, g in gaps.items() if g >= s}}.values():
            options[x] = squares({**gaps, x: gaps[x] - s})
        fresh = squares({**gaps, -1: 32 - s})
        chosen = squares({**gaps, b: (gaps[b] if b in gaps else 32) - s})
        assert chosen == min([fresh, *options.values()])
        assert o == 32 - gaps.get(b, 32)
        gaps[b] = gaps.get(b, 32) - s


# --- the pipeline ---


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    before, kept = None, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert before is None or set(kept[name]) <= set(before)
        before = kept[name]
    texts = kept["exact"]
    assert len(set(texts.values())) == len(texts) and set(texts.values()) == set(kept["quality"].values())
    hit = dict(zip(kept["near"], slow_hits(kept["near"].values(), [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()], 10), strict=True))
    assert set(kept["decontaminate"]) == {i for i, (_, n, _) in hit.items() if not n}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(kept["decontaminate"])
