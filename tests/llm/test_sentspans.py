"""Sentence spans and shared passages against brute force over words."""

import random
import re
from collections import Counter, defaultdict

import pytest

from loxogram.llm import sentspans
from loxogram.llm.sentspans import Spans

ALONE = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in sentspans.UNSPACED) + "]"
WORD = re.compile(rf"{ALONE}|(?:(?!{ALONE})\S)+")


def slow_words(text):
    """(word, its sentence) and where each word starts."""
    out, places, sentence = [], [], 0
    found = list(WORD.finditer(text or ""))
    for m, after in zip(found, [*found, None][1:], strict=True):
        out.append((m[0], sentence))
        places.append(m.start())
        between = text[m.end() : after.start() if after else len(text)]
        sentence += m[0][-1] in sentspans.ENDS or "\n" in between
    return out, places


def slow_cut(rows, s: Spans):
    """What each row keeps, how many sentences it has and how many lose words; rows are (id, text), ids distinct or null."""
    texts = [slow_words(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    runs, windows = defaultdict(list), defaultdict(list)
    for k in order:
        words = texts[k][0]
        total = words[-1][1] + 1 if words else 0
        firsts = [next(i for i, w in enumerate(words) if w[1] == j) for j in range(total)] + [len(words)]
        for j in range(total):
            stop = next((e for e in range(j + s.span, total + 1) if firsts[e] - firsts[j] >= s.min_words), None)
            if stop:
                runs[tuple(w for w, _ in words[firsts[j] : firsts[stop]])].append((k, firsts[j], firsts[stop]))
        for i in range(len(words) - s.window + 1):
            windows[tuple(w for w, _ in words[i : i + s.window])].append((k, i, i + s.window))
    gone = defaultdict(set)
    for places in runs.values():
        for k, a, b in places[1:]:
            gone[k] |= set(range(a, b))
    for places in windows.values():
        for k, a, b in places[1:]:
            if k != places[0][0]:
                gone[k] |= set(range(a, b))
    out = []
    for k, (_, t) in enumerate(rows):
        words, places = texts[k]
        bounds = [0, *places[1:], len(t or "")] if words else []
        kept = "".join(t[bounds[i] : bounds[i + 1]] for i in range(len(words)) if i not in gone[k]) if gone[k] else t
        out.append((kept, words[-1][1] + 1 if words else 0, len({words[i][1] for i in gone[k]})))
    return out


def cut(spark, rows, s=None):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return Counter((r["doc_id"], r["text"], r["n_sentences"], r["n_removed"]) for r in sentspans.drop_repeated_runs(frame, s).collect())


def test_words_against_pattern():
    rng = random.Random(5)
    letters = "ab.!?\n \t漢字。！กข𠀀é "
    texts = [None, "", " \n", ".", "x"] + ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(300)]
    words = sentspans.words_of(texts)
    names = {}
    for k, t in enumerate(texts):
        own = slice(words.cuts[k], words.cuts[k + 1])
        want, places = slow_words(t)
        assert words.start[own].tolist() == places, repr(t)
        for h, (w, _) in zip(words.hash[own].tolist(), want, strict=True):
            assert names.setdefault(w, h) == h
        ends = [a[1] != b[1] for a, b in zip(want, want[1:], strict=False)]
        assert words.ends[own].tolist()[:-1] == ends
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("s", [Spans(2, 5, 9, 3), Spans(3, 8, 12, 4), Spans(1, 1, 6, 2)])
def test_against_brute_force(spark, s):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["a.", "b!", "c?\n", "d.", "漢字。"]
    pool = [rng.choices(vocabulary, k=rng.randrange(4, 25)) for _ in range(8)]
    texts = [None, "", " ", "\n.\n", "Yes. No. Yes."]
    texts += [" ".join(w for _ in range(4) for w in (rng.choice(pool) if rng.random() < 0.5 else rng.choices(vocabulary, k=9))) for _ in range(40)]
    texts += [" " + texts[9], texts[10], texts[10], texts[11].replace(" ", "  ")]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows.append((None, texts[12]))
    want = Counter((i, *w) for (i, _), w in zip(rows, slow_cut(rows, s), strict=True))
    assert cut(spark, rows, s) == want
    assert sum(w[3] > 0 for w in want) >= 10


def test_production_parameters(spark):
    rng = random.Random(6)
    some = lambda n: " ".join(f"w{rng.randrange(99999)}" for _ in range(n))
    passage, short, long = some(53), some(50), " ".join(some(9) + "." for _ in range(6))
    lines = "".join(f"word{rng.randrange(9999)} {rng.randrange(99)}\n" for _ in range(40))
    chars = "".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(9)) + "。" for _ in range(12))
    texts = [some(20) + " " + passage + " " + some(5), f"{some(9)} {passage} {some(7)}. Then more.", some(4) + " " + short, some(3) + " " + short]
    texts += [f"One. {long} Two.", f"Three. {long} Four.", lines, lines, chars, "Before. " + chars, "Yes. No. Yes.", "Yes. No. Yes.", "ha " * 300, some(40_000), "x" * 200_000]
    rows = list(enumerate(texts))
    found = cut(spark, rows)
    assert found == Counter((i, *w) for (i, _), w in zip(rows, slow_cut(rows, Spans()), strict=True))
    assert {i for i, _, _, n in found if n} == {1, 5, 7, 9}


def test_other_columns_repeated_rows_and_no_rows(spark):
    text = " ".join(f"w{i}." for i in range(60))
    rows = [(1, text, 5, "x", 0), (1, text, 5, "x", 0), (2, text, None, None, 1), (None, None, 1, "n", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, h1 string, pos int")
    out = sentspans.drop_repeated_runs(frame)
    assert out.columns == ["doc_id", "text", "h1", "pos", "n_sentences", "n_removed"]
    found = sorted(out.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [(r["text"], r["n_removed"]) for r in found] == [(text, 0), (text, 0), ("", 60), (None, 0)]
    assert sentspans.drop_repeated_runs(frame.limit(0)).count() == 0
