"""A small messy table of documents that the operators' tests share."""

import random

import pytest

EXTRA = "fp long, kept string, level int, name string, piece int, shard int, score double, spans string, rid string, h string, n_removed long, value int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def messy_rows(seed=9):
    """(doc_id, text, lang): copies, near copies, shared passages, null and empty texts and ids, repeated rows, one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 12))).capitalize() + rng.choice([". ", "! ", ".\n"])
    body = lambda n: "".join(sentence() for _ in range(n))
    passage = body(12)
    rows = [(i, body(rng.randrange(3, 15)), "aa") for i in range(12)]
    rows += [(20 + i, body(4) + passage + body(3), "aa") for i in range(5)]
    copy = body(8)
    rows += [(40 + i, copy, "bb") for i in range(4)]
    near = body(40).split(" ")
    for i in range(4):
        words = list(near)
        words[7 * i + 3] = "changed"
        rows.append((50 + i, " ".join(words), "bb"))
    rows += [(60, None, None), (61, "", "aa"), (62, " \t\n", None), (63, "a", "bb"), (64, "one two three", "aa"), (65, "!!! ??? 123", "aa"), (66, None, "aa")]
    rows += [(None, body(5), "aa"), (None, copy, "bb"), (None, None, None)]
    rows += [(70, "twice the same row here. and more words follow it. to make three sentences in all.", "aa")] * 2
    rows += [(71, "same id, first text", "aa"), (71, "same id, other text", "aa")]
    rows += [(80, body(2500), "aa"), (81, "ha " * 3000, "bb"), (82, "tail of ABC Abc aBC É é" * 3, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, lang, "src0", len(t or ""), 1, "x", 2, "n", 3, 4, 0.5, "s", "r", "h", 9, 5) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session", autouse=True)
def shared(tmp_path_factory):
    from loxogram.llm import common

    common.LOCAL_SCRATCH = str(tmp_path_factory.mktemp("scratch"))
