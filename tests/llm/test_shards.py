"""The external shuffle: laws, whole records, independence of the layout, hot rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loxogram.llm import registry, shards

SF = "/root/testdata/sf0.001"


def laws(found, n):
    """The rows of (shard, slot) are gapless and the shards' counts at most one apart."""
    slots = defaultdict(list)
    for shard, slot in found:
        slots[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(n)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(n))


@pytest.mark.parametrize(("n", "bucket"), [(24, 300), (5, 1 << 20)])
def test_whole_records(docs, rows, n, bucket):
    found = shards.shuffle_shards(docs, n, bucket).collect()
    assert Counter((r["doc_id"], r["text"], r["kept"], r["spans"]) for r in found) == Counter((i, t, "x", "s") for i, t, _ in rows)
    laws([(r["_shard"], r["_slot"]) for r in found], n)


def test_order_is_shuffled_and_follows_the_seed_alone(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    many = many.unionByName(many.where("doc_id < 40")).unionByName(many.where("doc_id = 7"))
    place = lambda df, seed: sorted((r["_shard"], r["_slot"], r["doc_id"]) for r in shards.shuffle_shards(df, 4, 4096, seed).collect())
    one = place(many.repartition(3), 1)
    assert one == place(many.repartition(5, "text").orderBy(F.desc("doc_id")), 1) != place(many, 2)
    order = [d for *_, d in one]
    assert len(order) == 3041 and abs(np.corrcoef(order, range(3041))[0, 1]) < 0.08
    near = np.abs(np.diff(order)) == 1  # neighbours stay neighbours about 2 times in 3000
    assert near.sum() < 15


def test_hot_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(shards, "COPIES", 16)
    hot = spark.range(900).select(F.when(F.col("id") < 600, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit(None).cast("int").alias("n"))
    found = shards.shuffle_shards(hot, 6, 256).collect()
    assert Counter(r["doc_id"] for r in found) == Counter({-1: 600} | {i: 1 for i in range(600, 900)})
    laws([(r["_shard"], r["_slot"]) for r in found], 6)
    assert all(60 <= sum(r["doc_id"] == -1 and r["_shard"] == k for r in found) <= 140 for k in range(6))


def test_nulls_differ_by_column(spark):
    pair = spark.createDataFrame([(None, "a"), ("a", None)], "u string, v string")
    a, b = pair.select(*shards.row_key(pair, 1)).collect()
    assert a != b


def test_written_shards(spark, docs, rows, empty, tmp_path):
    shards.write_shards(docs, str(tmp_path / "out"), shards=3, bucket_bytes=2000)
    back = shards.read_shards(spark, str(tmp_path / "out"), docs)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t) for i, t, _ in rows)
    for k in range(3):
        for part in (tmp_path / "out" / f"_shard={k}").glob("*.parquet"):
            slots = pq.read_table(part)["_slot"].to_pylist()
            assert slots == sorted(slots)
    assert shards.shuffle_shards(empty).count() == 0
    shards.write_shards(empty, str(tmp_path / "none"))
    assert shards.read_shards(spark, str(tmp_path / "none"), docs).count() == 0
    long = spark.createDataFrame([(1, "é" * 2_000_000), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in shards.shuffle_shards(long, 2, 1000).collect()) == [(1, 2_000_000), (2, 0)]


def test_query(spark):
    found = registry.QUERIES["op4_shards"](spark, SF)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = found.collect()
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    laws([(r["shard"], r["slot"]) for r in rows], 24)
    again = registry.QUERIES["op4_shards"](spark, SF)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))
