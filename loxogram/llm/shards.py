"""Sharding by a two-pass external shuffle, with DataFrame functions alone.

Pass one scatters whole records by a seeded hash of their row into as many buckets as it takes for one to
hold about ``bucket_bytes``; the shuffle files are the buckets. Pass two sorts each bucket (which makes its order that
of the records, not that of their arrival), shuffles it by Fisher-Yates and writes its records to the shards:
bucket after bucket, a random permutation of all records, cut into shards whose record counts differ by
one at most (the law ``rows``). Fisher-Yates runs on the numbers 0 to n - 1 of a bucket's n records
(Spark's ``shuffle`` with a seed), and the records follow their numbers, so no bucket is one value.

The result depends on the records, the seed and the number of buckets alone, not on files, partitions or the order
of arrival: buckets are dealt to a number of partitions that follows from theirs (about eight to one, more beyond 32,768 partitions),
where the generator starts from seed and partition. Rows that are equal in all columns are told apart by numbers: one of them
goes with its count to as many copies, in blocks, so that they spread like any others.

Sizes and hashes of the records (24 bytes a row) are written once; bucket sizes become offsets in two
steps, each of a bounded number of rows.

Defined cases: a null text has no bytes (size 8, crc32 0); repeated rows are records of their own; an
empty table gives no rows; a shard may be empty when there are fewer records than shards; a record above
``bucket_bytes`` makes its bucket larger and is never cut; all columns are kept, names that start with ``_sh_`` are
the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialize, scratch_path, table

SHARDS, BUCKET_BYTES, SEED = 24, 4 << 20, 20240229
#: Buckets that a task works off, so that tasks are about as large, and the most tasks.
TOGETHER, TASKS = 8, 32_768
#: Copies of one row that a task makes at once, and buckets that are added up in one group.
COPIES, BLOCK = 4096, 4096


KEY = ["_sh_key", "_sh_more"]


def row_key(records: DataFrame, seed: int) -> list[Column]:
    """A seeded 128-bit hash of a whole row. A null counts by its column, so that it does not vanish from the hash."""
    parts = [x for c in records.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(F.lit(seed + i), *parts).alias(k) for i, k in enumerate(KEY)]


def row_bytes(records: DataFrame) -> Column:
    """About what a row takes: the bytes of its strings and binaries, and eight for any other column."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in records.dtypes]
    return sum(sizes, F.lit(0)).cast("long")


def each_copy(counted: DataFrame) -> DataFrame:
    """A row with _sh_copy for each of _sh_n copies, made by blocks that are dealt to different tasks."""
    blocks = counted.withColumn("_sh_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_sh_n - 1) div {COPIES}"))))
    first = F.col("_sh_block") * COPIES
    copies = blocks.repartition(*KEY, "_sh_block").withColumn("_sh_copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("_sh_n")) - 1)))
    return copies.drop("_sh_block", "_sh_n")


def numbered(rows: DataFrame, again: DataFrame) -> DataFrame:
    """``rows`` (with KEY) with _sh_copy, which tells equal rows apart; ``again`` has the keys of several rows with their number."""
    none = F.lit(0).cast("long").alias("_sh_copy")
    if again.isEmpty():
        return rows.select("*", none)
    others = [c for c in rows.columns if c not in KEY]
    some = materialize(rows.join(again, KEY), "equal")  # written, so that the join can be split at a hot row
    one = some.groupBy(*KEY).agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_sh_row"), F.max("_sh_n").alias("_sh_n"))
    copies = each_copy(one).select(*[F.col("_sh_row").getField(c).alias(c) if c in others else F.col(c) for c in rows.columns], "_sh_copy")
    return rows.join(again, KEY, "left_anti").select(*[f"`{c}`" for c in rows.columns], none).unionByName(copies)


def shuffle_shards(records: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``records`` with _shard and _slot: the slots of a shard run from 0 without a gap."""
    digests = materialize(records.select(*row_key(records, seed), row_bytes(records).alias("_sh_size")), "digests")
    total, size = digests.agg(F.count(F.lit(1)), F.coalesce(F.sum("_sh_size"), F.lit(0))).first()
    again = materialize(digests.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_sh_n")).where("_sh_n > 1"), "again")
    buckets = max(1, -(-size // bucket_bytes))
    tasks = min(-(-buckets // TOGETHER), TASKS)
    bucket = F.pmod(F.xxhash64(F.lit(seed), *KEY, "_sh_copy"), F.lit(buckets)).cast("long")
    scattered = numbered(records.select("*", *row_key(records, seed)), again).withColumn("_sh_bucket", bucket).repartition(tasks, "_sh_bucket")

    sizes = numbered(digests.select(*KEY), again).groupBy(bucket.alias("_sh_bucket")).agg(F.count(F.lit(1)).alias("_sh_n"))
    sizes = materialize(sizes, "sizes").withColumn("_sh_group", F.expr(f"_sh_bucket div {BLOCK}"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("_sh_group").agg(F.sum("_sh_n").alias("_sh_n"))  # one row for so many buckets
    groups = groups.select("_sh_group", F.coalesce(F.sum("_sh_n").over(before("_sh_group")), F.lit(0)).alias("_sh_base"))
    offsets = sizes.withColumn("_sh_off", F.coalesce(F.sum("_sh_n").over(before("_sh_group", "_sh_bucket")), F.lit(0))).join(groups, "_sh_group")
    offsets = offsets.select("_sh_bucket", "_sh_n", (F.col("_sh_base") + F.col("_sh_off")).alias("_sh_first"))

    # the same partitions as the records', sorted, so that the generator meets the buckets in a fixed order
    fixed = offsets.repartition(tasks, "_sh_bucket").sortWithinPartitions("_sh_bucket")
    order = F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("_sh_n") - 1), seed)
    orders = fixed.select("_sh_bucket", "_sh_first", order.alias("_sh_order"))
    within = Window.partitionBy("_sh_bucket").orderBy(*KEY, "_sh_copy")
    placed = scattered.withColumn("_sh_rank", F.row_number().over(within)).join(orders.hint("merge"), "_sh_bucket")
    at = F.col("_sh_first") + F.element_at("_sh_order", F.col("_sh_rank"))
    dealt = placed.select(*[F.col(f"`{c}`") for c in records.columns], at.alias("_sh_at"))
    dealt = dealt.withColumn("_shard", F.expr(f"cast(_sh_at * {shards} div {max(1, total)} as int)"))
    return dealt.withColumn("_slot", F.expr(f"_sh_at - (cast(_shard as long) * {total} + {shards - 1}) div {shards}")).drop("_sh_at")


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """One folder for each shard. Every bucket writes its records to the one or two shards that they fall into, in the order of their slots."""
    dealt = shuffle_shards(docs, **how)
    dealt.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def read_shards(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """What ``write_shards`` wrote of ``records``."""
    schema = StructType([*records.schema.fields, StructField("_slot", LongType()), StructField("_shard", IntegerType())])
    return spark.read.schema(schema).parquet(path)


def op4_shards(spark, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "shards")
    write_shards(docs, path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return read_shards(spark, path, docs).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
