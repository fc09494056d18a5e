"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed size. The blocks that occur more than once are sorted and
numbered, and so each has one integer name; then adjacent names are paired and the distinct pairs are
numbered in turn, until every text is down to one name, which by construction stands for exactly one
byte string. A text with a block that occurs nowhere else has no copy and takes no further part.

Every step counts or numbers distinct values before it joins them back, so a block that a third of all
documents share is one row on the side that is built; the other side of each join has the rows of one
key dealt over tasks by adaptive execution's skew handling.

Defined cases: a null text equals the empty text; of equal texts the row with the largest doc_id
stays (null ids lose to any other); rows that also share the doc_id count one by one, and exactly one of
them stays; an empty table gives no rows; columns other than id and text are left alone, under any names but
_rid and _stays; a very long text is as many rows as it has blocks, which different tasks name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, table

BLOCK_BYTES = 4096


def _number(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sorts distinct keys within hash partitions and numbers them; written, so that numbers are final."""
    return materialize(distinct.repartition(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), name)


def identities(docs: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """(rid, level, name): one name for each text that may have a copy; equal texts and only they share it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blocks = (
        docs.select(row_key("doc_id", text).alias("rid"), text.cast("binary").alias("b"))
        .withColumn("nb", F.greatest(F.lit(1), F.ceil(F.octet_length("b") / F.lit(block)).cast("int")))
        .select("rid", "nb", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("pos"))
        .select("rid", "nb", "pos", F.expr(f"substring(b, pos * {block} + 1, {block})").alias("block"))
    )
    repeated = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block")
    now = blocks.join(_number(repeated, ["block"], "blocks"), "block").select("rid", "nb", "pos", "name")
    level, done = 0, None
    while True:
        now = materialize(now, f"level{level}")
        here = now.where("nb = 1").select("rid", F.lit(level).alias("level"), "name").distinct()
        done = here if done is None else done.unionByName(here)
        rest = now.where("nb > 1")
        if rest.isEmpty():
            return done
        pairs = (
            rest.groupBy("rid", "nb", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("l"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("r"))
            .where("l is not null and (r >= 0 or 2 * pos + 1 >= nb)")
        )
        names = _number(pairs.select("l", "r").distinct(), ["l", "r"], f"pairs{level}")
        now = pairs.join(names, ["l", "r"]).select("rid", F.expr("(nb + 1) div 2").cast("int").alias("nb"), "pos", "name")
        level += 1


def exact_groups(docs: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: which row stays of its group, the group's size, the text's digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", row_key("doc_id", text).alias("rid"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    rows = rows.join(identities(docs, block), "rid", "left").withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(rows, "named")
    groups = rows.where("name is not null").groupBy("level", "name").agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "groups")  # written, so that the join with it can be split at a hot group
    shared = rows.join(groups, ["level", "name"]).select(
        "doc_id", "rid", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("top.uid")).alias("kept"), "text_sha256"
    )
    alone = rows.where("name is null").select(
        "doc_id", "rid", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return shared.unionByName(alone)


def drop_copies(docs: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that do not stay, all columns kept."""
    gone = exact_groups(docs, block).where("not kept or group_size > 1").groupBy("rid").agg(F.max("kept").alias("_stays"))
    keyed = docs.withColumn("_rid", row_key("doc_id", F.coalesce(F.col("text"), F.lit("")))).join(gone.withColumnRenamed("rid", "_rid"), "_rid", "left")
    alone = keyed.where("_stays is null").drop("_rid", "_stays")
    return alone.unionByName(keyed.where("_stays").dropDuplicates(["_rid"]).drop("_rid", "_stays"))


def op5_exact(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("rid")


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
