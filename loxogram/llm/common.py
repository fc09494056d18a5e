"""What the pipeline operators share: scratch tables, row keys and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where scratch tables go in local sessions that name no folder (tests).
LOCAL_SCRATCH = "/tmp/checkpoints/loxogram"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A session that names none gets a local folder, which goes when the process ends, but only where the
    driver is the only machine.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"{LOCAL_SCRATCH}/{os.getpid()}"
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def scratch_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/loxogram-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what the operators of this application wrote. Results read their tables lazily, so they must be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that read the table, and values
    that depend on a task's order (generated numbers) are fixed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: Column | str, text: Column | str) -> Column:
    """A key that tells rows apart even where doc_id is null or repeated.

    Rows that share it are copies of one another (same id, same text up to a 64-bit hash and length).
    """
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return F.struct(doc_id.alias("d"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else: lower() would also change letters beyond ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, upper, lower)).otherwise(F.lower(text))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id counts as the empty string (crc32 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
