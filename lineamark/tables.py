"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has at least one row in so many; so there are at most HOT hot keys, whatever the size of a table.
HOT = 1000


#: Bytes of an Arrow batch on its way to a Python worker, in place of Spark's default.
BATCH, DEFAULT = "4194304b", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes, so that long texts don't fill an executor's memory beside its heap; a size that
    the session was given stands."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == DEFAULT:
        spark.conf.set(name, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "/tmp/checkpoints/lineamark"
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile leaves no shuffle files: for results that nothing asks for again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors. Shuffles behind it go."""
    path = new_path(df.sparkSession, what)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(table: DataFrame) -> None:
    """Delete the files of a table made by written(), which nothing will read again."""
    spark = table.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it (column names are compared without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """left with the other columns of right (unique in keys, null where it lacks them), safe for hot keys.

    right's column count says how many rows of left have the key. Those of a HOT-th part of total rows or more are
    HOT at most: they are broadcast, and their rows of left leave the shuffle join's keys by a salt.
    """
    values = [c for c in right.columns if c not in keys]
    hit, salt = free_name(left, "hit_"), free_name(left, "salt_")
    hot = right.where(F.col(count) * HOT >= total).select(*keys, *(F.col(c).alias(f"hot_{c}") for c in values), F.lit(True).alias(hit))
    # no literal: the optimiser would take it out of the join's keys, and with it the salt of the left rows
    rest = right.where(F.col(count) * HOT < total).withColumn(salt, F.pmod(F.col(count), F.lit(1)).cast("int"))
    told = left.join(F.broadcast(hot), keys, "left")
    told = told.withColumn(salt, F.when(F.col(hit), 1 + F.pmod(F.xxhash64(*left.columns), F.lit(1 << 20))).otherwise(0).cast("int"))
    joined = told.join(rest, [*keys, salt], "left")
    return joined.select(*left.columns, *(F.coalesce(F.col(f"hot_{c}"), F.col(c)).alias(c) for c in values))
