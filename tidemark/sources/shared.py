"""The folder that driver and executors share, and lineage cuts that live in it."""

from __future__ import annotations

import tempfile
import uuid

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and everything runs on one machine, a folder of our own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return named or context.getCheckpointDir()


#: Whether Spark removes the shuffle files of a statement when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that what follows neither recomputes it nor depends on an executor. Columns are
    compressed, so this takes a fraction of a checkpoint's disk, and the shuffles behind it, which nothing reads again, go when
    it is written."""
    spark = df.sparkSession
    at, before = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}", spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(at)


#: Rows of known facts up to which they are broadcast, some hundred bytes each.
KNOWN_ROWS = 400_000


def _hashed(keys: list[str]) -> Column:
    """A number for a combination of keys; a null is no missing one."""
    return F.xxhash64(*[F.col(k) for k in keys], *[F.col(k).isNull() for k in keys])


def with_known(rows: DataFrame, known: DataFrame, keys: list[str], most: int = KNOWN_ROWS) -> DataFrame:
    """rows with the facts of known, which has one row for each combination of keys (nulls included) that occurs in rows.

    Rows meet their facts by a hash of the keys, broadcast without the keys themselves. That is exact as long as no two
    combinations share a hash, which is counted; otherwise, or if they are more than `most`, the keys themselves are compared
    in a shuffled join."""
    facts = [c for c in known.columns if c not in keys]
    known = cut(known.withColumn("_h", _hashed(keys)))
    n, hashes = known.agg(F.count("*"), F.count_distinct("_h")).first()
    if n <= most and hashes == n:
        return rows.withColumn("_h", _hashed(keys)).join(F.broadcast(known.select("_h", *facts)), "_h", "left").drop("_h")
    named = known.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *facts)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return rows.join(named, same, "left").drop(*[f"_of_{k}" for k in keys])
