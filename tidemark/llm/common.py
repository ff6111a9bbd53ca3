"""Helpers the corpus operators share: table access, lineage cuts, checked broadcasts, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the size and quality contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows that a broadcast side may have; each caller's rows are at most a few hundred bytes.
BROADCAST_ROWS = 100_000

#: Most bytes and rows that one Arrow batch hands to a Python worker, so that long texts stay bounded.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and
    everything runs on one machine. A cluster must name its folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if (at := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that what follows neither recomputes it nor depends on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: like cut, but readers take the columns they need."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, else df as it is, for a shuffled join. df must be cheap to read twice."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
