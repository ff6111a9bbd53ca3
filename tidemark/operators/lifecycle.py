"""Retention, purges, backups, self-checks and the fold of subscription events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETENTION_DAYS, PURGE_HOURS, BACKUP_DAYS = 14, 48, 7
MOST_PRICE, MOST_KM = 1e9, 2_000_000
TIERS = ((200, 1), (500, 2))


def fresh(rows: DataFrame, now: datetime, days: int = RETENTION_DAYS, ts: str = "updated_at") -> DataFrame:
    """Rows not older than that many days; now is a parameter, as the clock is no input."""
    return rows.where(F.col(ts) >= F.lit(now) - F.expr(f"interval {days} days"))


def anomalous() -> Column:
    return (F.col("price") > MOST_PRICE) | (F.col("mileage_km") > MOST_KM) | (F.col("price") <= 0)


def zero_km() -> Column:
    return F.col("mileage_km") == 0


def purge(rows: DataFrame, users: DataFrame, now: datetime, user: str = "user_id", hours: int = PURGE_HOURS) -> DataFrame:
    """rows without those of users (user_id, ended_at) whose subscription ended long enough ago."""
    gone = users.where(F.col("ended_at") <= F.lit(now) - F.expr(f"interval {hours} hours")).select(F.col("user_id").alias("_gone"))
    return rows.join(gone, F.col(user) == F.col("_gone"), "left_anti")


def tier(n: Column) -> Column:
    out = F
    for most, name in TIERS:
        out = out.when(n <= most, name)
    return out.otherwise(len(TIERS) + 1)


def latest(rows: DataFrame, key: str, value: str, ts: str, tie: str) -> DataFrame:
    """The last value of each key, by time and then by tie: one aggregate, no sort."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias(value), F.max(ts).alias(ts))


def backup(rows: DataFrame, path: str) -> None:
    """A gzipped dump as Parquet under path."""
    rows.write.mode("overwrite").option("compression", "gzip").parquet(path)


def expired_files(files: DataFrame, now: datetime, days: int = BACKUP_DAYS) -> DataFrame:
    """Files (path, modificationTime) that a prune removes: older than that many days, but never the newest one."""
    newest = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("newest"))
    return files.where(F.col("modificationTime") < F.lit(now) - F.expr(f"interval {days} days")).join(F.broadcast(newest), F.col("path") == F.col("newest"), "left_anti")


def drop_stale(rollup: DataFrame, watermark: Column, ts: str = "refreshed_at") -> DataFrame:
    """A rollup without the rows that its last refresh did not write: what is written over it."""
    return rollup.where(F.col(ts) >= watermark)
