"""Idempotent ingest of events, in batch and as a stream, and snapshot upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_rows(stored: DataFrame, drafts: DataFrame, keys: list[str]) -> DataFrame:
    """Drafts whose key isn't stored yet, one for each key: that of the least hash, so reruns agree."""
    values = [c for c in drafts.columns if c not in keys]
    once = drafts.groupBy(*keys).agg(F.min_by(F.struct(*values), F.xxhash64(*values)).alias("r")).select(*keys, "r.*") if values else drafts.distinct()
    return once.select(*drafts.columns).join(stored.select(*keys), keys, "left_anti")


def insert_new(stored: DataFrame, drafts: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows and the new ones: what an insert that does nothing on conflict leaves."""
    return stored.unionByName(new_rows(stored, drafts, keys).select(*stored.columns))


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows with those of equal key replaced: keep-latest over a union, in one shuffle."""
    values = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_v", F.lit(0)).unionByName(changes.select(*stored.columns).withColumn("_v", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*values), "_v").alias("r")).select(*keys, "r.*").select(*stored.columns)


def append_versions(stored: DataFrame, drafts: DataFrame, key: str, order: str, version: str = "version") -> DataFrame:
    """Drafts with their next versions: one more than the key's last, in order."""
    from pyspark.sql import Window

    last = stored.groupBy(key).agg(F.max(version).alias("_last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return drafts.join(last, key, "left").withColumn(version, F.coalesce("_last", F.lit(0)) + place).drop("_last")


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces just the partitions that the rows touch: delete and rebuild by key."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
