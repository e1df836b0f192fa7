"""Incremental index builds: status by content hash, purge of orphans, latest-wins upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def status(new: DataFrame, old: DataFrame) -> DataFrame:
    """``path, status, content_hash, old_hash``; status is new, changed, same or orphan.  One full join on the path.

    Presence decides, not the hash: a path on both sides whose hash is unknown on either is changed."""
    here, there = new.select("path", "content_hash", F.lit(True).alias("here")), old.select("path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("there"))
    word = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "orphan").when(F.col("content_hash") == F.col("old_hash"), "same").otherwise("changed")
    return here.join(there, "path", "full").withColumn("status", word).drop("here", "there")


def without(table: DataFrame, known: DataFrame, column: str = "path") -> DataFrame:
    """Purge: only rows whose path is known."""
    return table.join(known.select(F.col("path").alias(column)).distinct(), column, "left_semi")


def delete_paths(table: DataFrame, paths: DataFrame, column: str) -> DataFrame:
    """Rows of other paths (cascading delete, table by table)."""
    return table.join(paths.select(F.col("path").alias(column)).distinct(), column, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows win over old ones of the same key; of several rows of a key, the last by ``order`` (then by all columns)."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    best = Window.partitionBy(*keys).orderBy(F.desc("_v"), *[F.desc_nulls_last(c) for c in [*(order or []), *old.columns]])
    return both.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_v", "_k")


def run_stats(statuses: DataFrame) -> DataFrame:
    """One row: scanned, indexed, skipped, removed."""
    is_ = lambda *w: F.count_if(F.col("status").isin(*w))
    return statuses.agg(is_("new", "changed", "same", "unread").alias("scanned"), is_("new", "changed").alias("indexed"), is_("same").alias("skipped"), is_("orphan").alias("removed"))
