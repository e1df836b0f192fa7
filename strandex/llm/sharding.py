"""Sharding by jump consistent hashing.

A document's shard depends on its id and the number of shards alone, without a ring table; with one more
shard, rows move only into the new one (about 1/(n+1) of them).  Slots number a shard's rows from 0
without gaps, in the order of (id, size, text checksum).

Scale: ids map to shards row by row.  For slots, narrow rows are sorted once by (shard, id, size, checksum) over ranges
that Spark samples, for ids of any type; a row's place in its range, less that of its shard's first row there, plus the
shard's rows in earlier ranges, is its slot.  Only these counts, one for each shard and range, meet in a window.  Ranges
only spread work: slots do not depend on them.  Equal rows are told apart by a number, so an id that repeats without
end spreads over ranges as well.

Nulls: a null id hashes as the empty text and comes first; a null or empty text has size 1 and checksum 0.  Very long
texts count whole.  Ties (repeated rows) each get a slot; which of them gets which cannot be told from the result.
An empty table gives an empty result; extra columns are ignored, or kept by ``sharded``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, fresh, ship, stored

SHARDS = 8
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Rows of a range aimed at, and the most ranges.
RANGE_ROWS, MOST_RANGES = 50_000, 10_000
#: Fixed value: the multiplier of the published algorithm's linear congruential generator.
_LCG = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys into ``n`` buckets (n >= 1), vectorised."""
    key = keys.astype(np.uint64)
    bucket, nxt = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.ones(len(key), bool)
    while live.any():
        bucket[live] = nxt[live]
        key[live] = key[live] * _LCG + np.uint64(1)
        nxt[live] = ((bucket[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live & (nxt < n)
    return bucket.astype(np.int32)


def stable_key(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text, so near ids spread evenly."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shard_of(doc_id: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), n))

    return bucket(stable_key(doc_id))


def assign(df: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    rows = cut(_keyed(df, shards, doc_id, text))
    return _slots(rows, rows.count(), cut).select("doc_id", *ADDED)


def sharded(df: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The corpus itself, dealt: every column of ``df`` and those of ``assign`` but the id (names made unique), sorted by shard
    and slot over ranges, so each file written from it holds a run of one or few shards.  Texts are shuffled once and
    stored as Parquet in the shared folder (columns need types that Parquet has)."""
    names = [f"r{i}" for i in range(len(df.columns))]
    rows = _keyed(df, shards, doc_id, text, *[col(c).alias(n) for c, n in zip(df.columns, names, strict=True)])
    out = _slots(rows, df.count(), stored)
    return out.select(*names, *ADDED).toDF(*df.columns, *fresh(df, *ADDED))


def _keyed(df: DataFrame, shards: int, doc_id: str, text: str, *keep: Column) -> DataFrame:
    ship(df.sparkSession)
    whole = F.coalesce(col(text), F.lit(""))
    rows = df.select(*keep, col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
    return rows.withColumn("tie", F.monotonically_increasing_id())


def _slots(rows: DataFrame, n: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``slot`` to ``n`` keyed rows; ``keep`` holds the sorted rows, so that places and their counts agree."""
    order = [F.col("shard").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc(), F.col("tie").asc()]
    dealt = rows.repartitionByRange(max(1, min(MOST_RANGES, n // RANGE_ROWS)), *order).sortWithinPartitions(*order)
    # Spark numbers a partition's rows in order: the partition above 33 bits, the place in it below
    dealt = keep(dealt.withColumn("at", F.monotonically_increasing_id()))
    counts = dealt.groupBy("shard", F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("shard").alias("of"), "part", (before - F.col("first")).alias("shift"))
    # at most the ranges and the shards together: bounded by MOST_RANGES
    found = dealt.join(F.broadcast(starts), (dealt["shard"] == starts["of"]) & (F.shiftright("at", 33) == starts["part"]))
    return found.withColumn("slot", (F.col("at") + F.col("shift")).cast("long"))
