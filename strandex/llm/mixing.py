"""Mixing sources to target weights by weighted fair queueing, DataFrame only.

Each source is a queue of its documents in a stable shuffled order (MD5 of the id), repeated once more for
a second pass.  A document's virtual finish time is the source's words up to and including it, over
the source's target; documents leave in order of finish time, over all sources, until the budget (the sum of
the targets) is spent.  So every prefix of the mix holds the sources in the ratio of their targets.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share 150 % of all words;
none may exceed twice its words, and the excess is reshared by weight until none does.  This is solved in
closed form: in order of (cap / weight), the first sources are capped and the rest share what is left.

Scale: words are counted in one native pass and checkpointed as narrow rows.  Running sums are two-level:
the shuffle order is cut into buckets by leading hex digits, sums of (source, bucket) give each bucket its
start, and rows add up inside their bucket, so a source with a third of all rows is spread over
thousands of tasks.  Turns (a document's passes, narrow rows) are sorted by finish time over ranges; sums of the ranges
tell in which one the budget ends, which is cut into ranges again while it has more than ``EDGE_ROWS`` rows, and the rest
is summed up row by row: the first turn beyond the budget decides for all.  Per-source tables are one row per source; they,
sums of ranges and one edge are all that meets in a single task.  ``mixed_rows`` emits the mix in order of finish: texts are
shuffled to their bucket for their finish time, and those taken once more by the sort.

Nulls: a null or empty text has size 0 and is never taken; a null source is a source; a null id has the key of an empty
one.  Very long texts count whole.  Ties: equal finish times go by key, source, id and checksum; repeated rows are
documents of their own that follow each other.  Extra columns are kept by ``mixed_rows`` whatever their names.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, cut, join_small, n_words

WEIGHTS = (5, 2, 1)
SHARE, PASSES = 1.5, 2
#: Hex digits of the shuffle order that make a bucket; rows of a range of turns that are summed in one task, the most ranges.
BUCKET_DIGITS, EDGE_ROWS, MOST_RANGES = 3, 10_000, 10_000
#: Rows of the buckets' table that may be broadcast to the texts.
BROADCAST_STARTS = 200_000
#: The order of turns.
ORDER = ("f", "key", "tag", "doc_id", "crc", "p")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size`` (one row per source) to those plus ``target``."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(w) for w in WEIGHTS])
    t = sizes.withColumn("weight", F.get(weight, F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))))
    by_cap = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    cap = PASSES * F.col("source_size")
    left = F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("left", left).withColumn("weights", weights).withColumn("capped", cap * F.col("weights") <= F.col("weight") * F.col("left"))
    level = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("weight")).alias("o"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), "left", "weights"))).over(everything)
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * F.col("level.left") / F.col("level.weights"))
    return t.withColumn("level", level).select("source", "source_size", target.alias("target"))


def _tag(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _narrow(df: DataFrame, doc_id: str, text: str, source: str) -> list[Column]:
    """What the order of a document depends on: ``doc_id, tag, size, crc, key``; the tag lets null sources meet."""
    key = F.md5(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return [col(doc_id).alias("doc_id"), _tag(col(source)).alias("tag"), n_words(col(text)).alias("size"), F.crc32(F.coalesce(col(text), F.lit("")).cast("binary")).alias("crc"), key.alias("key")]


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row: ``doc_id, size, source_size, target, taken`` and ``finish``, the first pass's virtual time."""
    queue, _, stop = _decided(df, doc_id, text, source)
    taken = sum(F.when(_taken(p, stop, queue), F.col("size")).otherwise(0) for p in range(PASSES))
    return queue.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("f0").alias("finish"))


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))


def _queue(rows: DataFrame, starts: DataFrame, n: int, *tie: str) -> DataFrame:
    """Adds ``source_size, target`` and the finish times ``f*`` of each pass (null: never taken) to bucketed rows."""
    inside = F.sum("size").over(Window.partitionBy("tag", "bucket").orderBy("key", "doc_id", "size", "crc", *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queue = join_small(rows, starts, ["tag", "bucket"], n, BROADCAST_STARTS, "inner").withColumn("end", F.col("start") + inside)
    live = (F.col("size") > 0) & (F.col("target") > 0)
    return queue.withColumns({f"f{p}": F.when(live, (F.col("end") + p * F.col("source_size")) / F.col("target")) for p in range(PASSES)})


def _decided(df: DataFrame, doc_id: str, text: str, source: str) -> tuple[DataFrame, tuple[DataFrame, int], Row | None]:
    """The queue of all documents as narrow rows, the buckets' starts (and their number), and the first turn not taken."""
    rows = _bucketed(cut(df.select(*_narrow(df, doc_id, text, source), col(source).alias("source"))))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goal = cut(targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size"))))
    start = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.withColumn("start", F.coalesce(start, F.lit(0)))
    starts = starts.join(goal, starts["source"].eqNullSafe(goal["source"])).select(_tag(starts["source"]).alias("tag"), "bucket", "start", "source_size", "target")
    starts = cut(starts)
    n = starts.count()
    queue = cut(_queue(rows.drop("source"), starts, n).select("doc_id", "size", "source_size", "target", "tag", "key", "crc", *[f"f{p}" for p in range(PASSES)]))
    # one row per source; summed in a fixed order, so reruns agree to the last bit
    total = goal.agg(F.aggregate(F.array_sort(F.collect_list("target")), F.lit(0.0), lambda a, x: a + x).alias("x")).first()["x"] or 0.0
    return queue, (starts, n), _first_beyond(_turns(queue), total)


def _turns(queue: DataFrame, *keep: str) -> DataFrame:
    passes = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"f{p}").alias("f")) for p in range(PASSES)])
    return queue.select("doc_id", "size", "tag", "key", "crc", F.explode(passes).alias("t"), *keep).select("doc_id", "size", "tag", "key", "crc", "t.p", "t.f", *keep).where("f is not null")


def _first_beyond(turns: DataFrame, total: float) -> Row | None:
    """The first turn in global order that would exceed the budget; None when all fit."""
    turns, before = cut(turns), 0
    n = turns.count()
    while n > EDGE_ROWS:
        dealt = cut(turns.repartitionByRange(min(MOST_RANGES, n // EDGE_ROWS + 1), *ORDER).withColumn("part", F.spark_partition_id()))
        sums = dealt.groupBy("part").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        sums = sums.withColumn("upto", F.lit(before) + F.sum("words").over(Window.orderBy("part")))
        edge = sums.where(F.col("upto") > total).orderBy("part").first()
        if edge is None:
            return None
        before, turns = edge["upto"] - edge["words"], dealt.where(F.col("part") == edge["part"]).drop("part")
        if edge["rows"] == n:
            break
        n = edge["rows"]
    upto = F.lit(before) + F.sum("size").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return turns.withColumn("upto", upto).where(F.col("upto") > total).agg(F.min(F.struct(*ORDER)).alias("x")).first()["x"]


def _taken(p: int, stop: Row | None, queue: DataFrame) -> Column:
    """Whether the mix takes pass ``p`` of a row of a queue."""
    f = F.col(f"f{p}")
    if stop is None:
        return f.isNotNull()
    types = dict(queue.dtypes) | {"f": "double", "p": "int"}
    at = F.struct(f.alias("f"), *ORDER[1:-1], F.lit(p).alias("p"))
    return f.isNotNull() & (at < F.struct(*[F.lit(stop[k]).cast(types[k]).alias(k) for k in ORDER]))


def _no_map(t: T.DataType) -> bool:
    return not isinstance(t, (T.MapType, T.VariantType)) and all(_no_map(f.dataType) for f in getattr(t, "fields", [])) and (not isinstance(t, T.ArrayType) or _no_map(t.elementType))


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", ordered: bool = True) -> DataFrame:
    """The mix itself: rows of ``df`` as often as they are taken, all columns as they were, in order of finish time
    (``ordered`` false: the same rows as they lie, for a reader that sorts them anyway, with one shuffle of texts less).

    Repeated rows (equal id, source and text) follow each other by a hash of the whole row (its maps left out).
    """
    _, (starts, n), stop = _decided(df, doc_id, text, source)
    names = [f"r{i}" for i in range(len(df.columns))]
    tie = F.xxhash64(*[col(f.name) for f in df.schema if _no_map(f.dataType)])
    rows = df.select(*[col(c).alias(r) for c, r in zip(df.columns, names, strict=True)], *_narrow(df, doc_id, text, source), tie.alias("tie")).where("size > 0")
    queue = _queue(_bucketed(rows), starts, n, "tie")
    queue = queue.withColumns({f"f{p}": F.when(_taken(p, stop, queue), F.col(f"f{p}")) for p in range(PASSES)})
    turns = _turns(queue, *names)
    return (turns.orderBy(*ORDER) if ordered else turns).select(*names).toDF(*df.columns)
