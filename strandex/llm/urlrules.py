"""URL filters by a sort-merge range join, DataFrame only.

A host becomes a key of its labels in reverse, each ended by a dot (``net.example.blog.``), so a rule's host
with all its subdomains is one interval of keys; below a rule's host, a path prefix is one interval of
paths.  Two sorted sweeps meet them.  The first runs over distinct hosts and the rules' hosts: a running count of open
intervals is the height of the stack, and slot d of the stack is the last rule host that opened at height d, so a
host gets its stack of nested rule hosts.  The second runs over distinct (rule host, path) of the urls below some rule
host and over the rules: the last rule that opened at a point's height is the top of its stack, the longest
rule of that host that fits.  Of a url's rule hosts the longest rule (host and path) wins, then the longer host;
of several actions of one rule the last by code point, so block before allow.

Scale: both sweeps are dealt by split points of the sorted keys; an interval that crosses split points re-opens at
each.  So a host with a third of all urls, or of all rules, is spread like any other, and no row ever holds the rules of
a host.  Urls meet their verdict by a shuffled join whose large partitions AQE splits.  Split points spread work,
results do not depend on them; they come from a sample of bounded size (at most 32 keys of 256 bytes for each range).

Nulls: a null url, or one without ``://``, has empty host and path and gets the default.  Rules without a
host fit nothing; a null rule path counts as empty.  Repeated rows are judged alike, empty tables work, extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, cut, fresh

#: Points aimed at in each range of a sweep, the most ranges, sampled keys for each of them, and bytes of a sampled key.
RANGE_POINTS, MOST_RANGES, SAMPLED, KEY_BYTES = 1024, 4096, 16, 256
#: Split points of a block: a key finds its block first, then its range in it.
BLOCK = 64
#: Bytes that occur in no UTF-8 text: between host and path, and above every continuation of a prefix.
_BETWEEN, _ABOVE = b"\xfe", b"\xff"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) triples as a table."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    raw = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = F.substring(after, F.length(raw) + 1, F.length(after))
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(rest, "^[^?#]*", 0)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")).cast("binary")


def path_key(host: Column, path: Column) -> Column:
    return F.concat(host.cast("binary"), F.lit(_BETWEEN), path.cast("binary"))


def _range_of(key: Column, cuts: list[bytes]) -> Column:
    """Number of split points up to ``key``: those of whole blocks, then those in the block; hexadecimal text sorts as bytes do."""
    if not cuts:
        return F.lit(0)
    text = lambda some: F.split(F.lit(",".join(c.hex().upper() for c in some)), ",")  # noqa: E731  one constant, whatever its length
    upto = lambda some: F.size(F.filter(some, lambda c: c <= F.hex(key)))
    if len(cuts) <= BLOCK:
        return upto(text(cuts))
    blocks = upto(text(cuts[BLOCK - 1 :: BLOCK]))
    return blocks * BLOCK + upto(F.slice(text(cuts), blocks * BLOCK + 1, F.lit(BLOCK)))


def _events(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points (``key, at``) and intervals (``low, high, tag``) in sweep order by ``part``: ``key, kind, step, at, tag, height``."""
    n = points.agg(F.approx_count_distinct("key")).first()[0]
    ranges, cuts = max(1, min(MOST_RANGES, n // RANGE_POINTS)), []
    if ranges > 1:
        some = points.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // (SAMPLED * ranges)))) == 0).select(F.substring("key", 1, KEY_BYTES).alias("key"))
        keys = sorted(bytes(r["key"]) for r in some.limit(2 * SAMPLED * ranges).collect())
        cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    kinds = {f.name: f.dataType for f in [*points.schema, *intervals.schema]}
    none = {c: F.lit(None).cast(kinds[c]).alias(c) for c in ("at", "tag")}
    bounds = intervals.withColumn("first", _range_of(F.col("low"), cuts)).withColumn("last", _range_of(F.col("high"), cuts))
    row = lambda kind, step: (F.lit(kind).alias("kind"), F.lit(step).alias("step"))
    opens = bounds.select(F.explode(F.sequence("first", "last")).alias("part"), F.col("low").alias("key"), *row(0, 1), none["at"], "tag")
    closes = bounds.select(F.col("last").alias("part"), F.col("high").alias("key"), *row(0, -1), none["at"], none["tag"])
    events = opens.unionByName(closes).unionByName(points.select(_range_of(F.col("key"), cuts).alias("part"), "key", *row(1, 0), "at", none["tag"]))
    return events.withColumn("height", F.sum("step").over(_upto("part")))


def _upto(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def host_stacks(hosts: DataFrame, rule_hosts: DataFrame) -> DataFrame:
    """``host`` (distinct) to ``host, stack``: the rule hosts it equals or lies under; hosts under none are left out."""
    low = host_key(F.col("host"))
    # the last label's dot gives way to the next byte, so the interval ends after all subdomains
    intervals = rule_hosts.select(low.alias("low"), F.concat(F.expr("substring(low, 1, length(low) - 1)"), F.lit(b"/")).alias("high"), F.col("host").alias("tag"))
    events = _events(hosts.select(low.alias("key"), F.col("host").alias("at")), intervals)
    deep = events.where("step = 1").agg(F.max("height")).first()[0] or 0
    slots = [F.last(F.when((F.col("step") == 1) & (F.col("height") == d), F.col("tag")), ignorenulls=True).over(_upto("part")).alias(f"slot{d}") for d in range(1, deep + 1)]
    stack = F.slice(F.array(*[F.col(f"slot{d}") for d in range(1, deep + 1)]), F.lit(1), F.col("height").cast("int")) if deep else F.array().cast("array<string>")
    swept = events.select("kind", "at", "height", *slots)
    return swept.where((F.col("kind") == 1) & (F.col("height") > 0)).select(F.col("at").alias("host"), stack.alias("stack"))


def longest_rules(points: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``of, path`` (a rule host and a url's path) to those plus ``rule_path, action`` of the longest rule that fits."""
    low = path_key(F.col("host"), F.col("path"))
    intervals = rules.select(low.alias("low"), F.concat(low, F.lit(_ABOVE)).alias("high"), F.struct(F.col("path").alias("rule_path"), "action").alias("tag"))
    events = _events(points.select(path_key(F.col("of"), F.col("path")).alias("key"), F.struct("of", "path").alias("at")), intervals)
    top = events.withColumn("top", F.last("tag", ignorenulls=True).over(_upto("part", "height")))
    return top.where((F.col("kind") == 1) & (F.col("height") > 0)).select("at.*", "top.*")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", names: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """Every column of ``pages`` but the url, plus host, path, rule (null: none fits) and verdict."""
    keep = [c for c in pages.columns if c != url]
    rest = pages.select(*[col(c) for c in keep])
    added = fresh(rest, *names)
    host, path = host_and_path(col(url))
    row = pages.select(F.struct(*[col(c) for c in keep]).alias("row"), host.alias("host"), path.alias("path"))
    clean = rules.where(F.coalesce("host", F.lit("")) != "").select(F.coalesce("action", F.lit(default)).alias("action"), F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    clean = cut(clean.groupBy("host", "path").agg(F.max("action").alias("action")))
    below = row.select("host", "path").where("host <> ''").distinct()
    stacks = host_stacks(cut(below.select("host").distinct()), clean.select("host").distinct())
    below = cut(below.join(stacks, "host").select("host", "path", F.explode("stack").alias("of")))
    fits = below.join(longest_rules(below.select("of", "path").distinct(), clean), ["of", "path"])
    rule = F.concat("of", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("length"), F.length("of").alias("host_length"), "action", rule.alias("rule")))
    found = fits.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(best.alias("best"))
    out = row.join(found, (row["host"] == found["b_host"]) & (row["path"] == found["b_path"]), "left")
    return out.select("row.*", F.col("host").alias(added[0]), F.col("path").alias(added[1]), F.col("best.rule").alias(added[2]), F.coalesce("best.action", F.lit(default)).alias(added[3]))
