"""Ranked text search: BM25 over phrases with prefixes, re-ranking with an audit trail.

A query word is a phrase of adjacent tokens of one column whose last one matches by prefix; all words must hit.  Text is
tokenised once and every phrase is counted in the row's own arrays, so no token is shuffled or even exploded: what leaves
the scan is a length and one count for each phrase.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

# BM25 parameters, the least IDF, weights of the ranking factors and of the impact factors.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WEIGHTS = {"text_relevance": 2.0, "call_frequency": 1.5, "recency": 0.8, "name_match": 0.5, "code_hub_score": 0.3}
IMPACT_WEIGHTS = {"impact_count": 2.0, "module_spread": 1.0}


def query_phrases(query: str) -> list[list[str]]:
    """White-space words to phrases of lower-cased tokens; a word without a token is dropped."""
    words = [re.findall(r"[a-z0-9]+", w.lower()) for w in query.split()]
    return [w for w in words if w]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def _hits(terms: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in an array of tokens: its words next to each other, the last one as a prefix."""
    k = len(phrase) - 1

    def ends_here(term: Column, at: Column) -> Column:
        found = term.startswith(phrase[k])
        for back, word in enumerate(reversed(phrase[:k]), 1):
            found = found & (at >= back) & (F.coalesce(F.get(terms, at - back), F.lit("")) == word)
        return found

    return F.size(F.filter(terms, ends_here))


def term_counts(docs: DataFrame, key: str, columns: list[str], phrases: list[list[str]]) -> DataFrame:
    """``doc, len, tf0, tf1, ..``: tokens of each document and occurrences of each phrase, in one pass without a shuffle."""
    bound = docs.select(F.col(key).alias("doc"), *[F.explode(F.array(tokens(F.col(c)))).alias(f"c{i}") if i == 0 else tokens(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    cols = [F.col(f"c{i}") for i in range(len(columns))]
    total = lambda parts: sum(parts[1:], parts[0]).cast("long")
    return bound.select("doc", total([F.size(c) for c in cols]).alias("len"), *[total([_hits(c, p) for c in cols]).alias(f"tf{i}") for i, p in enumerate(phrases)])


def bm25(docs: DataFrame, key: str, columns: list[str], query: str) -> DataFrame:
    """``doc, bm25`` (negative, best lowest) of documents that hold every phrase."""
    phrases = query_phrases(query)
    if not phrases:
        return docs.select(F.col(key).alias("doc"), F.lit(0.0).alias("bm25")).where("false")
    rows, n = cut(term_counts(docs, key, columns, phrases)), len(phrases)
    stats = rows.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(n)])
    hits = rows
    for i in range(n):
        hits = hits.where(F.col(f"tf{i}") > 0)
    hits = hits.join(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        odds = F.log((F.col("docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(odds <= 0, F.lit(LEAST_IDF)).otherwise(odds)
        return idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("mean")))

    return hits.select("doc", (-sum((part(i) for i in range(1, n)), part(0))).alias("bm25"))


def search(symbols: DataFrame, query: str, kind: str | None = None, limit: int | None = 20) -> DataFrame:
    """Symbols that match on name, kind and file, best first."""
    hits = bm25(symbols, "id", ["name", "kind", "file_path"], query)
    rows = hits.join(symbols, hits["doc"] == symbols["id"]).drop("doc")
    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.orderBy("bm25", "id").limit(limit) if limit else rows


def candidates(symbols: DataFrame, relations: DataFrame, files: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """``2 * limit`` best matches with callers by name and the file's time."""
    top = search(symbols, query, kind, 2 * limit)
    called = relations.where("relation = 'CALLS'").groupBy(F.col("to_name").alias("name")).agg(F.count(F.lit(1)).alias("caller_count"))
    times = files.groupBy(F.col("path").alias("file_path")).agg(F.max("last_indexed_at").alias("last_indexed_at"))
    return top.join(called, "name", "left").join(times, "file_path", "left").na.fill(0, ["caller_count", "last_indexed_at"])


def rank(rows: DataFrame, metrics: DataFrame, query: str, limit: int = 20, compat: bool = False) -> DataFrame:
    """Re-rank ``candidates``: composite score, position from 1, and the factors that made it.

    ``compat`` divides the text score by the newest time stamp (which all but removes it); otherwise by the best
    text score.
    """
    words = F.array(*[F.lit(w.lower()) for w in query.split()]).cast("array<string>")
    top = rows.agg(F.max("last_indexed_at").alias("newest"), F.max(-F.col("bm25")).alias("best"))
    first = metrics.groupBy("name").agg(F.min_by("fan_in", "id").alias("hub"))
    r = rows.join(F.broadcast(top)).join(first, "name", "left")
    newest = F.greatest(F.coalesce(F.nullif(F.col("newest"), F.lit(0)), F.lit(1)), F.lit(1))
    scale = newest if compat else F.greatest(F.col("best"), F.lit(1e-9))
    from ..functions.scalars import name_overlap

    values = {
        "text_relevance": F.greatest(F.lit(0.0), -F.col("bm25")) / scale,
        "call_frequency": F.log1p("caller_count"),
        "recency": F.col("last_indexed_at") / newest,
        "name_match": F.least(name_overlap(words, F.col("name")), F.lit(3)) * 0.5,
        "code_hub_score": F.log1p("hub") / 3.0,
    }
    factor = lambda k: F.struct(F.lit(k).alias("name"), values[k].cast("double").alias("value"), F.lit(WEIGHTS[k]).alias("weight"), (values[k] * WEIGHTS[k]).cast("double").alias("contribution"))
    factors = F.filter(F.array(*[factor(k) for k in values]), lambda f: f["value"].isNotNull())
    r = r.withColumn("factors", factors).withColumn("composite_score", F.aggregate("factors", F.lit(0.0), lambda a, f: a + f["contribution"]))
    best = r.orderBy(F.desc("composite_score"), "name", "id").limit(limit)  # bounded before the window
    order = Window.orderBy(F.desc("composite_score"), "name", "id")
    return best.withColumn("rank_position", F.row_number().over(order)).drop("newest", "best", "hub")


def retrieve(symbols: DataFrame, relations: DataFrame, files: DataFrame, metrics: DataFrame, query: str, kind: str | None = None, limit: int = 20, compat: bool = False) -> DataFrame:
    """The whole search: over-fetch, re-rank, trim to ``limit``."""
    rows = candidates(symbols, relations, files, query, kind, 2 * limit)
    return rank(rows, metrics, query, 2 * limit, compat).where(F.col("rank_position") <= limit).orderBy("rank_position")


def explanation() -> Column:
    """The audit of a ranked row as text."""
    head = F.format_string("%s (rank #%d, score=%.3f)", "name", "rank_position", "composite_score")
    lines = F.transform("factors", lambda f: F.format_string("  %s: %.2f * %.2f = %.3f", f["name"], f["value"], f["weight"], f["contribution"]))
    return F.when(F.size("factors") == 0, F.concat("name", F.lit(": no factors evaluated"))).otherwise(F.array_join(F.concat(F.array(head), lines), "\n"))


def impact(reach: DataFrame, metrics: DataFrame) -> DataFrame:
    """``impact_count, modules, impact_score`` of a set of names (column ``name``); the spread counts only if any."""
    first = metrics.groupBy("name").agg(F.min_by("module", "id").alias("module"))
    c = reach.select("name").distinct().join(first, "name", "left").agg(F.count("name").alias("impact_count"), F.countDistinct("module").alias("modules"))
    spread = F.when(F.col("impact_count") > 0, F.log1p("modules") * IMPACT_WEIGHTS["module_spread"]).otherwise(0.0)
    return c.withColumn("impact_score", F.log1p("impact_count") * IMPACT_WEIGHTS["impact_count"] + spread)
