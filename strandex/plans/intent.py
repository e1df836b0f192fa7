"""Rule-based intent planning as column expressions: task type, subtype, mode, scope, constraints, plans.

Keyword tables have a fixed size, so they are unrolled into expressions: one pass over the texts, no join, no
shuffle, inside code generation.  The same expressions serve a table of a billion texts or one request.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dimensions as d

_SCOPE = r"\b(?:in|for|scope|module|service|package)\s+(?:the\s+)?([a-zA-Z_][a-zA-Z0-9_. /-]+)"


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _by(key: Column, table: dict, value, default) -> Column:
    """``table[key]`` as a chain of conditions; ``value`` makes the column of an entry."""
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, value(v)) if out is None or k == next(iter(table)) else out.when(key == k, value(v))
    return out.otherwise(default)


def needle(pattern: str) -> str:
    """The plain text that every match of a keyword pattern starts with."""
    head = re.match(r"(?:\\b)?([a-z0-9 ]*)(.?)", pattern)
    return head[1][:-1] if head[2] in "?*" and head[2] else head[1]


def _has(low: Column, pattern: str) -> Column:
    """Whether a pattern matches: a plain search for its first letters decides for most texts, and only others meet the regex."""
    return F.contains(low, F.lit(needle(pattern))) & low.rlike(pattern)


def task_scores(text: Column, keywords: dict | None = None) -> Column:
    """array<struct<task_type, raw, score>>, best first, ties in table order; score is relative to the best."""
    table = keywords or d.TASK_KEYWORDS
    low = F.lower(F.coalesce(text, F.lit("")))
    raw = [F.struct(F.lit(i).alias("i"), F.lit(t).alias("task_type"), sum((F.when(_has(low, p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in rows), F.lit(0.0)).alias("raw")) for i, (t, rows) in enumerate(table.items())]
    hit = F.filter(F.array(*raw), lambda x: x["raw"] > 0)

    def order(xs: Column) -> Column:
        best = F.array_max(F.transform(xs, lambda x: x["raw"]))
        ranked = F.array_sort(F.transform(xs, lambda x: F.struct((-(x["raw"] / best)).alias("k"), x["i"].alias("i"), x["task_type"].alias("task_type"), x["raw"].alias("raw"))))
        return F.transform(ranked, lambda x: F.struct(x["task_type"].alias("task_type"), x["raw"].alias("raw"), (-x["k"]).alias("score")))

    none = F.array(F.struct(F.lit(d.FALLBACK_TASK).alias("task_type"), F.lit(0.0).alias("raw"), F.lit(d.FALLBACK_SCORE).alias("score")))
    return F.get(F.transform(F.array(hit), lambda xs: F.when(F.size(xs) == 0, none).otherwise(order(xs))), F.lit(0))


def evidence(text: Column, task_type: Column, keywords: dict | None = None) -> Column:
    """The readable patterns of that task type that match, in table order."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def lines(rows) -> Column:
        said = [F.when(_has(low, p), F.lit("'" + p.replace(r"\b", "").replace(r"\w*", "…") + f"' → {w:.1f}")) for p, w in rows]
        return F.array_compact(F.array(*said))

    return _by(task_type, keywords or d.TASK_KEYWORDS, lines, F.array().cast("array<string>"))


def _heaviest(low: Column, rows: list[tuple[str, str, float]]) -> Column:
    """The value of the heaviest pattern that matches, the earliest of equal ones; null without a match."""
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][2], i))
    return F.coalesce(*[F.when(_has(low, rows[i][0]), F.lit(rows[i][1])) for i in order], F.lit(None).cast("string"))


def subtype(text: Column, task_type: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return _by(task_type, d.SUBTYPE_KEYWORDS, lambda rows: _heaviest(low, rows), F.lit(None).cast("string"))


def mode_in(text: Column) -> Column:
    return _heaviest(F.lower(F.coalesce(text, F.lit(""))), d.MODE_KEYWORDS)


def scope_in(text: Column) -> Column:
    """The first quoted text, else what follows in, for, scope, module, service or package."""
    quoted = F.nullif(F.regexp_extract(text, '"([^"]+)"', 1), F.lit(""))
    return F.coalesce(quoted, F.nullif(F.trim(F.regexp_extract(text, _SCOPE, 1)), F.lit("")))


def constraints(task_type: Column, mode: Column, extra: Column | None = None) -> Column:
    """Those of the task type, then of the mode, then extra ones; the first of repeats stays."""
    parts = [_by(task_type, d.DEFAULT_CONSTRAINTS, _texts, _texts([])), _by(mode, d.MODE_CONSTRAINTS, _texts, _texts([]))]
    return F.array_distinct(F.concat(*parts, *([F.coalesce(extra, _texts([]))] if extra is not None else [])))


def budget(mode: Column) -> Column:
    """struct<max_tokens, retrieval_depth, summary_depth, output_verbosity> of a mode."""
    one = lambda b: F.struct(F.lit(b[0]).alias("max_tokens"), F.lit(b[1]).alias("retrieval_depth"), F.lit(b[2]).alias("summary_depth"), F.lit(b[3]).alias("output_verbosity"))
    return _by(mode, d.MODE_BUDGETS, one, one(d.DEFAULT_BUDGET))


def allocation(max_tokens: Column) -> Column:
    """struct with the whole tokens of each section."""
    return F.struct(*[F.floor(max_tokens * F.lit(s)).cast("long").alias(k) for k, s in d.SHARES.items()])


def retrieval_plan(task_type: Column, query: Column) -> Column:
    return F.struct(
        query.alias("query"), _by(task_type, d.PRIORITIES, _texts, _texts(d.DEFAULT_PRIORITIES)).alias("priority_categories"), _by(task_type, d.EXCLUDED, _texts, _texts([])).alias("excluded_targets"),
        task_type.isin(d.GIT_HISTORY).alias("git_history"), task_type.isin(d.CALL_CHAINS).alias("include_call_chains"),
    )


def verification_plan(task_type: Column) -> Column:
    return F.struct(
        _by(task_type, d.CHECKS, _texts, _texts(d.DEFAULT_CHECKS)).alias("required_checks"), _texts(d.OPTIONAL_CHECKS).alias("optional_checks"),
        _by(task_type, d.WARNINGS, _texts, _texts(d.DEFAULT_WARNINGS)).alias("warning_conditions"), F.array(F.concat(F.lit("output matches "), task_type, F.lit(" contract"))).alias("acceptance_criteria"),
    )


def plan_tasks(df: DataFrame, text: str = "text", task_hint: str | None = None, mode_hint: str | None = None, scope_hint: str | None = None, extra: list[str] | None = None, preserve_api: bool = False, no_tests: bool = False, keywords: dict | None = None) -> DataFrame:
    """``df`` plus the whole plan of each text: hints go before the text, the text before defaults."""
    raw = F.coalesce(F.col(text), F.lit(""))
    # a generator keeps the optimizer from evaluating the scores once for every column that uses them
    out = df.select("*", F.explode(F.array(task_scores(raw, keywords))).alias("candidates"))
    top = F.get("candidates", F.lit(0))
    out = out.withColumn("task_type", F.lit(task_hint) if task_hint else top["task_type"])
    out = out.withColumn("confidence", F.lit(1.0) if task_hint else F.least(top["score"], F.lit(1.0)))
    found = mode_in(raw)
    default = _by(F.col("task_type"), d.DEFAULT_MODES, F.lit, F.lit("surgical"))
    out = out.withColumn("sub_type", subtype(raw, F.col("task_type"))).withColumn("mode", F.lit(mode_hint) if mode_hint else F.coalesce(found, default))
    source = F.lit("' set by flag") if mode_hint else F.when(found.isNotNull(), F.lit("' detected in text")).otherwise(F.concat(F.lit("' is default for "), "task_type"))
    forced = F.array(F.lit(f"task_type forced by CLI verb: {task_hint}")) if task_hint else _texts([])
    nothing = F.array(F.lit("no keyword match — defaulting to bugfix"))
    said = evidence(raw, F.col("task_type"), keywords)
    said = said if task_hint else F.when(top["raw"] > 0, said).otherwise(nothing)
    out = out.withColumn("evidence", F.concat(forced, said, F.array(F.concat(F.lit("mode '"), "mode", source))))
    out = out.withColumn("scope", F.lit(scope_hint) if scope_hint else scope_in(raw))
    more = [*(extra or []), *(["preserve_public_api"] if preserve_api else [])]
    chosen = constraints(F.col("task_type"), F.col("mode"), _texts(more))
    out = out.withColumn("constraints", F.array_remove(chosen, "require_tests") if no_tests else chosen)
    out = out.withColumn("risk_level", _by(F.col("task_type"), d.RISK, F.lit, F.lit("medium"))).withColumn("budget", budget(F.col("mode")))
    out = out.withColumn("retrieval", retrieval_plan(F.col("task_type"), F.coalesce(F.nullif("scope", F.lit("")), raw)))
    return out.withColumn("verification", verification_plan(F.col("task_type"))).withColumn("candidates", F.slice("candidates", 1, 3))
