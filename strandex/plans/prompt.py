"""Prompt assembly: blocks, policy, greedy budgets, symbol context and its layout.

Everything is a row-local expression over a planned task (see ``intent.plan_tasks``) or a few bounded joins for the
context of one request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import token_estimate, trim_to
from ..operators.order import numbered
from . import dimensions as d

BLOCK = "struct<role:string,content:string,priority:int,token_estimate:bigint,included:boolean,omit_reason:string,source:string>"
CONTEXT_SHARE = d.SHARES["context_placeholder"]


def _block(role: str, content: Column, priority: int, source: Column | str, included: Column | bool = True, omit: Column | str | None = None, tokens: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(priority).alias("priority"), (tokens if tokens is not None else token_estimate(content)).alias("token_estimate"), lit(included).alias("included"), lit(omit).cast("string").alias("omit_reason"), lit(source).alias("source")).cast(BLOCK)


def _lines(*parts: Column) -> Column:
    """Joins lines, leaving null ones out."""
    return F.concat_ws("\n", *parts)


def _numbered(xs: Column, indent: str = "") -> Column:
    return F.array_join(F.transform(xs, lambda x, i: F.concat(F.lit(indent), (i + 1).cast("string"), F.lit(". "), x)), "\n")


def rules_for(task_type: str, rules: list[tuple[int, str, list[str]]]) -> list[str]:
    """Texts of (priority, text, task types) rules that hold for a task type (no types: for all), by priority."""
    return [text for _, text, types in sorted(rules, key=lambda r: r[0]) if not types or task_type in types]


def policy_text(repo_policy: str = "", extra: list[tuple[int, str, list[str]]] | None = None, task_type: str = "") -> str:
    texts = rules_for(task_type, [*[(p, t, []) for p, t in d.RULES], *(extra or [])])
    parts = [f"REPOSITORY POLICY\n{repo_policy}"] * bool(repo_policy) + ["ADDITIONAL RULES\n" + "\n".join(f"- {t}" for t in texts)] * bool(texts)
    return "\n\n".join(parts)


def _contract(task_type: Column, lean: Column) -> Column:
    def text(t: str | None) -> Column:
        rows = d.contract_of(t)[1] if t else d.DEFAULT_CONTRACT[1]
        full = "OUTPUT FORMAT\nYour response must include all required fields below.\n\n" + "\n".join(f"{i}. {f}{'' if req else ' (optional)'}: {x}" for i, (f, x, req) in enumerate(rows, 1))
        short = "OUTPUT FORMAT (compact — required fields only)\n" + "\n".join(f"{i}. {f}: {x}" for i, (f, x) in enumerate([(f, x) for f, x, req in rows if req], 1))
        return F.when(lean, F.lit(short)).otherwise(F.lit(full))

    out = None
    for t in d.CONTRACTS:
        out = F.when(task_type == t, text(t)) if out is None else out.when(task_type == t, text(t))
    return out.otherwise(text(None))


def blocks(text: str = "text", context: Column | None = None, repo_policy: str = "", extra_rules: list[tuple[int, str, list[str]]] | None = None) -> Column:
    """The six blocks of a planned task, before the budget.  ``context``: retrieved text (null or none: a placeholder)."""
    lean = F.col("mode").isin("fast", "minimal")
    mode = F.create_map(*[F.lit(x) for kv in d.MODE_LINES.items() for x in kv])
    by_type = None
    for t in d.TASK_TYPES:
        p = F.lit(policy_text(repo_policy, extra_rules, t))
        by_type = F.when(F.col("task_type") == t, p) if by_type is None else by_type.when(F.col("task_type") == t, p)
    system = F.concat_ws("\n\n", F.lit(d.SYSTEM_POLICY), F.try_element_at(mode, F.col("mode")), F.nullif(by_type, F.lit("")))
    task = _lines(F.concat(F.lit("TASK: "), F.upper("task_type")), F.concat(F.lit("Subtype: "), "sub_type"), F.concat(F.lit("Goal: "), text), F.concat(F.lit("Scope: "), F.nullif("scope", F.lit(""))), F.concat(F.lit("Mode: "), "mode"), F.concat(F.lit("Risk level: "), "risk_level"))
    said = F.create_map(*[F.lit(x) for kv in d.CONSTRAINTS.items() for x in kv])
    rules = F.array_join(F.transform("constraints", lambda c: F.concat(F.lit("- "), F.coalesce(F.try_element_at(said, c), c))), "\n")
    some = F.size("constraints") > 0
    r = F.col("retrieval")
    hole = _lines(F.lit("CONTEXT"), F.concat(F.lit("Query: "), r["query"]), F.when(F.size(r["priority_categories"]) > 0, F.concat(F.lit("\nPriority context to provide:\n"), _numbered(r["priority_categories"], "  "))), F.when(F.size(r["excluded_targets"]) > 0, F.concat(F.lit("\nExclude: "), F.array_join(r["excluded_targets"], ", "))), F.lit("\n[Paste the relevant code, diffs, logs, or symbols here.]"))
    given = context if context is not None else F.lit(None).cast("string")
    v = F.col("verification")
    join = lambda xs, sep: F.nullif(F.array_join(xs, sep), F.lit(""))
    checks = _lines(F.lit("VERIFICATION REQUIREMENTS"), F.concat(F.lit("Required: "), join(v["required_checks"], ", ")), F.concat(F.lit("Acceptance: "), join(v["acceptance_criteria"], "; ")), F.concat(F.lit("Flag a warning if: "), join(v["warning_conditions"], "; ")))
    return F.array(
        _block("system", system, 10, "system_policy"),
        _block("task", task, 20, "task_normalization"),
        _block("constraints", F.when(some, F.concat(F.lit("CONSTRAINTS\n"), rules)).otherwise(F.lit("")), 30, F.when(some, "task_constraints").otherwise("none"), some),
        _block("context", F.coalesce(given, hole), 40, F.when(given.isNotNull(), "index_retrieval").otherwise("retrieval_plan_placeholder")),
        _block("output_contract", _contract(F.col("task_type"), lean), 50, F.concat(F.lit("contract/"), "task_type")),
        _block("verification", F.when(lean, F.lit("")).otherwise(checks), 60, F.when(lean, "mode_policy").otherwise("verification_plan"), ~lean, F.when(lean, F.lit("omitted in fast/minimal mode"))),
    )


def enforce(bs: Column, max_tokens: Column) -> Column:
    """Greedy budget by priority: a block that does not fit is left out and later ones may still fit.

    The running total skips what is left out, so this is a fold over the sorted blocks, not a prefix sum."""
    ranked = F.array_sort(F.transform(bs, lambda b, i: F.struct(b["priority"].alias("p"), i.alias("i"), b.alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<i:int,b:{BLOCK}>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        b, used = x["b"], acc["used"]
        fits = used + b["token_estimate"] <= max_tokens
        reason = F.concat(F.lit("budget exceeded ("), used.cast("string"), F.lit("/"), max_tokens.cast("string"), F.lit(" used)"))
        left_out = b.withField("included", F.lit(False)).withField("omit_reason", reason)
        new = F.when(b["included"] & ~fits, left_out).otherwise(b).cast(BLOCK)
        one = F.array(F.struct(x["i"].alias("i"), new.alias("b"))).cast(f"array<struct<i:int,b:{BLOCK}>>")
        return F.struct(F.when(b["included"] & fits, used + b["token_estimate"]).otherwise(used).cast("long").alias("used"), F.concat(acc["out"], one).alias("out"))

    return F.aggregate(ranked, start, step, lambda acc: F.transform(F.array_sort(acc["out"]), lambda x: x["b"]))


def greedy(items: Column, cap: Column) -> Column:
    """Indices (from 0) that a greedy pass over an array of token counts takes."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))
    pairs = F.transform(items, lambda t, i: F.struct(t.cast("long").alias("t"), i.alias("i")))
    step = lambda acc, x: F.when(acc["used"] + x["t"] <= cap, F.struct((acc["used"] + x["t"]).alias("used"), F.concat(acc["taken"], F.array(x["i"])).alias("taken"))).otherwise(acc)
    return F.aggregate(pairs, start, step, lambda acc: acc["taken"])


def _included(bs: Column) -> Column:
    ranked = F.array_sort(F.transform(F.filter(bs, lambda b: b["included"]), lambda b, i: F.struct(b["priority"].alias("p"), i.alias("i"), b.alias("b"))))
    return F.transform(ranked, lambda x: x["b"])


def compile_text(bs: Column) -> Column:
    return F.array_join(F.transform(_included(bs), lambda b: b["content"]), "\n\n")


def messages(bs: Column) -> Column:
    """array<struct<role, content>>: the system blocks, then the others; empty sides are left out."""
    part = lambda keep: F.array_join(F.transform(F.filter(_included(bs), keep), lambda b: b["content"]), "\n\n")
    both = F.array(F.struct(F.lit("system").alias("role"), part(lambda b: b["role"] == "system").alias("content")), F.struct(F.lit("user").alias("role"), part(lambda b: b["role"] != "system").alias("content")))
    return F.filter(both, lambda m: m["content"] != "")


def total_tokens(bs: Column) -> Column:
    return F.aggregate(F.filter(bs, lambda b: b["included"]), F.lit(0).cast("long"), lambda a, b: a + b["token_estimate"])


def budget_report(bs: Column, max_tokens: Column) -> Column:
    """Lines: tokens of each block in use, the total, and its share of the budget."""
    rows = F.transform(_included(bs), lambda b: F.format_string("  %-20s %5d tokens  [%s]", b["role"], b["token_estimate"], b["source"]))
    total = total_tokens(bs)
    tail = F.array(F.format_string("  %-20s %5d tokens", F.lit("TOTAL"), total), F.format_string("  Budget: %d/%d (%d%%)", total, max_tokens, F.floor(total / max_tokens * 100)))
    return F.array_join(F.concat(rows, tail), "\n")


def compression_summary(bs: Column, max_tokens: Column) -> Column:
    """Lines: what is in, what is out and why."""
    rows = F.transform(bs, lambda b: F.concat(F.format_string("  %s %-22s ~%4d tokens", F.when(b["included"], "✓").otherwise("✗"), b["role"], b["token_estimate"]), F.coalesce(F.concat(F.lit("  ["), b["omit_reason"], F.lit("]")), F.lit(""))))
    total = total_tokens(bs)
    return F.array_join(F.concat(rows, F.array(F.format_string("\n  Total: %d/%d tokens (%d%%)", total, max_tokens, F.floor(total / max_tokens * 100)))), "\n")


def compile_tasks(planned: DataFrame, text: str = "text", context: Column | None = None, repo_policy: str = "", extra_rules: list[tuple[int, str, list[str]]] | None = None) -> DataFrame:
    """Planned tasks plus ``blocks`` (budgeted), ``prompt`` and ``prompt_tokens``."""
    cap = F.col("budget.max_tokens").cast("long")
    out = planned.withColumn("blocks", blocks(text, context, repo_policy, extra_rules)).withColumn("blocks", enforce(F.col("blocks"), cap))
    return out.withColumn("prompt", compile_text(F.col("blocks"))).withColumn("prompt_tokens", total_tokens(F.col("blocks")))


def merge_by_priority(sources: list[DataFrame], key: str) -> DataFrame:
    """Union in priority order; of a key's rows, the one from the first source (then the smallest rank) stays.

    Each source has ``key`` and ``rank``; ``rank`` is assigned anew over the result."""
    rows = None
    for i, s in enumerate(sources):
        part = s.withColumn("_prio", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    first = Window.partitionBy(key).orderBy("_prio", "rank")
    kept = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").withColumnRenamed("rank", "_rank")
    return numbered(kept, [F.col("_prio"), F.col("_rank"), F.col(key)], "rank").drop("_prio", "_rank")


def attempts(query: str) -> list[str]:
    """The whole query, then its keywords: what a search tries in turn."""
    import re

    from ..functions.scalars import STOP_WORDS

    found = re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*", query)
    return [query] + [w for w in found if w.lower() not in STOP_WORDS and len(w) > 2]


def symbol_text() -> Column:
    """Layout of one symbol's context (a row of ``graph.context`` plus ``rank``)."""
    more = lambda c, n: F.concat(F.array_join(F.slice(c, 1, n), ", "), F.when(F.size(c) > n, F.concat(F.lit("  (+"), (F.size(c) - n).cast("string"), F.lit(" more)"))).otherwise(F.lit("")))
    row = lambda head, c, body: F.when(F.size(c) > 0, F.concat(F.lit(head), body))
    head = F.concat(F.lit("\n"), "name", F.lit("  ["), "kind", F.lit("]  "), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("–"), F.col("end_line").cast("string"), F.when(F.col("rank") > 0, F.concat(F.lit("  #rank:"), F.col("rank").cast("string"))).otherwise(F.lit("")))
    return _lines(
        head, F.concat(F.lit("  fqid:      "), F.nullif("fqid", F.lit(""))), F.concat(F.lit("  module:    "), F.nullif("module", F.lit(""))), row("  calls:     ", F.col("calls"), more(F.col("calls"), 8)), row("  called_by: ", F.col("called_by"), more(F.col("called_by"), 6)),
        row("  imports:   ", F.col("file_imports"), F.array_join(F.slice("file_imports", 1, 6), ", ")), row("  call graph:\n", F.col("callgraph"), F.array_join(F.transform(F.slice("callgraph", 1, 8), lambda h: F.concat(F.lit("    → "), h)), "\n")),
    )


def context_text(query: str, symbols: DataFrame, git_diff: str, max_tokens: int) -> str:
    """The context block of one request, trimmed to its share of the budget.  ``symbols``: at most a handful of rows."""
    rows = symbols.orderBy("rank").select(symbol_text().alias("t")).collect()
    if not rows and not git_diff:
        return f"CONTEXT\nQuery: {query}\n[No symbols found in index matching this query.]"
    bar = "─" * 60
    parts = [f"CONTEXT\nQuery: {query}\n"] + ([f"Symbols ({len(rows)} found):", bar, *[r["t"] for r in rows], bar] if rows else []) + (["", git_diff] if git_diff else [])
    cap, whole = int(max_tokens * CONTEXT_SHARE), "\n".join(parts)
    if max(1, len(whole) // 4) <= cap:
        return whole
    one = symbols.sparkSession.createDataFrame([(whole,)], "t string")
    return one.select(trim_to(F.col("t"), cap).alias("t")).first()["t"]


def symbol_limits(max_tokens: int, depth: int) -> tuple[int, int, int]:
    """(most symbols, depth of the first, depth of the others) of a budget."""
    depth = min(depth, 4)
    return (4 if max_tokens < 5000 else 7), depth, max(1, depth - 1)


