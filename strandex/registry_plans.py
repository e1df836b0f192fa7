"""Queries of the planner over the driver's tables, and their SQL (made from the same dimension tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binding as b
from .plans import contracts, intent, prompt
from .plans import dimensions as d
from .sources import git

#: Requests that the texts of conversations are completed with, by remainder of conversation and turn.
REQUESTS = ["Fix the duplicate webhook event in billing", 'Add a new api endpoint for "invoice export"', "refactor: split and simplify the parser module", "why is the worker slow and intermittent? quick look", "Write tests for retry and timeout in the queue service", "security audit: xss injection in login", "", "explain how does the cache work, thorough please"]


def _requests(s: SparkSession, sf: str) -> DataFrame:
    said = F.array(*[F.lit(r) for r in REQUESTS])
    text = F.concat(F.get(said, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(REQUESTS))).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    return b.table(s, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("request"), text.alias("text"))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Word boundaries are those of Unicode letters; the SQL dialect's are ASCII, so other letters become underscores there.
_REQ = f"req AS (SELECT conv_id || '/' || turn AS request, [{', '.join(_q(r) for r in REQUESTS)}][1 + ((conv_id + turn) % {len(REQUESTS)})::INTEGER] || ' ' || coalesce(text, '') AS text FROM conversations), low AS (SELECT *, regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\x00-\\x7F]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g') AS t FROM req)"
_RAW = "raw AS (" + " UNION ALL ".join(f"SELECT request, {i} AS i, {_q(t)} AS task_type, " + " + ".join(f"CASE WHEN regexp_matches(t, {_q(p)}) THEN {w}::DOUBLE ELSE 0::DOUBLE END" for p, w in rows) + " AS raw FROM low" for i, (t, rows) in enumerate(d.TASK_KEYWORDS.items())) + ")"
_TOP = "top AS (SELECT r.request, arg_max(task_type, struct_pack(k := round(raw, 6), j := -i)) FILTER (WHERE raw > 0) AS best, max(raw) AS raw FROM raw r GROUP BY 1)"


def _pick_sql(rows: list[tuple[str, str, float]]) -> str:
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][2], i))
    return "CASE " + " ".join(f"WHEN regexp_matches(t, {_q(rows[i][0])}) THEN {_q(rows[i][1])}" for i in order) + " END"


_SUB = "CASE coalesce(best, 'bugfix') " + " ".join(f"WHEN {_q(t)} THEN {_pick_sql(rows)}" for t, rows in d.SUBTYPE_KEYWORDS.items()) + " END"
_MODE = f"coalesce({_pick_sql(d.MODE_KEYWORDS)}, CASE coalesce(best, 'bugfix') " + " ".join(f"WHEN {_q(t)} THEN {_q(m)}" for t, m in d.DEFAULT_MODES.items()) + " ELSE 'surgical' END)"
_SCOPE = r"""coalesce(nullif(regexp_extract(text, '"([^"]+)"', 1), ''), nullif(trim(regexp_extract(text, '(?:^|[^\p{L}\p{N}_])(?:in|for|scope|module|service|package)\s+(?:the\s+)?([a-zA-Z_][a-zA-Z0-9_. /-]+)', 1)), ''))"""


def _classify(s: SparkSession, sf: str) -> DataFrame:
    return intent.plan_tasks(_requests(s, sf)).select("request", "task_type", "sub_type", "mode", "scope", F.round(F.get("candidates", F.lit(0))["raw"], 6).alias("raw"))


def _items(s: SparkSession, sf: str) -> DataFrame:
    c = b.table(s, sf, "conversations").select("conv_id", "turn", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("tokens"))
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "tokens"))), lambda x: x["tokens"]).alias("tokens"))


CHECKED = ("test_generation", "debugging", "explanation")
_OUTPUTS = ('{"coverage_plan":"a","fixtures":"b","tests":"c"}', '{"summary":"a","key_concepts":"b","data_flow":"c","gotchas":"d"}')


def validated_events(s: SparkSession, sf: str) -> DataFrame:
    """Outputs made of events, validated: the type alternates the contract, the remainder the fields.  ``event_id, ts, task_type, output, v``."""
    e = b.table(s, sf, "events")
    task = F.get(F.array(*[F.lit(t) for t in CHECKED]), F.pmod("event_id", F.lit(3)).cast("int"))
    out = F.when(F.col("event_id") % 5 == 0, F.lit(_OUTPUTS[0])).when(F.col("event_id") % 5 == 1, F.lit(_OUTPUTS[1])).otherwise(F.col("props"))
    return e.select("event_id", "ts", task.alias("task_type"), out.alias("output")).withColumn("v", contracts.validate(F.col("task_type"), F.col("output"), True))


def _validated(s: SparkSession, sf: str) -> DataFrame:
    return validated_events(s, sf).select("event_id", "v.is_valid", F.array_join("v.missing_required", ",").alias("missing"), F.array_join("v.unknown_fields", ",").alias("unknown"))


def contract_parts() -> str:
    """SQL up to a table x: events with their output, its keys, the contract's fields, and what is missing (m) or unknown (u)."""
    rows = [(t, f, req) for t in CHECKED for f, _, req in d.CONTRACTS[t]]
    values = ", ".join(f"({_q(t)}, {_q(f)}, {req})" for t, f, req in rows)
    return f"""WITH c(task_type, field, req) AS (VALUES {values}),
n AS (SELECT task_type, list(field) FILTER (WHERE req) AS need, list(field) AS may FROM c GROUP BY 1),
e AS (SELECT event_id, ts, ['test_generation', 'debugging', 'explanation'][1 + (event_id % 3)::INTEGER] AS task_type, CASE event_id % 5 WHEN 0 THEN '{_OUTPUTS[0]}' WHEN 1 THEN '{_OUTPUTS[1]}' ELSE props END AS output FROM events),
o AS (SELECT *, json_keys(output) AS keys FROM e),
x AS (SELECT o.*, need, may, list_sort(list_filter(need, lambda f: NOT list_contains(keys, f))) AS m, list_sort(list_filter(keys, lambda f: NOT list_contains(may, f))) AS u FROM o JOIN n USING (task_type))"""


def _contract_sql() -> str:
    return contract_parts() + " SELECT event_id, len(m) = 0 AND len(u) = 0 AS is_valid, array_to_string(m, ',') AS missing, array_to_string(u, ',') AS unknown FROM x"


def _fields_sql() -> str:
    rows = [f"({_q(t)}, {i}, {_q(f)}, {req}, {_q(text)})" for t in d.TASK_TYPES for i, (f, text, req) in enumerate(d.CONTRACTS.get(t, d.DEFAULT_CONTRACT[1]))]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(task_type, ordinal, field, required, description)"


def _merged(s: SparkSession, sf: str) -> DataFrame:
    p = b.table(s, sf, "part")
    a = p.where("p_partkey % 7 = 0").select("p_name", F.col("p_partkey").alias("rank"))
    c = p.where("p_partkey % 3 = 0").select("p_name", F.col("p_partkey").alias("rank"))
    return prompt.merge_by_priority([a, c, p.select("p_name", F.col("p_partkey").alias("rank"))], "p_name").select("p_name", F.col("rank").cast("long").alias("rank"))


def _prompts(s: SparkSession, sf: str) -> DataFrame:
    out = prompt.compile_tasks(intent.plan_tasks(_requests(s, sf)))
    return out.select("request", "task_type", "mode", "prompt_tokens", F.size(F.filter("blocks", lambda x: x["included"])).alias("n_blocks"), F.sha1(F.col("prompt").cast("binary")).alias("digest"))


def _list(xs: list[str]) -> str:
    return f"[{', '.join(_q(x) for x in xs)}]::VARCHAR[]"


def _pick(key: str, table: dict, value: Callable, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {value(v)}" for k, v in table.items()) + f" ELSE {default} END"


#: Planned tasks: type, subtype, mode, scope and constraints, the first of repeats in place.
_PLANNED = f"""pl AS (SELECT request, text, coalesce(best, 'bugfix') AS task_type, {_SUB} AS sub_type, {_MODE} AS mode, {_SCOPE} AS scope FROM low JOIN top USING (request)),
al AS (SELECT *, list_concat({_pick('task_type', d.DEFAULT_CONSTRAINTS, _list, _list([]))}, {_pick('mode', d.MODE_CONSTRAINTS, _list, _list([]))}) AS everything FROM pl),
cs AS (SELECT *, list_filter(everything, lambda x, i: list_position(everything, x) = i) AS constraints FROM al)"""


def _prompt_sql() -> str:
    """The whole prompt: six blocks, the greedy budget in order of priority, and the text that is left."""
    nl = "chr(10)"
    text = lambda x: _q(x).replace("\n", "' || chr(10) || '")
    numbered = lambda xs, pad="": "\n".join(f"{pad}{i}. {x}" for i, x in enumerate(xs, 1))
    hole = lambda t: "\n\nPriority context to provide:\n" + numbered(d.PRIORITIES.get(t, d.DEFAULT_PRIORITIES), "  ") + (f"\n\nExclude: {', '.join(d.EXCLUDED[t])}" if t in d.EXCLUDED else "") + "\n\n[Paste the relevant code, diffs, logs, or symbols here.]"
    rows = lambda t: d.CONTRACTS.get(t, d.DEFAULT_CONTRACT[1])
    full = lambda t: "OUTPUT FORMAT\nYour response must include all required fields below.\n\n" + "\n".join(f"{i}. {f}{'' if req else ' (optional)'}: {x}" for i, (f, x, req) in enumerate(rows(t), 1))
    short = lambda t: "OUTPUT FORMAT (compact — required fields only)\n" + numbered([f"{f}: {x}" for f, x, req in rows(t) if req])
    checks = lambda t: f"VERIFICATION REQUIREMENTS\nRequired: {', '.join(d.CHECKS.get(t, d.DEFAULT_CHECKS))}\nAcceptance: output matches {t} contract\nFlag a warning if: {'; '.join(d.WARNINGS.get(t, d.DEFAULT_WARNINGS))}"
    by_type = lambda make: "CASE task_type " + " ".join(f"WHEN {_q(t)} THEN {text(make(t))}" for t in d.TASK_TYPES) + " END"
    rules = "ADDITIONAL RULES\n" + "\n".join(f"- {x}" for _, x in sorted(d.RULES, key=lambda r: r[0]))
    said = _pick("c", d.CONSTRAINTS, text, "c")
    budget = _pick("mode", d.MODE_BUDGETS, lambda x: str(x[0]), str(d.DEFAULT_BUDGET[0]))
    risk = _pick("task_type", d.RISK, _q, "'medium'")
    parts = [
        f"{text(d.SYSTEM_POLICY)} || chr(10) || chr(10) || {_pick('mode', d.MODE_LINES, lambda x: text(x + chr(10) + chr(10)), _q(''))} || {text(rules)}",
        f"'TASK: ' || upper(task_type) || coalesce({nl} || 'Subtype: ' || sub_type, '') || {nl} || 'Goal: ' || text || coalesce({nl} || 'Scope: ' || nullif(scope, ''), '') || {nl} || 'Mode: ' || mode || {nl} || 'Risk level: ' || {risk}",
        f"CASE WHEN len(constraints) > 0 THEN 'CONSTRAINTS' || {nl} || array_to_string(list_transform(constraints, lambda c: '- ' || {said}), {nl}) ELSE '' END",
        f"'CONTEXT' || {nl} || 'Query: ' || coalesce(nullif(scope, ''), text) || {by_type(hole)}",
        f"CASE WHEN mode IN ('fast', 'minimal') THEN {by_type(short)} ELSE {by_type(full)} END",
        f"CASE WHEN mode IN ('fast', 'minimal') THEN '' ELSE {by_type(checks)} END",
    ]
    wanted = ["true", "true", "len(constraints) > 0", "true", "true", "mode NOT IN ('fast', 'minimal')"]
    steps, before = [f"b AS (SELECT request, task_type, mode, constraints, {budget} AS cap, " + ", ".join(f"{p} AS x{i}" for i, p in enumerate(parts)) + " FROM cs)", "u0 AS (SELECT *, 0::BIGINT AS used0 FROM b)"], "u0"
    for i, w in enumerate(wanted):
        size = f"greatest(1, length(x{i}) // 4)"
        steps.append(f"u{i + 1} AS (SELECT *, ({w}) AND used{i} + {size} <= cap AS in{i}, used{i} + CASE WHEN ({w}) AND used{i} + {size} <= cap THEN {size} ELSE 0 END AS used{i + 1} FROM {before})")
        before = f"u{i + 1}"
    kept = ", ".join(f"CASE WHEN in{i} THEN x{i} END" for i in range(6))
    count = " + ".join(f"in{i}::INTEGER" for i in range(6))
    return f"WITH {_REQ}, {_RAW}, {_TOP}, {_PLANNED}, {', '.join(steps)} SELECT request, task_type, mode, used6::BIGINT AS prompt_tokens, ({count})::INTEGER AS n_blocks, sha1(array_to_string(list_filter([{kept}], lambda x: x IS NOT NULL), chr(10) || chr(10))) AS digest FROM u6"


_SHARES = ", ".join(f"floor(turn * 1000 * {s}::DOUBLE)::BIGINT AS {k}" for k, s in d.SHARES.items())

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "intent_classify": (_classify, f"WITH {_REQ}, {_RAW}, {_TOP} SELECT request, coalesce(best, 'bugfix') AS task_type, {_SUB} AS sub_type, {_MODE} AS mode, {_SCOPE} AS scope, round(raw, 6) AS raw FROM low JOIN top USING (request)"),
    "task_scores": (lambda s, sf: _requests(s, sf).select("request", F.explode(intent.task_scores(F.col("text"))).alias("c")).where("c.raw > 0").select("request", "c.task_type", F.round("c.score", 6).alias("score")), f"WITH {_REQ}, {_RAW} SELECT request, task_type, round(raw / max(raw) OVER (PARTITION BY request), 6) AS score FROM raw WHERE raw > 0"),
    "constraint_sets": (lambda s, sf: intent.plan_tasks(_requests(s, sf)).select("request", F.array_join("constraints", ",").alias("constraints")), f"WITH {_REQ}, {_RAW}, {_TOP}, {_PLANNED} SELECT request, array_to_string(constraints, ',') AS constraints FROM cs"),
    "prompt_compile": (_prompts, _prompt_sql()),
    "budget_greedy": (lambda s, sf: _items(s, sf).select("conv_id", F.array_join(prompt.greedy(F.col("tokens"), F.lit(200)).cast("array<string>"), ",").alias("taken")), """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, greatest(1, length(text) // 4)::BIGINT AS n FROM conversations),
g AS (SELECT conv_id, 0::BIGINT AS i, CASE WHEN n <= 200 THEN n ELSE 0 END AS used, CASE WHEN n <= 200 THEN ['0'] ELSE [] END AS taken FROM t WHERE i = 0
UNION ALL SELECT g.conv_id, t.i, CASE WHEN used + n <= 200 THEN used + n ELSE used END, CASE WHEN used + n <= 200 THEN list_append(taken, t.i::VARCHAR) ELSE taken END FROM g JOIN t ON t.conv_id = g.conv_id AND t.i = g.i + 1)
SELECT conv_id, array_to_string(arg_max(taken, i), ',') AS taken FROM g GROUP BY conv_id"""),
    "budget_allocation": (lambda s, sf: b.table(s, sf, "conversations").select("turn").distinct().select("turn", intent.allocation(F.col("turn") * 1000).alias("a")).select("turn", "a.*"), f"SELECT DISTINCT turn, {_SHARES} FROM conversations"),
    "contract_validate": (_validated, _contract_sql()),
    "contract_fields": (lambda s, sf: contracts.contracts_table(s), _fields_sql()),
    "priority_merge": (_merged, """WITH r AS (SELECT p_name, CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS prio, p_partkey AS k FROM part),
f AS (SELECT p_name, min(struct_pack(prio := prio, k := k)) AS m FROM r GROUP BY p_name) SELECT p_name, row_number() OVER (ORDER BY m, p_name) AS rank FROM f"""),
    "ordered_dedup": (lambda s, sf: git.first_of_each(b.table(s, sf, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("pos")), "name").select("name", F.col("pos").alias("first")), "SELECT event_type AS name, min(event_id) AS first FROM events GROUP BY 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
