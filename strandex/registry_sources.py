"""Queries of extraction, the store, file events, diffs and contracts over the driver's tables, and their SQL.

Every part becomes a small source file of each language, so what an extractor must find follows from the part's key and name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binding as b
from .functions import scalars
from .operators.graph import cut, shared_folder
from .plans import contracts
from .registry_plans import contract_parts, validated_events
from .sources import files, git
from .sources.store import Store
from .streaming import watch

#: Sources of a part: ``{k}`` is its key, ``{n}`` its name with underscores, ``{m}`` its key modulo 3.
PYTHON = 'import os.path as osp\nfrom pkg.m{k} import make as mk{k}\n\nclass {n}_{k}(Base{m}):\n    def run(self):\n        self.step({k})\n        osp.join("a")\n        mk{k}()\n\ndef top_{k}():\n    {n}_{k}().run()\n'
GO = 'package main\n\nimport "fmt"\nimport (\n    g{k} "example.com/x/m{k}"\n    "os"\n)\n\ntype T{k} struct {\n    name string\n}\n\nfunc (s *T{k}) Run() error {\n    s.load({k})\n    fmt.Println("x")\n    return nil\n}\n\nfunc main() {\n    helper{k}()\n}\n'
JAVASCRIPT = "import React, { useState as st{k} } from 'react';\nimport * as fs from \"fs\";\n\nexport function main{k}(a) {\n  helper(new Thing());\n  api.get(a);\n}\n\nclass Box{k} extends Base {\n  onTap = (e) => { tap(e); };\n  render() {\n    return draw({k});\n  }\n}\n"
TYPESCRIPT = "interface IBtn{k} {\n  click(): void;\n}\nclass Svc{k} implements IBtn{k} {\n  private getUser(id: number): User { return load(id); }\n}\nfunction run{k}<T>(p: P): void { go{k}(p); }\n"

#: What must be found: (fact, name, detail, first line, last line).
FACTS = {
    "python": [("symbol", "<module>", "module|src.p{k}|", 0, 0), ("symbol", "{n}_{k}", "class|src.p{k}.{n}_{k}|", 4, 8), ("symbol", "run", "method|src.p{k}.{n}_{k}.run|{n}_{k}", 5, 8), ("symbol", "top_{k}", "function|src.p{k}.top_{k}|", 10, 11),
               ("relation", "<module>", "IMPORTS|os.path|", 0, 0), ("relation", "<module>", "IMPORTS|pkg.m{k}|", 0, 0), ("relation", "{n}_{k}", "INHERITS|Base{m}|", 0, 0), ("relation", "run", "DEFINES|{n}_{k}|", 0, 0),
               ("relation", "run", "CALLS|step|self.step", 0, 0), ("relation", "run", "CALLS|join|osp.join", 0, 0), ("relation", "run", "CALLS|mk{k}|mk{k}", 0, 0), ("relation", "top_{k}", "CALLS|run|run", 0, 0), ("relation", "top_{k}", "CALLS|{n}_{k}|{n}_{k}", 0, 0),
               ("alias", "osp", "os.path", 0, 0), ("alias", "mk{k}", "pkg.m{k}.make", 0, 0)],
    "go": [("symbol", "<module>", "module|src.p{k}|", 0, 0), ("symbol", "T{k}", "class|src.p{k}.T{k}|", 9, 11), ("symbol", "Run", "method|src.p{k}.T{k}.Run|T{k}", 13, 17), ("symbol", "main", "function|src.p{k}.main|", 19, 21),
           ("relation", "<module>", "IMPORTS|fmt|", 0, 0), ("relation", "<module>", "IMPORTS|example.com/x/m{k}|", 0, 0), ("relation", "<module>", "IMPORTS|os|", 0, 0), ("relation", "Run", "CALLS|load|s.load", 0, 0), ("relation", "Run", "CALLS|Println|fmt.Println", 0, 0), ("relation", "main", "CALLS|helper{k}|helper{k}", 0, 0),
           ("alias", "fmt", "fmt", 0, 0), ("alias", "g{k}", "example.com/x/m{k}", 0, 0), ("alias", "os", "os", 0, 0)],
    "javascript": [("symbol", "<module>", "module|src.p{k}|", 0, 0), ("symbol", "main{k}", "function|src.p{k}.main{k}|", 4, 7), ("symbol", "Box{k}", "class|src.p{k}.Box{k}|", 9, 14), ("symbol", "render", "method|src.p{k}.Box{k}.render|Box{k}", 11, 13),
                   ("relation", "<module>", "IMPORTS|react|", 0, 0), ("relation", "<module>", "IMPORTS|fs|", 0, 0), ("relation", "main{k}", "CALLS|helper|helper", 0, 0), ("relation", "main{k}", "CALLS|get|api.get", 0, 0), ("relation", "Box{k}", "CALLS|tap|tap", 0, 0), ("relation", "render", "CALLS|draw|draw", 0, 0),
                   ("alias", "st{k}", "react.useState", 0, 0), ("alias", "React", "react.default", 0, 0), ("alias", "fs", "fs", 0, 0)],
    "typescript": [("symbol", "IBtn{k}", "class|src.p{k}.IBtn{k}|", 1, 3), ("symbol", "Svc{k}", "class|src.p{k}.Svc{k}|", 4, 6), ("symbol", "getUser", "method|src.p{k}.Svc{k}.getUser|Svc{k}", 5, 5), ("symbol", "run{k}", "function|src.p{k}.run{k}|", 7, 7),
                   ("relation", "getUser", "CALLS|load|load", 0, 0), ("relation", "run{k}", "CALLS|go{k}|go{k}", 0, 0)],
}
SOURCES = {"python": (PYTHON, ".py"), "go": (GO, ".go"), "javascript": (JAVASCRIPT, ".js"), "typescript": (TYPESCRIPT, ".ts")}
EXTRA = "\ndef extra_{k}():\n    pass\n"


def _filled(text: str) -> Column:
    out = F.lit(text)
    for mark, value in (("{k}", F.col("p_partkey").cast("string")), ("{m}", (F.col("p_partkey") % 3).cast("string")), ("{n}", F.translate("p_name", " ", "_"))):
        out = F.replace(out, F.lit(mark), value)
    return out


def _filled_sql(text: str) -> str:
    quoted = "'" + text.replace("'", "''") + "'"
    return f"replace(replace(replace({quoted}, '{{k}}', p_partkey::VARCHAR), '{{m}}', (p_partkey % 3)::VARCHAR), '{{n}}', replace(p_name, ' ', '_'))"


def _sources(parts: DataFrame, language: str, more: Column | None = None) -> DataFrame:
    text, ending = SOURCES[language]
    source = F.concat(_filled(text), more) if more is not None else _filled(text)
    rows = parts.select(_filled("src/p{k}" + ending).alias("path"), source.alias("source"))
    return rows.select("path", "source", scalars.content_hash(F.col("source")).alias("content_hash"), scalars.language_of(F.col("path")).alias("language"))


def _extracted(s: SparkSession, d: str, language: str) -> DataFrame:
    sources = _sources(b.table(s, d, "part"), language)
    t = files.tables(sources, cut(files.extract_files(sources)))
    names = t["symbols"].select(F.col("id").alias("of"), F.col("name").alias("of_name"))
    row = lambda df, fact, name, detail, a, z: df.select("file_path", F.lit(fact).alias("fact"), F.col(name).alias("name"), F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in detail]).alias("detail"), a.alias("first_line"), z.alias("last_line"))
    none = F.lit(0)
    symbols = t["symbols"].join(names, F.col("owner_symbol_id") == F.col("of"), "left")
    relations = t["relations"].join(names, F.col("from_id") == F.col("of"))
    out = row(symbols, "symbol", "name", [F.col("kind"), F.col("fqid"), F.col("of_name")], F.col("start_line"), F.col("end_line"))
    out = out.unionByName(row(relations, "relation", "of_name", [F.col("relation"), F.col("to_name"), F.col("call_expression")], none, none))
    return out.unionByName(row(t["import_aliases"], "alias", "alias", [F.col("resolved_fqid")], none, none))


def _extracted_sql(language: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {_filled_sql('src/p{k}' + SOURCES[language][1])} AS file_path, '{fact}' AS fact, {_filled_sql(name)} AS name, {_filled_sql(detail)} AS detail, {a} AS first_line, {z} AS last_line FROM part" for fact, name, detail, a, z in FACTS[language])
    return rows


def _updated(s: SparkSession, d: str) -> tuple[Store, dict]:
    """A store after two builds: parts whose key is no multiple of 10, then those of no multiple of 7, of which multiples of 5 changed."""
    part = b.table(s, d, "part")
    store = Store(s, f"{shared_folder(s)}/index-{uuid.uuid4().hex}")
    store.update(_sources(part.where("p_partkey % 10 <> 0"), "python"), "main", 1000)
    more = F.when(F.col("p_partkey") % 5 == 0, _filled(EXTRA)).otherwise(F.lit(""))
    stats = store.update(_sources(part.where("p_partkey % 7 <> 0"), "python", more), "topic", 2000)
    store.resolve()
    return store, stats


def _store_tables(s: SparkSession, d: str) -> DataFrame:
    """Files, symbols and the links of calls from functions after both builds."""
    store, _ = _updated(s, d)
    symbols, relations = store.table("symbols"), store.table("relations")
    row = lambda df, fact, a, x, y: df.select(F.lit(fact).alias("fact"), a.alias("file_path"), x.alias("name"), y.cast("string").alias("value"))
    ends = symbols.select(F.col("id").alias("to_symbol_id"), F.col("file_path").alias("target"))
    calls = relations.where("relation = 'CALLS'").join(symbols.where("kind = 'function'").select(F.col("id").alias("from_id"), "file_path"), "from_id").join(ends, "to_symbol_id")
    out = row(store.table("files"), "file", F.col("path"), F.concat_ws("|", "branch", "language"), F.col("last_indexed_at"))
    out = out.unionByName(row(symbols, "symbol", F.col("file_path"), F.col("name"), F.col("kind")))
    return out.unionByName(row(calls, "link", F.col("file_path"), F.concat_ws("|", "to_name", "target"), F.col("confidence")))


_STORE = f"""WITH p AS (SELECT *, {_filled_sql('src/p{k}.py')} AS file_path FROM part WHERE p_partkey % 7 <> 0), a AS (SELECT min(file_path) AS first FROM p)
SELECT 'file' AS fact, file_path, 'topic|python' AS name, '2000' AS value FROM p
UNION ALL SELECT 'symbol', file_path, '<module>', 'module' FROM p UNION ALL SELECT 'symbol', file_path, {_filled_sql('{n}_{k}')}, 'class' FROM p UNION ALL SELECT 'symbol', file_path, 'run', 'method' FROM p
UNION ALL SELECT 'symbol', file_path, {_filled_sql('top_{k}')}, 'function' FROM p UNION ALL SELECT 'symbol', file_path, {_filled_sql('extra_{k}')}, 'function' FROM p WHERE p_partkey % 5 = 0
UNION ALL SELECT 'link', file_path, 'run|' || first, CASE WHEN (SELECT count(*) FROM p) > 1 THEN '0.5' ELSE '0.7' END FROM p, a UNION ALL SELECT 'link', file_path, {_filled_sql('{n}_{k}')} || '|' || file_path, '0.7' FROM p"""


def _store_counters(s: SparkSession, d: str) -> DataFrame:
    _, stats = _updated(s, d)
    names = ("scanned", "indexed", "skipped", "removed", "errors", "symbols_added", "relations_added")
    return s.createDataFrame([tuple(int(stats[n]) for n in names)], ", ".join(f"{n} long" for n in names))


_COUNTERS = """SELECT count(*) FILTER (WHERE k % 7 <> 0) AS scanned, count(*) FILTER (WHERE k % 7 <> 0 AND k % 5 = 0) AS indexed, count(*) FILTER (WHERE k % 7 <> 0 AND k % 5 <> 0) AS skipped, count(*) FILTER (WHERE k % 7 = 0 AND k % 10 <> 0) AS removed, 0 AS errors,
5 * count(*) FILTER (WHERE k % 7 <> 0 AND k % 5 = 0) AS symbols_added, 9 * count(*) FILTER (WHERE k % 7 <> 0 AND k % 5 = 0) AS relations_added FROM (SELECT p_partkey AS k FROM part)"""


def _upserted(s: SparkSession, d: str) -> DataFrame:
    """The last event of each user: even ids are known, odd ones come in."""
    from .streaming import incremental

    e = b.table(s, d, "events").select("user_id", "event_id", "event_type")
    return incremental.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["event_id"])


def _actions(s: SparkSession, d: str) -> DataFrame:
    """What is to be done after events of files are filtered and bursts collapse: kinds by event type, paths by user."""
    kinds = F.create_map(*[F.lit(x) for kv in {"signup": "CREATED", "view": "MODIFIED", "click": "MODIFIED", "error": "DELETED", "purchase": "MOVED"}.items() for x in kv])
    user, ending = F.col("user_id").cast("string"), F.when(F.col("user_id") % 3 == 0, ".txt").otherwise(".py")
    dest = F.when(F.col("event_type") == "purchase", F.concat(F.lit("moved/u"), user, F.when(F.col("event_id") % 2 == 0, ".go").otherwise(".md")))
    e = b.table(s, d, "events").select(F.try_element_at(kinds, F.col("event_type")).alias("kind"), F.concat(F.lit("u"), user, ending).alias("path"), dest.alias("dest"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    last = watch.debounce(watch.relevant(e), "30 minutes", F.struct("ts", "event_id"))
    return watch.actions(last).groupBy("path", "action").agg(F.count(F.lit(1)).alias("n"))


_ACTIONS = """WITH e AS (SELECT CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'error' THEN 'DELETED' WHEN 'purchase' THEN 'MOVED' ELSE 'MODIFIED' END AS kind, 'u' || user_id || CASE WHEN user_id % 3 = 0 THEN '.txt' ELSE '.py' END AS path,
  CASE WHEN event_type = 'purchase' THEN 'moved/u' || user_id || CASE WHEN event_id % 2 = 0 THEN '.go' ELSE '.md' END END AS dest, ts, event_id FROM events),
r AS (SELECT * FROM e WHERE path LIKE '%.py' OR coalesce(dest LIKE '%.go', false)),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM r),
x AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM g),
l AS (SELECT path, arg_max(struct_pack(kind := kind, dest := dest), struct_pack(ts := ts, event_id := event_id)) AS last FROM x GROUP BY path, grp),
a AS (SELECT path, 'index' AS action FROM l WHERE last.kind IN ('CREATED', 'MODIFIED') AND path LIKE '%.py' UNION ALL SELECT path, 'remove' FROM l WHERE last.kind IN ('DELETED', 'MOVED') UNION ALL SELECT last.dest, 'index' FROM l WHERE last.kind = 'MOVED' AND last.dest LIKE '%.go')
SELECT path, action, count(*) AS n FROM a GROUP BY ALL"""

_DIFF = ["@@ -{k} +1 @@ def {n}_{m}", "+class {n}_{m}(Base):", "-def {n}_{m}(x):", "+    async def {n}_{m}(x):", "+defined = {k}"]


def _diff_names(s: SparkSession, d: str) -> DataFrame:
    """Names in a diff of five kinds of lines, one line for each part."""
    line = F.get(F.array(*[_filled(x) for x in _DIFF]), (F.col("p_partkey") % 5).cast("int"))
    return git.changed_names(b.table(s, d, "part").select(F.col("p_partkey").alias("pos"), line.alias("line")))


def _reports(s: SparkSession, d: str) -> DataFrame:
    e = validated_events(s, d)
    clock = scalars.iso_utc(F.col("ts"))
    return e.select("event_id", F.sha1(contracts.summary(F.col("task_type"), F.col("v")).cast("binary")).alias("summary"), F.sha1(contracts.serialize(F.col("task_type"), F.col("output"), clock).cast("binary")).alias("json"))


_REPORTS = f"""{contract_parts()}, r AS (SELECT *, len(list_filter(need, lambda f: list_contains(keys, f))) AS have, len(list_filter(may, lambda f: list_contains(keys, f) AND NOT list_contains(need, f))) AS more, array_to_string(m, ', ') AS ms, array_to_string(u, ', ') AS us FROM x)
SELECT event_id, sha1('Validation: ' || CASE WHEN len(m) = 0 AND len(u) = 0 THEN 'PASS' ELSE 'FAIL' END || chr(10) || 'Task Type: ' || upper(task_type) || chr(10) || 'Required Fields Present: ' || have || chr(10) || 'Optional Fields Present: ' || more
  || CASE WHEN len(m) > 0 THEN chr(10) || 'Missing Required: ' || ms ELSE '' END || CASE WHEN len(u) > 0 THEN chr(10) || 'Unknown Fields: ' || us ELSE '' END
  || CASE WHEN len(m) > 0 THEN chr(10) || 'Errors:' || chr(10) || '  • Missing required fields: ' || ms ELSE '' END || CASE WHEN len(u) > 0 THEN chr(10) || 'Warnings:' || chr(10) || '  • Unknown fields (strict mode): ' || us ELSE '' END) AS summary,
  sha1('{{"task_type":"' || upper(task_type) || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","schema_version":"1.0","output":' || output || '}}') AS json FROM r"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    **{f"extract_{lang}": (lambda s, d, lang=lang: _extracted(s, d, lang), _extracted_sql(lang)) for lang in SOURCES},
    "store_tables": (_store_tables, _STORE),
    "store_counters": (_store_counters, _COUNTERS),
    "upsert_latest": (_upserted, "SELECT user_id, arg_max(event_id, struct_pack(v := event_id % 2, id := event_id)) AS event_id, arg_max(event_type, struct_pack(v := event_id % 2, id := event_id)) AS event_type FROM events GROUP BY user_id"),
    "event_actions": (_actions, _ACTIONS),
    "diff_names": (_diff_names, f"SELECT {_filled_sql('{n}_{m}')} AS name, min(p_partkey) AS pos FROM part WHERE p_partkey % 5 IN (0, 1, 3) GROUP BY 1"),
    "contract_reports": (_reports, _REPORTS),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
