"""Command line over ``CodeIndex``: ``python -m strandex.cli COMMAND ...``; results are tables, or JSON with --json."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .api import CodeIndex, rows
from .plans import contracts
from .plans import dimensions as d
from .sources import config, git

NAMED = {"symbol": "get_symbol", "callers": "get_callers", "fqid": "get_symbol_by_fqid", "ownership": "get_owned_symbols", "module": "get_module_symbols", "imports": "get_imports", "aliases": "get_aliases"}
DEEP = {"deps": "get_callgraph", "impact": "get_impact", "context": "get_context"}
PLAIN = {"files": "list_files", "branch": "branch_stats", "resolution": "resolution", "coupling": "coupling", "cycles": "cycles"}


def index_folder(given: str | None, root: str) -> str:
    """Flag, then ``STRANDEX_INDEX``, then a folder of the work tree's full path (two of one name stay apart)."""
    if given or os.environ.get("STRANDEX_INDEX"):
        return given or os.environ["STRANDEX_INDEX"]
    top = git.root_of(root) or Path(root).resolve()
    return str(Path.home() / ".local/share/strandex" / f"{top.name}-{hashlib.sha1(str(top).encode()).hexdigest()[:12]}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandex")
    p.add_argument("--index")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    build.add_argument("root", nargs="?", default=".")
    build.add_argument("--resolve", action="store_true")
    for name in NAMED:
        sub.add_parser(name).add_argument("value")
    for name in DEEP:
        x = sub.add_parser(name)
        x.add_argument("value")
        x.add_argument("--depth", type=int, default=2 if name == "context" else 3)
    for name in (*PLAIN, "stats", "resolve", "health"):
        sub.add_parser(name)
    s = sub.add_parser("search")
    s.add_argument("value")
    s.add_argument("--kind")
    s.add_argument("--limit", type=int, default=20)
    for name, default in (("hotspots", 10), ("dead-code", 50), ("functions", 20)):
        x = sub.add_parser(name)
        x.add_argument("--limit", type=int, default=default)
        x.add_argument("--kind")
        x.add_argument("--by", default="lines", choices=["lines", "callers", "callees"])
    for name in (*d.VERBS, "run", "plan", "inspect"):
        x = sub.add_parser(name)
        x.add_argument("goal")
        for flag in ("--task", "--mode", "--scope", "--preset", "--profile", "--root"):
            x.add_argument(flag)
        x.add_argument("--constraint", action="append", default=[])
        for flag in ("--preserve-api", "--no-tests", "--no-context", "--compact"):
            x.add_argument(flag, action="store_true")
    show = sub.add_parser("show")
    show.add_argument("what", choices=["tasks", "task", "modes", "constraints", "presets", "profiles", "policy", "verbs"])
    show.add_argument("value", nargs="?")
    sub.add_parser("init").add_argument("path", nargs="?", default=str(Path.home() / ".config/strandex/config.toml"))
    return p


def shown(what: str, value: str | None) -> object:
    if what == "task":
        t = value if value in d.TASK_TYPES else d.VERBS.get(value or "", "bugfix")
        return {"task": t, "mode": d.DEFAULT_MODES.get(t, "surgical"), "risk": d.RISK.get(t, "medium"), "constraints": d.DEFAULT_CONSTRAINTS.get(t, []), "schema": contracts.json_schema(t)}
    return {"tasks": d.TASK_TYPES, "modes": d.MODE_LINES, "constraints": d.CONSTRAINTS, "presets": d.PRESETS, "profiles": d.PROFILES, "policy": d.RULES, "verbs": d.VERBS}[what]


def run(a: argparse.Namespace, spark: SparkSession) -> object:
    root = getattr(a, "root", None) or "."
    index = CodeIndex(spark, index_folder(a.index, root))
    if a.command == "build":
        return index.build(a.root, resolve=a.resolve)
    if a.command in NAMED:
        return getattr(index, NAMED[a.command])(a.value)
    if a.command in DEEP:
        return getattr(index, DEEP[a.command])(a.value, a.depth)
    if a.command in PLAIN:
        return getattr(index, PLAIN[a.command])()
    if a.command == "search":
        return index.search_symbols(a.value, a.kind, a.limit)
    if a.command in ("stats", "resolve", "health"):
        return {"stats": index.get_stats, "resolve": index.resolve, "health": index.health}[a.command]()
    if a.command == "hotspots":
        return index.hotspots(a.limit)
    if a.command == "dead-code":
        return index.dead_code(a.kind, a.limit)
    if a.command == "functions":
        return index.functions(a.by, a.limit)
    task = a.task if a.command in ("run", "plan", "inspect") else d.VERBS[a.command]
    how = {"task_hint": task, "mode_hint": a.mode, "scope_hint": a.scope, "extra": [c for c in a.constraint if c in d.CONSTRAINTS], "preserve_api": a.preserve_api, "no_tests": a.no_tests, "preset": a.preset, "profile": a.profile}
    settings = config.load(root)
    if a.command == "plan":
        return index.plan(a.goal, settings, **how)
    got = index.compile(a.goal, root, settings, not a.no_context, **how)
    if a.command == "inspect":
        return {"summary": got["summary"]} if a.compact else {"task": got["task"], "report": got["report"], "summary": got["summary"]}
    return got["prompt"]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "show":
        out = shown(a.what, a.value)
    elif a.command == "init":
        config.write_default(a.path)
        out = a.path
    else:
        out = run(a, spark or SparkSession.builder.appName("strandex").getOrCreate())
    if isinstance(out, str):
        print(out)
    elif isinstance(out, DataFrame) and not a.json:
        out.show(100, truncate=False)
    else:
        print(json.dumps(rows(out) if isinstance(out, DataFrame) else out, indent=2, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
