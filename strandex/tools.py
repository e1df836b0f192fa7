"""The index as tools over JSON lines: one request ``{"id", "tool", "args"}`` a line in, one ``{"id", "result"}`` out."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import DataFrame

from .api import CodeIndex, rows


def tools(index: CodeIndex) -> dict[str, Callable[..., object]]:
    """The twelve tools by name; frames become JSON-ready rows."""
    names = ("search_symbols", "get_symbol", "get_symbol_by_fqid", "get_callers", "get_owned_symbols", "get_module_symbols", "get_callgraph", "get_impact", "get_context", "get_stats", "list_files")

    def plain(call: Callable) -> Callable[..., object]:
        def run(**args):
            got = call(**args)
            return rows(got) if isinstance(got, DataFrame) else got

        return run

    return {n: plain(getattr(index, n)) for n in names} | {"build_index": lambda root, resolve=True: index.build(root, resolve=resolve)}


def serve(index: CodeIndex, inputs: TextIO = sys.stdin, outputs: TextIO = sys.stdout) -> None:
    """Answer requests until the input ends; a request that fails answers with its error."""
    known = tools(index)
    for line in inputs:
        if not line.strip():
            continue
        ask: dict = {}
        try:
            ask = json.loads(line)
            if ask.get("tool") == "list_tools":
                answer = {"result": sorted(known)}
            else:
                answer = {"result": known[ask["tool"]](**ask.get("args", {}))}
        except Exception as e:  # noqa: BLE001  the server outlives a bad request
            answer = {"error": f"{type(e).__name__}: {e}"[:500]}
        outputs.write(json.dumps({"id": ask.get("id") if isinstance(ask, dict) else None} | answer, default=str, ensure_ascii=False) + "\n")
        outputs.flush()


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    serve(CodeIndex(SparkSession.builder.appName("strandex").getOrCreate(), sys.argv[1]))
