"""The index as an object: every lookup, search, graph, metric and prompt operation, as frames or JSON-ready values."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .operators import graph, lookups, metrics, search
from .plans import dimensions as d
from .plans import intent, prompt
from .sources import config, git
from .sources.store import Store
from .streaming import watch as watching


def rows(df: DataFrame) -> list[dict]:
    """A bounded result as JSON-ready rows."""
    return [r.asDict(recursive=True) for r in df.collect()]


class CodeIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)
        self._cache: dict[str, tuple[int, DataFrame]] = {}

    def _t(self, name: str) -> DataFrame:
        return self.store.table(name)

    def _kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived frame, persisted for the store's version it was made of."""
        v = self.store.version()
        if self._cache.get(name, (-1,))[0] != v:
            if name in self._cache:
                self._cache[name][1].unpersist()
            self._cache[name] = (v, make().persist())
        return self._cache[name][1]

    @property
    def metrics(self) -> DataFrame:
        return self._kept("metrics", lambda: metrics.symbol_metrics(self._t("symbols"), self._t("relations")))

    @property
    def graph(self) -> DataFrame:
        return self._kept("graph", lambda: graph.call_graph(self._t("symbols"), self._t("relations")))

    # index
    def build(self, root: str, clock: int | None = None, resolve: bool = False) -> dict:
        stats = self.store.build(root, git.branch(root) if "://" not in root else "", clock or int(time.time()))
        return stats | (self.store.resolve() if resolve else {})

    def resolve(self) -> dict:
        return self.store.resolve()

    def watch(self, root: str, events: DataFrame, checkpoint: str, on_event: Callable[[dict], None] | None = None, once: bool = False) -> StreamingQuery:
        """Apply a stream of file events (kind, path, dest, ts) to the index, one writer, debounced."""

        def apply(actions: DataFrame, batch: int) -> None:
            if actions.take(1):
                stats = self.store.apply(root, actions, int(time.time()))
                if on_event:
                    on_event(stats)

        return watching.watch(events, apply, checkpoint, once=once)

    # lookups
    def get_symbol(self, name: str) -> DataFrame:
        return lookups.symbol(self._t("symbols"), self._t("files"), name)

    def get_symbol_by_fqid(self, fqid: str) -> DataFrame:
        return lookups.by_fqid(self._t("symbols"), fqid)

    def get_callers(self, name: str) -> DataFrame:
        return lookups.callers(self._t("symbols"), self._t("relations"), name)

    def get_owned_symbols(self, class_name: str) -> DataFrame:
        return lookups.owned(self._t("symbols"), class_name)

    def get_module_symbols(self, module: str) -> DataFrame:
        return lookups.in_module(self._t("symbols"), module)

    def get_imports(self, path: str) -> DataFrame:
        return lookups.imports_of(self._t("symbols"), self._t("relations"), path)

    def get_aliases(self, path: str) -> DataFrame:
        return lookups.aliases_of(self._t("import_aliases"), path)

    def list_files(self) -> DataFrame:
        return lookups.file_list(self._t("files"))

    # search and graph
    def search_symbols(self, query: str, kind: str | None = None, limit: int = 20, compat: bool = False) -> DataFrame:
        return search.retrieve(self._t("symbols"), self._t("relations"), self._t("files"), self.metrics, query, kind, limit, compat)

    def get_callgraph(self, name: str, depth: int = 3) -> DataFrame:
        return graph.reach(self.graph, name, depth).orderBy("depth", "name")

    def get_impact(self, name: str, depth: int = 3) -> DataFrame:
        return graph.reach(self.graph, name, depth, reverse=True).orderBy("depth", "name")

    def get_context(self, name: str, depth: int = 2) -> DataFrame:
        return graph.context(self._t("symbols"), self._t("relations"), self.metrics, name, depth, self.graph)

    # reports
    def get_stats(self) -> dict:
        got = rows(metrics.index_stats(self._t("files"), self._t("symbols"), self._t("relations")))
        out: dict = {"by_kind": {}, "by_language": {}, "branch": self.store.meta().get("branch", "")}
        for r in got:
            if r["measure"] in ("kind", "language"):
                out[f"by_{r['measure']}"][r["key"]] = r["n"]
            else:
                out[r["measure"]] = r["n"]
        return out

    def branch_stats(self) -> DataFrame:
        return metrics.branch_stats(self._t("files"), self._t("symbols"))

    def resolution(self) -> DataFrame:
        return metrics.resolution_bands(self._t("relations"))

    def hotspots(self, top: int = 10) -> DataFrame:
        return metrics.hotspots(self.metrics, top)

    def dead_code(self, kind: str | None = None, limit: int = 50) -> DataFrame:
        dead = metrics.dead_code(self.metrics)
        return (dead.where(F.col("kind") == kind) if kind else dead).limit(limit)

    def god_objects(self, threshold: int = 10) -> DataFrame:
        return metrics.god_objects(self.metrics, threshold)

    def long_functions(self, threshold: int = 50) -> DataFrame:
        return metrics.long_functions(self.metrics, threshold)

    def functions(self, by: str = "lines", limit: int = 20) -> DataFrame:
        return metrics.functions(self.metrics, by, limit)

    def coupling(self) -> DataFrame:
        return metrics.module_coupling(self._t("symbols"), self._t("relations"))

    def imports(self) -> DataFrame:
        return graph.import_graph(self._t("symbols"), self._t("relations"), self._t("modules"))

    def cycles(self, longest: int | None = None) -> DataFrame:
        return graph.simple_cycles(self.imports(), longest)

    def health(self) -> dict:
        return rows(metrics.health_summary(self._t("symbols"), self._t("relations"), self.cycles(), graph.cyclic_components(self.imports())))[0]

    # prompts
    def plan(self, goal: str, settings: config.Settings | None = None, preset: str | None = None, profile: str | None = None, **hints) -> DataFrame:
        """One planned task; hints as in ``intent.plan_tasks``.  Presets and profiles give hints that are not set, and the
        depth of retrieval: the preset's, else the named profile's, the settings', the default profile's, the mode's.  Tokens:
        the profile's, else the settings', the mode's."""
        settings = settings or config.Settings()
        extra = list(hints.pop("extra", None) or [])
        depth, tokens = settings.context_depth, settings.max_tokens
        if profile not in d.PROFILES and settings.default_profile in d.PROFILES:
            depth = depth or d.PROFILES[settings.default_profile][3]
            profile = settings.default_profile
        elif profile in d.PROFILES:
            depth = d.PROFILES[profile][3]
        if preset in d.PRESETS:
            task, mode, more, depth = d.PRESETS[preset]
            hints["task_hint"], hints["mode_hint"], extra = hints.get("task_hint") or task, hints.get("mode_hint") or mode, extra + more
        if profile in d.PROFILES:
            mode, more, own, _ = d.PROFILES[profile]
            hints["mode_hint"], extra, tokens = hints.get("mode_hint") or mode, extra + more, own or tokens
        always, never = settings.constraints()
        task = hints.get("task_hint")
        hints["mode_hint"] = hints.get("mode_hint") or settings.mode_for(task or "", None)
        one = self.spark.createDataFrame([(goal,)], "text string")
        out = intent.plan_tasks(one, extra=extra + always, **hints)
        for c in never:
            out = out.withColumn("constraints", F.array_remove("constraints", c))
        for field, value in (("max_tokens", tokens), ("retrieval_depth", depth)):
            out = out.withColumn("budget", F.col("budget").withField(field, F.lit(value))) if value else out
        return out

    def retrieve(self, query: str, max_tokens: int = 8000, depth: int = 2, targets: list[str] | None = None, changed: list[str] | None = None, chains: bool = True) -> DataFrame:
        """Contexts of a request's symbols: explicit targets, up to two recently changed, then search hits."""
        most, first, rest = prompt.symbol_limits(max_tokens, depth)
        chosen: list[tuple[str, int]] = []
        taken: set[str] = set()

        def take(names: list[str], limit: int, deep: int) -> None:
            known = {r["name"] for r in self._t("symbols").where(F.col("name").isin(names)).select("name").distinct().collect()} if names else set()
            for n in names:
                if n in known and n not in taken and limit > 0:
                    taken.add(n)
                    chosen.append((n, deep))
                    limit -= 1

        take(targets or [], len(targets or []), first)
        take(changed or [], max(0, min(2, most - len(chosen))), rest)
        left = most - len(chosen)
        for q in prompt.attempts(query) if left > 0 and query else []:
            hits = [r["name"] for r in self.search_symbols(q, limit=left).select("name").collect()]
            if hits:
                alone = not chosen
                take(hits[:1], left, first if alone else rest)
                take(hits[1:], most - len(chosen), rest)
                break
        out = None
        for i, (name, deep) in enumerate(chosen, 1):
            one = self.get_context(name, deep).withColumn("rank", F.lit(i))
            hops = F.slice("callgraph", 1, 4) if i > 1 else F.col("callgraph")
            one = one.withColumn("callgraph", hops if chains else F.array().cast("array<string>"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "name string, kind string, file_path string, start_line int, end_line int, fqid string, module string, calls array<string>, called_by array<string>, file_imports array<string>, callgraph array<string>, impact array<string>, impact_count long, modules long, impact_score double, rank int")

    def compile(self, goal: str, root: str | None = None, settings: config.Settings | None = None, with_context: bool = True, **how) -> dict:
        """The whole prompt of a goal: plan, context, blocks under budget, messages and reports."""
        settings = settings or config.Settings()
        planned = self.plan(goal, settings, **how).persist()
        task = planned.first().asDict(recursive=True)
        text = None
        if with_context and self.store.version():
            changed = git.changed_symbols(self.spark, root) if root else []
            found = self.retrieve(task["retrieval"]["query"], task["budget"]["max_tokens"], task["budget"]["retrieval_depth"], changed=changed, chains=task["retrieval"]["include_call_chains"]).persist()
            words = prompt.attempts(task["retrieval"]["query"])[1:]
            diff = git.diff_section(self.spark, root, words) if root and task["retrieval"]["git_history"] else ""
            if found.take(1) or diff:
                text = prompt.context_text(task["retrieval"]["query"], found, diff, task["budget"]["max_tokens"])
            found.unpersist()
        out = prompt.compile_tasks(planned, context=F.lit(text).cast("string"), repo_policy=settings.repo_policy)
        cap = F.col("budget.max_tokens").cast("long")
        got = out.select("prompt", "prompt_tokens", prompt.messages(F.col("blocks")).alias("messages"), prompt.budget_report(F.col("blocks"), cap).alias("report"), prompt.compression_summary(F.col("blocks"), cap).alias("summary")).first().asDict(recursive=True)
        planned.unpersist()
        return got | {"task": task}
