"""Structural metrics: fan-in, fan-out, methods, coupling, health.

Counts are aggregated before they join (partial sums on the map side), each on its own key, so one shuffle of
narrow rows serves each count and symbols are joined by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

# Names that the reports leave out.
NOT_HOT = ["print", "error", "console", "render", "stringify"]
NOT_DEAD = ["main", "__init__", "init", "constructor", "render", "handler", "test", "__main__"]
NOT_DEAD_END = "(Handler|handler|Test|test)$"
METRIC = ["id", "name", "kind", "file_path", "module", "start_line", "end_line", "line_count", "fan_in", "fan_out", "method_count"]


def symbol_metrics(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Every symbol but module sentinels, with its counts.  ``fan_in`` counts resolved calls only."""
    calls = relations.where("relation = 'CALLS'")
    fan_in = calls.where("to_symbol_id is not null").groupBy(F.col("to_symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    fan_out = calls.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    methods = symbols.where("owner_symbol_id is not null").groupBy(F.col("owner_symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("method_count"))
    own = symbols.where("kind <> 'module'").withColumn("line_count", F.col("end_line") - F.col("start_line") + 1)
    joined = own.join(fan_in, "id", "left").join(fan_out, "id", "left").join(methods, "id", "left")
    return joined.na.fill(0, ["fan_in", "fan_out", "method_count"]).select(*METRIC)


def hotspots(metrics: DataFrame, top: int = 10) -> DataFrame:
    kept = metrics.where(~F.col("name").isin(NOT_HOT) & (F.col("module") != ""))
    return kept.orderBy(F.desc("fan_in"), "name", "id").limit(top)


def dead_code(metrics: DataFrame) -> DataFrame:
    """Functions and methods that nothing calls, longest first."""
    unused = (F.col("fan_in") == 0) & F.col("kind").isin("function", "method")
    kept = metrics.where(unused & ~F.col("name").isin(NOT_DEAD) & ~F.col("name").rlike(NOT_DEAD_END))
    return kept.orderBy(F.desc("line_count"), "name", "id")


def god_objects(metrics: DataFrame, threshold: int = 10) -> DataFrame:
    return metrics.where((F.col("kind") == "class") & (F.col("method_count") >= threshold)).orderBy(F.desc("method_count"), "name", "id")


def long_functions(metrics: DataFrame, threshold: int = 50) -> DataFrame:
    return metrics.where(F.col("kind").isin("function", "method") & (F.col("line_count") >= threshold)).orderBy(F.desc("line_count"), "name", "id")


def functions(metrics: DataFrame, by: str = "lines", limit: int = 20) -> DataFrame:
    """Functions and methods by ``lines``, ``callers`` or ``callees``."""
    key = {"lines": "line_count", "callers": "fan_in", "callees": "fan_out"}[by]
    return metrics.where(F.col("kind").isin("function", "method")).orderBy(F.desc(key), "name", "id").limit(limit)


def module_coupling(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Resolved calls between different modules, strongest first."""
    side = lambda id_, as_: symbols.where("module <> ''").select(F.col("id").alias(id_), F.col("module").alias(as_))
    calls = relations.where("relation = 'CALLS' and to_symbol_id is not null").select("from_id", "to_symbol_id")
    ends = calls.join(side("from_id", "from_module"), "from_id").join(side("to_symbol_id", "to_module"), "to_symbol_id")
    counted = ends.where("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("call_count"))
    return counted.orderBy(F.desc("call_count"), "from_module", "to_module")


def index_stats(files: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """``measure, key, n``: totals, symbols by kind, files by language."""
    one = lambda df, m: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("measure"), F.lit("").alias("key"), "n")
    by = lambda df, m, c: df.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("measure"), "key", "n")
    parts = [one(files, "files"), one(symbols, "symbols"), one(relations, "relations"), by(symbols, "kind", "kind"), by(files, "language", "language")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def branch_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files and symbols of each branch.  Symbols are counted by file first, so the join stays narrow."""
    per_file = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("id").alias("symbols"))
    paths = files.groupBy("branch", "path").agg(F.count(F.lit(1)).alias("rows"))
    joined = paths.join(per_file, "path", "left")
    out = joined.groupBy("branch").agg(F.count("path").alias("files"), F.coalesce(F.sum(F.col("rows") * F.col("symbols")), F.lit(0)).alias("symbols"))
    return out.orderBy(F.desc("files"), "branch")


def resolution_bands(relations: DataFrame) -> DataFrame:
    """Calls and bases by confidence: exact, good, weak, none."""
    c, linked = F.col("confidence"), F.col("to_symbol_id").isNotNull()
    rows = relations.where(F.col("relation").isin("CALLS", "INHERITS"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(linked & (c >= 0.9)).alias("exact"),
        F.count_if(linked & (c >= 0.7) & (c < 0.9)).alias("good"),
        F.count_if(linked & (c > 0) & (c < 0.7)).alias("weak"),
        F.count_if(~linked).alias("unresolved"),
    )


def health_summary(symbols: DataFrame, relations: DataFrame, cycles: DataFrame | None = None, components: DataFrame | None = None) -> DataFrame:
    """One row: totals, and the first five rows of hotspots, longest functions and couplings as arrays of their whole rows.

    Metrics and couplings are computed once and checkpointed."""
    m, coupling = cut(symbol_metrics(symbols, relations)), cut(module_coupling(symbols, relations))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))

    def top(df: DataFrame, name: str, key: str, *ties: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct((-F.col(key)).alias("k"), F.struct(*ties).alias("t"), F.struct(*df.columns).alias("row"))))
        return df.limit(5).agg(rows.alias(name)).select(F.transform(name, lambda x: x["row"]).alias(name))

    parts = [count(m, "total_symbols"), count(dead_code(m), "dead_code_count"), count(god_objects(m), "god_objects_count"), top(hotspots(m, 5), "hotspots_top_5", "fan_in", "name", "id"), top(long_functions(m), "longest_functions_top_5", "line_count", "name", "id"), count(coupling, "coupling_edges_count"), top(coupling.orderBy(F.desc("call_count"), "from_module", "to_module"), "coupling_top_5", "call_count", "from_module", "to_module")]
    if cycles is not None:
        parts.append(count(cycles, "circular_deps_count"))
    if components is not None:
        parts.append(count(components, "cyclic_components_count"))
    out = parts[0]
    for p in parts[1:]:  # one-row frames
        out = out.join(F.broadcast(p))
    return out
