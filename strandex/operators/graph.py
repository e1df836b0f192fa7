"""Call graph, bounded reach, elementary cycles, and the context of one symbol.

Reach expands a frontier level by level with an anti-join against what was seen, checkpointed in the shared
folder at each level, so lineage stays short and a lost executor costs no recomputation of earlier levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of cyclic components that may go to every task.
SEARCHED_EDGES = 100_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder in the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def call_graph(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` by symbol name; symbols of one name are one node."""
    own = symbols.where("kind <> 'module'").select(F.col("id").alias("from_id"), F.col("name").alias("src"))
    return relations.where("relation = 'CALLS'").select("from_id", F.col("to_name").alias("dst")).join(own, "from_id").select("src", "dst").distinct()


def reach(graph: DataFrame, start: str, depth: int = 3, reverse: bool = False) -> DataFrame:
    """``name, depth`` of what ``start`` reaches within ``depth`` steps (``reverse``: what reaches it), start left out."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    edges = graph.select(F.col(near).alias("near"), F.col(far).alias("name"))
    seen = edges.sparkSession.createDataFrame([(start, 0)], "name string, depth int")
    front = seen
    for level in range(1, depth + 1):
        step = edges.join(F.broadcast(front.select(F.col("name").alias("near"))) if level == 1 else front.select(F.col("name").alias("near")), "near", "left_semi")
        front = cut(step.select("name").distinct().join(seen, "name", "left_anti").withColumn("depth", F.lit(level)))
        if not front.take(1):
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def simple_cycles(graph: DataFrame, longest: int | None = None) -> DataFrame:
    """``cycle`` (array from its smallest node) of every elementary cycle, or of those of up to ``longest`` nodes.

    Edges between strongly connected components lie on no cycle and go first.  Paths start at their smallest node and only
    visit larger ones, so each cycle is found once.  Up to ``SEARCHED_EDGES`` remaining edges (counted) go to every task, and
    tasks search from one first edge each, along nodes that still lead back; more edges are joined level by level.  The number
    of cycles may grow exponentially with the size of a component; ``cyclic_components`` does not.
    """
    parts = cut(cyclic_components(graph)).select(F.array_min("component").alias("part"), F.explode("component").alias("node"))
    inside = lambda side: parts.select(F.col("node").alias(side), F.col("part").alias(f"{side}_part"))
    edges = graph.where("src <> dst").select("src", "dst").distinct().join(inside("src"), "src").join(inside("dst"), "dst")
    edges = cut(edges.where("src_part = dst_part").select("src", "dst"))
    n = edges.count()
    found = _searched_cycles(edges, n, longest) if n <= SEARCHED_EDGES else _joined_cycles(edges, longest)
    return found.orderBy(F.desc(F.size("cycle")), "cycle")


def _searched_cycles(edges: DataFrame, n: int, longest: int | None) -> DataFrame:
    """Depth first from each edge to a larger node; every extension leads to a cycle, so no step is lost."""
    spark = edges.sparkSession
    into: dict[str, list[str]] = {}
    out: dict[str, list[str]] = {}
    for src, dst in edges.collect():  # at most SEARCHED_EDGES
        into.setdefault(dst, []).append(src)
        out.setdefault(src, []).append(dst)
    shared = spark.sparkContext.broadcast((into, out))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        into, out = shared.value

        def ahead(path: list[str]) -> list[str]:
            """Where the path can go on: nodes from which its start is within reach around it."""
            low, taken, steps, queue = path[0], set(path), {path[0]: 0}, [path[0]]
            for v in queue:  # grows while it is read
                for u in into[v]:
                    if u > low and u not in taken and u not in steps:
                        steps[u] = steps[v] + 1
                        queue.append(u)
            return [u for u in out[path[-1]] if u in steps and (longest is None or len(path) + steps[u] <= longest)]

        def cycles(low: str, first: str) -> Iterator[list[str]]:
            path, open_ = [low, first], [iter(ahead([low, first]))]
            while open_:
                u = next(open_[-1], None)
                if u is None:
                    open_.pop()
                    path.pop()
                elif u == low:
                    yield list(path)
                else:
                    path.append(u)
                    open_.append(iter(ahead(path)))

        for b in batches:
            every = chain.from_iterable(cycles(*edge) for edge in zip(b["src"], b["dst"], strict=True))
            while some := list(islice(every, 1000)):
                yield pd.DataFrame({"cycle": some})

    seeds = edges.where("dst > src").repartition(max(1, min(n, spark.sparkContext.defaultParallelism)))
    return cut(seeds.mapInPandas(search, "cycle array<string>"))


def _joined_cycles(edges: DataFrame, longest: int | None) -> DataFrame:
    """All paths grow by one join for each level, until none is left."""
    paths = cut(edges.where("dst > src").select(F.array("src", "dst").alias("path"), F.col("src").alias("low"), F.col("dst").alias("tip")))
    found, n = paths.select(F.col("path").alias("cycle")).where("false"), 2
    while (longest is None or n <= longest) and paths.take(1):
        closed = paths.join(edges, (paths["tip"] == edges["src"]) & (paths["low"] == edges["dst"]), "left_semi").select(F.col("path").alias("cycle"))
        step = paths.join(edges, paths["tip"] == edges["src"]).where((F.col("dst") > F.col("low")) & ~F.array_contains("path", F.col("dst")))
        found, n = cut(found.union(closed)), n + 1
        paths = cut(step.select(F.concat("path", F.array("dst")).alias("path"), "low", F.col("dst").alias("tip")))
    return found


def cyclic_components(graph: DataFrame) -> DataFrame:
    """``component`` (sorted array) of every strongly connected component of two nodes or more: cycles of any length.

    Reach doubles in each step until nothing is added, so the steps grow with the logarithm of the longest path; the
    closure holds every pair of a node and what it reaches, which fits graphs of modules.
    """
    far = cut(graph.where("src <> dst").select("src", "dst").distinct())
    n = far.count()
    while True:
        hop = far.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
        far = cut(far.union(far.join(hop, "dst").select("src", F.col("to").alias("dst"))).distinct())
        before, n = n, far.count()
        if n == before:
            break
    back = far.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = far.join(back, ["src", "dst"], "left_semi")
    return mutual.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("component")).where(F.size("component") > 1).select("component").distinct()


def import_graph(symbols: DataFrame, relations: DataFrame, modules: DataFrame) -> DataFrame:
    """Module imports: target is the part after the last slash; files of no module and loops are left out."""
    from_file = symbols.where("name = '<module>'").select(F.col("id").alias("from_id"), "file_path")
    named = modules.select(F.col("path").alias("file_path"), F.col("name").alias("src"))
    target = F.element_at(F.split("to_name", "/"), -1)
    rows = relations.where("relation = 'IMPORTS'").select("from_id", "to_name").distinct().join(from_file, "from_id").join(named, "file_path")
    return rows.select("src", target.alias("dst")).where("src <> dst").distinct()


def context(symbols: DataFrame, relations: DataFrame, metrics: DataFrame, name: str, depth: int = 2, graph: DataFrame | None = None) -> DataFrame:
    """One row for the first symbol of that name: direct calls, callers, imports of its file, reach both ways, impact."""
    from . import lookups, search

    graph = graph if graph is not None else call_graph(symbols, relations)
    first = symbols.where(F.col("name") == name).orderBy("file_path", "start_line", "id").limit(1).select("name", "kind", "file_path", "start_line", "end_line", "fqid", "module")
    names = lambda df, c, as_: df.agg(F.array_sort(F.collect_set(c)).alias(as_))
    own = first.select(F.col("file_path").alias("of"))
    in_file = symbols.join(F.broadcast(own), symbols["file_path"] == own["of"], "left_semi").select("id")
    imports = relations.where("relation = 'IMPORTS'").join(in_file, F.col("from_id") == in_file["id"], "left_semi")
    back = reach(graph, name, depth, reverse=True)
    parts = [names(lookups.direct_calls(symbols, relations, name), "to_name", "calls"), names(lookups.callers(symbols, relations, name), "name", "called_by"), names(imports, "to_name", "file_imports"), names(reach(graph, name, depth), "name", "callgraph"), names(back, "name", "impact"), search.impact(back, metrics).select("impact_count", "modules", "impact_score")]
    out = first
    for p in parts:  # one-row frames
        out = out.join(F.broadcast(p))
    return out
