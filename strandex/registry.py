"""Queries over the driver's tables, one for each operator of the index, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binding as b
from .functions import scalars
from .operators import graph, lookups, metrics, resolve, search
from .streaming import incremental, watch

NAME, BRAND, QUERY, PHRASES = "red widget", "Brand#4", "red gea", "red-gea brand#4/s"


def _metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.symbol_metrics(b.symbols(s, d), b.relations(s, d))


def _graph(s: SparkSession, d: str) -> DataFrame:
    """The call graph, made once for a query that walks it level by level."""
    return graph.cut(graph.call_graph(b.symbols(s, d), b.relations(s, d)))


def _reached(s: SparkSession, d: str, depth: int, reverse: bool = False) -> DataFrame:
    g = _graph(s, d)
    return graph.reach(g, _start(g), depth, reverse)


def _start(g: DataFrame) -> str:
    got = g.agg(F.min("src").alias("x")).first()["x"]
    return got if got is not None else ""


SYM = """sym AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey = first THEN 'class' WHEN p_partkey % 2 = 0 THEN 'function' ELSE 'method' END AS kind,
  p_brand || '/' || p_type AS file_path, p_brand AS module, p_type AS language, 1 AS start_line, p_size AS end_line, p_brand || '.' || p_name AS fqid,
  CASE WHEN p_partkey <> first THEN first END AS owner_symbol_id FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part))"""
REL = """every AS (SELECT from_id, to_symbol_id, p_name AS to_name, CASE left(o_orderpriority, 1) WHEN '1' THEN 'CALLS' WHEN '2' THEN 'IMPORTS' WHEN '3' THEN 'INHERITS' WHEN '4' THEN 'DEFINES' ELSE 'USES' END AS relation
  FROM (SELECT l_orderkey, l_partkey AS from_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS to_symbol_id FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = to_symbol_id),
rel AS (SELECT * FROM every WHERE relation = 'CALLS')"""
FIL = """fil AS (SELECT p_brand || '/' || p_type AS path, sha1(p_brand || '/' || p_type) AS content_hash, p_brand AS branch, p_type AS language, min(p_partkey) + 1 AS last_indexed_at FROM part GROUP BY p_brand, p_type)"""
MET = """met AS (SELECT id, name, kind, file_path, module, start_line, end_line, end_line - start_line + 1 AS line_count,
  coalesce(fi, 0) AS fan_in, coalesce(fo, 0) AS fan_out, coalesce(mc, 0) AS method_count FROM sym
  LEFT JOIN (SELECT to_symbol_id AS k1, count(*) AS fi FROM rel GROUP BY 1) ON k1 = id
  LEFT JOIN (SELECT from_id AS k2, count(*) AS fo FROM rel GROUP BY 1) ON k2 = id
  LEFT JOIN (SELECT owner_symbol_id AS k3, count(*) AS mc FROM sym WHERE owner_symbol_id IS NOT NULL GROUP BY 1) ON k3 = id)"""
GRA = "gra AS (SELECT DISTINCT s.name AS src, r.to_name AS dst FROM rel r JOIN sym s ON s.id = r.from_id)"
M = f"WITH {SYM}, {REL}, {MET} "
G = f"{SYM}, {REL}, {GRA}"


def _reach_sql(near: str, far: str, depth: int) -> str:
    return f"""st AS (SELECT min(src) AS x FROM gra), bfs AS (SELECT x AS name, 0 AS depth FROM st UNION SELECT g.{far}, b.depth + 1 FROM bfs b JOIN gra g ON g.{near} = b.name WHERE b.depth < {depth}),
rch AS (SELECT name, min(depth) AS depth FROM bfs WHERE name <> (SELECT x FROM st) GROUP BY name)"""


_BM25_TOKENS = "regexp_extract_all(lower(name || ' | ' || kind || ' | ' || file_path), '[a-z0-9]+')"


def _bm25_sql(query: str) -> str:
    """Single-token words only; each is a prefix."""
    words = [p[0] for p in search.query_phrases(query)]
    parts = ["len_ AS (SELECT id, len(" + _BM25_TOKENS + ") AS dl FROM sym)", "avg_ AS (SELECT count(*) AS n, avg(dl) AS mean FROM len_)"]
    for i, w in enumerate(words):
        parts.append(f"tf{i} AS (SELECT id, len(list_filter({_BM25_TOKENS}, lambda t: starts_with(t, '{w}'))) AS tf FROM sym)")
        parts.append(f"df{i} AS (SELECT ln((max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf{i}, avg_ WHERE tf > 0)")
    score = " + ".join(f"(CASE WHEN d{i}.raw <= 0 THEN 1e-6 ELSE d{i}.raw END) * t{i}.tf * 2.2 / (t{i}.tf + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(words)))
    joins = " ".join(f"JOIN tf{i} t{i} ON t{i}.id = l.id AND t{i}.tf > 0 CROSS JOIN df{i} d{i}" for i in range(len(words)))
    parts.append(f"bm AS (SELECT l.id, -({score}) AS bm25 FROM len_ l CROSS JOIN avg_ {joins})")
    return ", ".join(parts)


def _ranked_sql(compat: bool = False) -> str:
    """The ranking of the 80 best matches, cut to 20; ``compat`` scales text scores by the newest time."""
    scale = "greatest(mt, 1)" if compat else "greatest(mb, 1e-9)"
    return f"""WITH {SYM}, {REL}, {FIL}, {MET}, {_bm25_sql(QUERY)},
top AS (SELECT * FROM bm JOIN sym USING (id) ORDER BY bm25, id LIMIT 80),
en AS (SELECT top.*, coalesce(f.last_indexed_at, 0) AS t, coalesce(c.n, 0) AS callers, h.hub FROM top LEFT JOIN fil f ON f.path = top.file_path
  LEFT JOIN (SELECT to_name, count(*) AS n FROM rel GROUP BY 1) c ON c.to_name = top.name
  LEFT JOIN (SELECT name, arg_min(fan_in, id) AS hub FROM met GROUP BY 1) h ON h.name = top.name),
mx AS (SELECT max(t) AS mt, max(-bm25) AS mb FROM en),
sc AS (SELECT id, name, 2.0 * greatest(0, -bm25) / {scale} AS f1, 1.5 * ln(1 + callers) AS f2, 0.8 * t / greatest(mt, 1) AS f3,
  0.5 * 0.5 * least(3, len(list_filter(['red', 'gea'], lambda w: list_contains(string_split(lower(name), '_'), w)))) AS f4, 0.3 * ln(1 + hub) / 3.0 AS f5 FROM en CROSS JOIN mx)
"""


_RANKED = _ranked_sql()
_POSITIONS = "SELECT id, name, round(f1 + f2 + f3 + f4 + f5, 6) AS composite_score, row_number() OVER (ORDER BY f1 + f2 + f3 + f4 + f5 DESC, name, id)::INTEGER AS rank_position FROM sc QUALIFY rank_position <= 20"


def _rank(s: SparkSession, d: str, compat: bool = False) -> DataFrame:
    return search.retrieve(b.symbols(s, d), b.relations(s, d), b.files(s, d), _metrics(s, d), QUERY, None, 20, compat)


def _phrase_sql(query: str) -> str:
    """BM25 of phrases: adjacent tokens of one column, the last one a prefix."""
    phrases, cols = search.query_phrases(query), ("name", "kind", "file_path")
    toks = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
    hit = lambda c, p: f"len(list_filter(range(1, len({toks(c)}) + 1), lambda i: " + " AND ".join([f"starts_with({toks(c)}[i], '{p[-1]}')"] + [f"coalesce(CASE WHEN i > {k} THEN {toks(c)}[i - {k}] END = '{w}', false)" for k, w in enumerate(reversed(p[:-1]), 1)]) + "))"
    tfs = ", ".join(" + ".join(hit(c, p) for c in cols) + f" AS tf{i}" for i, p in enumerate(phrases))
    idf = lambda i: f"CASE WHEN n <= 2 * n{i} THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END"
    part = lambda i: f"({idf(i)}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))"
    n = range(len(phrases))
    return f"""WITH {SYM}, t AS (SELECT id, {' + '.join(f'len({toks(c)})' for c in cols)} AS dl, {tfs} FROM sym), s AS (SELECT count(*) AS n, avg(dl) AS mean, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0) AS n{i}' for i in n)} FROM t)
SELECT id, round(-({' + '.join(part(i) for i in n)}), 6) AS bm25 FROM t CROSS JOIN s WHERE {' AND '.join(f'tf{i} > 0' for i in n)}"""


def _imports(s: SparkSession, d: str) -> DataFrame:
    return graph.import_graph(*b.nation_imports(s, d))


#: Imports between nations, as in the binding.
_IMP = """imp AS (SELECT DISTINCT n.n_name AS src, m.n_name AS dst FROM nation n JOIN nation m ON m.n_nationkey IN ((2 * n.n_nationkey + 1) % 25, (n.n_nationkey + 1 + n.n_regionkey) % 25) WHERE n.n_name <> m.n_name)"""


def _old_new(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = b.table(s, d, "documents").select("doc_id", "text")
    digest = scalars.content_hash(F.col("text"))
    path = F.col("doc_id").cast("string").alias("path")
    old = docs.where("doc_id % 10 <> 0").select(path, F.when(F.col("doc_id") % 7 == 0, F.lit("stale")).otherwise(digest).alias("content_hash"))
    return old, docs.where("doc_id % 10 <> 1").select(path, digest.alias("content_hash"))


def _stream_events(s: SparkSession, d: str) -> DataFrame:
    e = b.table(s, d, "events")
    return e.select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("path"), F.lit(None).cast("string").alias("dest"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _health(s: SparkSession, d: str) -> DataFrame:
    """The whole report, its rows as texts."""
    imports = _imports(s, d)
    out = metrics.health_summary(b.symbols(s, d), b.relations(s, d), graph.simple_cycles(imports), graph.cyclic_components(imports))
    told = lambda c, *fields: F.array_join(F.transform(c, lambda r: F.concat_ws("/", *[r[f].cast("string") for f in fields])), ",").alias(c)
    rows = {"hotspots_top_5": ("name", "id", "fan_in", "module"), "longest_functions_top_5": ("name", "id", "line_count", "module"), "coupling_top_5": ("from_module", "to_module", "call_count")}
    return out.select(*[told(c, *rows[c]) if c in rows else F.col(c) for c in out.columns])


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "symbol_metrics": (_metrics, M + "SELECT * FROM met"),
    "hotspots": (lambda s, d: metrics.hotspots(_metrics(s, d)), M + "SELECT * FROM met WHERE name NOT IN ('print', 'error', 'console', 'render', 'stringify') AND module <> '' ORDER BY fan_in DESC, name, id LIMIT 10"),
    "dead_symbols": (lambda s, d: metrics.dead_code(_metrics(s, d)), M + "SELECT * FROM met WHERE fan_in = 0 AND kind IN ('function', 'method') AND name NOT IN ('main', '__init__', 'init', 'constructor', 'render', 'handler', 'test', '__main__') AND NOT regexp_matches(name, '(Handler|handler|Test|test)$')"),
    "god_owners": (lambda s, d: metrics.god_objects(_metrics(s, d)), M + "SELECT * FROM met WHERE kind = 'class' AND method_count >= 10"),
    "long_symbols": (lambda s, d: metrics.long_functions(_metrics(s, d)), M + "SELECT * FROM met WHERE kind IN ('function', 'method') AND line_count >= 50"),
    "function_listing": (lambda s, d: metrics.functions(_metrics(s, d), "callers", 20), M + "SELECT * FROM met WHERE kind IN ('function', 'method') ORDER BY fan_in DESC, name, id LIMIT 20"),
    "module_coupling": (lambda s, d: metrics.module_coupling(b.symbols(s, d), b.relations(s, d)), f"WITH {SYM}, {REL} SELECT x.module AS from_module, y.module AS to_module, count(*) AS call_count FROM rel JOIN sym x ON x.id = from_id JOIN sym y ON y.id = to_symbol_id WHERE x.module <> y.module GROUP BY 1, 2"),
    "health_summary": (_health, f"""WITH RECURSIVE {SYM}, {REL}, {MET}, {_IMP}, pth AS (SELECT [src, dst] AS path, src AS low, dst AS tip FROM imp WHERE dst > src UNION ALL SELECT list_append(path, dst), low, dst FROM pth JOIN imp ON tip = src WHERE dst > low AND NOT list_contains(path, dst)),
cyc AS (SELECT path FROM pth JOIN imp ON tip = src AND low = dst), rea AS (SELECT src, dst FROM imp UNION SELECT rea.src, imp.dst FROM rea JOIN imp ON imp.src = rea.dst),
comp AS (SELECT DISTINCT list_sort(list(DISTINCT a.dst)) AS component FROM rea a JOIN rea z ON z.src = a.dst AND z.dst = a.src GROUP BY a.src HAVING count(DISTINCT a.dst) > 1)
SELECT (SELECT count(*) FROM met) AS total_symbols,
(SELECT count(*) FROM met WHERE fan_in = 0 AND kind IN ('function', 'method') AND name NOT IN ('main', '__init__', 'init', 'constructor', 'render', 'handler', 'test', '__main__') AND NOT regexp_matches(name, '(Handler|handler|Test|test)$')) AS dead_code_count,
(SELECT count(*) FROM met WHERE kind = 'class' AND method_count >= 10) AS god_objects_count,
(SELECT string_agg(name || '/' || id || '/' || fan_in || '/' || module, ',' ORDER BY fan_in DESC, name, id) FROM (SELECT * FROM met WHERE module <> '' AND name NOT IN ('print', 'error', 'console', 'render', 'stringify') ORDER BY fan_in DESC, name, id LIMIT 5)) AS hotspots_top_5,
(SELECT string_agg(name || '/' || id || '/' || line_count || '/' || module, ',' ORDER BY line_count DESC, name, id) FROM (SELECT * FROM met WHERE kind IN ('function', 'method') AND line_count >= 50 ORDER BY line_count DESC, name, id LIMIT 5)) AS longest_functions_top_5,
(SELECT count(*) FROM (SELECT DISTINCT x.module AS a, y.module AS c FROM rel JOIN sym x ON x.id = from_id JOIN sym y ON y.id = to_symbol_id WHERE x.module <> y.module)) AS coupling_edges_count,
(SELECT string_agg(a || '/' || c || '/' || n, ',' ORDER BY n DESC, a, c) FROM (SELECT x.module AS a, y.module AS c, count(*) AS n FROM rel JOIN sym x ON x.id = from_id JOIN sym y ON y.id = to_symbol_id WHERE x.module <> y.module GROUP BY 1, 2 ORDER BY n DESC, a, c LIMIT 5)) AS coupling_top_5,
(SELECT count(*) FROM cyc) AS circular_deps_count, (SELECT count(*) FROM comp) AS cyclic_components_count"""),
    "index_stats": (lambda s, d: metrics.index_stats(b.files(s, d), b.symbols(s, d), b.relations(s, d)), f"WITH {SYM}, {REL}, {FIL} SELECT 'files' AS measure, '' AS key, count(*) AS n FROM fil UNION ALL SELECT 'symbols', '', count(*) FROM sym UNION ALL SELECT 'relations', '', count(*) FROM every UNION ALL SELECT 'kind', kind, count(*) FROM sym GROUP BY kind UNION ALL SELECT 'language', language, count(*) FROM fil GROUP BY language"),
    "branch_stats": (lambda s, d: metrics.branch_stats(b.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("branch")), b.table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("file_path"))), "SELECT source AS branch, count(DISTINCT d.doc_id) AS files, count(l.doc_id) AS symbols FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source"),
    "symbol_lookup": (lambda s, d: lookups.symbol(b.symbols(s, d), b.files(s, d), NAME), f"WITH {SYM}, {FIL} SELECT id, name, kind, file_path, start_line, end_line, branch FROM sym JOIN fil ON path = file_path WHERE name = '{NAME}'"),
    "fqid_lookup": (lambda s, d: lookups.by_fqid(b.symbols(s, d), f"{BRAND}.{NAME}").select("id", "name", "fqid"), f"WITH {SYM} SELECT id, name, fqid FROM sym WHERE fqid = '{BRAND}.{NAME}' ORDER BY id LIMIT 1"),
    "callers": (lambda s, d: lookups.callers(b.symbols(s, d), b.relations(s, d), NAME), f"WITH {SYM}, {REL} SELECT name, kind, file_path, start_line, to_name FROM rel JOIN sym ON sym.id = from_id WHERE to_name = '{NAME}'"),
    "imports_of_file": (lambda s, d: _imports_of_first(s, d), """WITH l AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS file_path, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS to_name FROM pages) SELECT * FROM l WHERE file_path = (SELECT min(file_path) FROM l)"""),
    "owned_symbols": (lambda s, d: lookups.owned(b.symbols(s, d), _class_name(s, d)), f"WITH {SYM}, o AS (SELECT min(id) AS k FROM sym WHERE kind = 'class' AND name = (SELECT min(name) FROM sym WHERE kind = 'class')) SELECT id, name, kind, file_path, start_line, end_line, owner_symbol_id FROM sym WHERE owner_symbol_id = (SELECT k FROM o)"),
    "module_symbols": (lambda s, d: lookups.in_module(b.symbols(s, d), BRAND).select("id", "name", "kind"), f"WITH {SYM} SELECT id, name, kind FROM sym WHERE module = '{BRAND}'"),
    "file_list": (lambda s, d: lookups.file_list(b.files(s, d)), f"WITH {FIL} SELECT path, content_hash, branch, language FROM fil"),
    "direct_calls": (lambda s, d: lookups.direct_calls(b.symbols(s, d), b.relations(s, d), NAME), f"WITH {SYM}, {REL} SELECT DISTINCT to_name FROM rel JOIN sym ON sym.id = from_id WHERE name = '{NAME}'"),
    "orphan_symbols": (lambda s, d: lookups.orphans(b.symbols(s, d), b.files(s, d).where("language <> 'ECONOMY'")).select("id"), f"WITH {SYM} SELECT id FROM sym WHERE language = 'ECONOMY'"),
    "resolve_cascade": (lambda s, d: _resolved(s, d), None),
    "resolution_stats": (lambda s, d: metrics.resolution_bands(_resolved(s, d)), None),
    "fts_bm25": (lambda s, d: _rounded(search.bm25(b.symbols(s, d), "id", ["name", "kind", "file_path"], QUERY).withColumnRenamed("doc", "id"), "bm25"), f"WITH {SYM}, {_bm25_sql(QUERY)} SELECT id, round(bm25, 6) AS bm25 FROM bm"),
    "fts_documents": (lambda s, d: _rounded(search.bm25(b.table(s, d, "documents").where("text is not null"), "doc_id", ["text"], "the th").withColumnRenamed("doc", "doc_id"), "bm25"), """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: starts_with(x, 'the'))) AS a, len(list_filter(w, lambda x: starts_with(x, 'th'))) AS b FROM t),
g AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (WHERE a > 0) AS na, count(*) FILTER (WHERE b > 0) AS nb FROM f),
i AS (SELECT n, mean, greatest(1e-6, ln((n - na + 0.5) / (na + 0.5))) AS ia, greatest(1e-6, ln((n - nb + 0.5) / (nb + 0.5))) AS ib FROM g)
SELECT doc_id, round(-(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / mean)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS bm25 FROM f CROSS JOIN i WHERE a > 0 AND b > 0"""),
    "fts_phrase": (lambda s, d: _rounded(search.bm25(b.symbols(s, d), "id", ["name", "kind", "file_path"], PHRASES).withColumnRenamed("doc", "id"), "bm25"), _phrase_sql(PHRASES)),
    "search_ranked": (lambda s, d: _rounded(_rank(s, d).select("id", "name", "composite_score", "rank_position"), "composite_score"), _RANKED + _POSITIONS),
    "search_compat": (lambda s, d: _rounded(_rank(s, d, True).select("id", "name", "composite_score", "rank_position"), "composite_score"), _ranked_sql(True) + _POSITIONS),
    "search_explained": (lambda s, d: _rank(s, d).select("id", search.explanation().alias("said")).select("id", F.substring_index("said", "=", 1).alias("head"), (F.size(F.split("said", "\n")) - 1).alias("factors")), _RANKED + ", r AS (SELECT *, row_number() OVER (ORDER BY f1 + f2 + f3 + f4 + f5 DESC, name, id) AS k FROM sc QUALIFY k <= 20) SELECT id, name || ' (rank #' || k || ', score' AS head, 5 AS factors FROM r"),
    "search_audit": (lambda s, d: _rank(s, d).select("id", F.explode("factors").alias("f")).select("id", F.col("f.name").alias("factor"), F.round("f.contribution", 6).alias("contribution")), _RANKED + ", r AS (SELECT *, row_number() OVER (ORDER BY f1 + f2 + f3 + f4 + f5 DESC, name, id) AS k FROM sc QUALIFY k <= 20) SELECT id, unnest(['text_relevance', 'call_frequency', 'recency', 'name_match', 'code_hub_score']) AS factor, unnest([round(f1, 6), round(f2, 6), round(f3, 6), round(f4, 6), round(f5, 6)]) AS contribution FROM r"),
    "call_graph": (_graph, f"WITH {G} SELECT * FROM gra"),
    "reach_forward": (lambda s, d: _reached(s, d, 3), f"WITH RECURSIVE {G}, {_reach_sql('src', 'dst', 3)} SELECT name, depth FROM rch"),
    "reach_reverse": (lambda s, d: _reached(s, d, 2, True), f"WITH RECURSIVE {G}, {_reach_sql('dst', 'src', 2)} SELECT name, depth FROM rch"),
    "impact_score": (lambda s, d: _rounded(search.impact(_reached(s, d, 2, True), _metrics(s, d)), "impact_score"), f"WITH RECURSIVE {G}, {MET}, {_reach_sql('dst', 'src', 2)}, m1 AS (SELECT name, arg_min(module, id) AS module FROM met GROUP BY name) SELECT count(rch.name) AS impact_count, count(DISTINCT module) AS modules, round(2.0 * ln(1 + count(rch.name)) + CASE WHEN count(rch.name) > 0 THEN ln(1 + count(DISTINCT module)) ELSE 0 END, 6) AS impact_score FROM rch LEFT JOIN m1 ON m1.name = rch.name"),
    "symbol_context": (lambda s, d: _context(s, d), f"""WITH RECURSIVE {G}, {_reach_sql('src', 'dst', 2)}, bk AS (SELECT x AS name, 0 AS depth FROM st UNION SELECT g.src, b.depth + 1 FROM bk b JOIN gra g ON g.dst = b.name WHERE b.depth < 2)
SELECT name, kind, file_path, (SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM gra WHERE src = (SELECT x FROM st)) AS calls, (SELECT coalesce(string_agg(DISTINCT src, ',' ORDER BY src), '') FROM gra WHERE dst = (SELECT x FROM st)) AS called_by,
(SELECT string_agg(name, ',' ORDER BY name) FROM rch) AS callgraph, (SELECT coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') FROM bk WHERE name <> (SELECT x FROM st)) AS impact
FROM sym WHERE name = (SELECT x FROM st) ORDER BY file_path, start_line, id LIMIT 1"""),
    "import_graph": (_imports, f"WITH {_IMP} SELECT src, dst FROM imp"),
    "import_cycles": (lambda s, d: graph.simple_cycles(_imports(s, d)).select(F.array_join("cycle", ",").alias("cycle"), F.size("cycle").alias("n")), f"""WITH RECURSIVE {_IMP},
p AS (SELECT [src, dst] AS path, src AS low, dst AS tip FROM imp WHERE dst > src UNION ALL SELECT list_append(path, dst), low, dst FROM p JOIN imp ON tip = src WHERE dst > low AND NOT list_contains(path, dst))
SELECT array_to_string(path, ',') AS cycle, len(path)::INTEGER AS n FROM p JOIN imp ON tip = src AND low = dst"""),
    "import_components": (lambda s, d: graph.cyclic_components(_imports(s, d)).select(F.array_join("component", ",").alias("component")), f"""WITH RECURSIVE {_IMP}, r AS (SELECT src, dst FROM imp UNION SELECT r.src, imp.dst FROM r JOIN imp ON imp.src = r.dst),
c AS (SELECT a.src, list_sort(list(DISTINCT a.dst)) AS component FROM r a JOIN r z ON z.src = a.dst AND z.dst = a.src GROUP BY a.src) SELECT DISTINCT array_to_string(component, ',') AS component FROM c WHERE len(component) > 1"""),
    "incremental_status": (lambda s, d: incremental.status(*reversed(_old_new(s, d))).select("path", "status"), """WITH o AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha1(text) END AS h FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id::VARCHAR AS path, sha1(text) AS h FROM documents WHERE doc_id % 10 <> 1)
SELECT path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'orphan' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS status FROM o FULL JOIN n USING (path)"""),
    "orphan_purge": (lambda s, d: incremental.without(_old_new(s, d)[0], _old_new(s, d)[1]).select("path"), "SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id % 10 NOT IN (0, 1)"),
    "debounce_sessions": (lambda s, d: watch.debounce(_stream_events(s, d), "30 minutes", F.struct("ts", "event_id")).select("path", "kind", "n", F.col("last_ts").cast("timestamp_ntz").alias("last_ts")), """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
x AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT user_id::VARCHAR AS path, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS kind, count(*) AS n, max(ts) AS last_ts FROM x GROUP BY user_id, grp"""),
    "keyword_extract": (lambda s, d: b.table(s, d, "documents").select("doc_id", F.array_join(scalars.keywords(F.col("text")), " ").alias("keywords")), "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(coalesce(text, ''), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: length(w) > 2 AND NOT list_contains(" + str(scalars.STOP_WORDS) + ", lower(w))), ' ') AS keywords FROM documents"),
    "token_estimates": (lambda s, d: b.table(s, d, "documents").select("doc_id", scalars.token_estimate(F.col("text")).alias("tokens")), "SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents"),
    "context_trim": (lambda s, d: b.table(s, d, "documents").select("doc_id", F.sha1(scalars.trim_to(F.col("text"), 100).cast("binary")).alias("digest")), """WITH h AS (SELECT doc_id, text, left(text, 400) AS h FROM documents), c AS (SELECT *, length(h) - instr(reverse(h), chr(10)) AS k FROM h)
SELECT doc_id, sha1(CASE WHEN length(text) <= 400 THEN text ELSE CASE WHEN contains(h, chr(10)) AND k > 200 THEN left(h, k) ELSE h END || chr(10) || chr(10) || '[... context trimmed to fit token budget ...]' END) AS digest FROM c"""),
    "span_hashes": (lambda s, d: _halves(s, d), "SELECT doc_id, substr(sha1(array_to_string(l[1:len(l) // 2], chr(10))), 1, 16) AS head, substr(sha1(array_to_string(l[len(l) // 2 + 1:len(l)], chr(10))), 1, 16) AS tail FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"),
    "name_overlap": (lambda s, d: b.table(s, d, "part").select("p_partkey", scalars.name_overlap(F.array(F.lit("Red"), F.lit("gear")), F.translate("p_name", " ", "_")).alias("n")), "SELECT p_partkey, len(list_intersect(['red', 'gear'], string_split(replace(lower(p_name), ' ', '_'), '_')))::INTEGER AS n FROM part"),
    "module_paths": (lambda s, d: _paths(s, d), r"SELECT page_id, regexp_replace(array_to_string(list_filter(string_split(regexp_replace(p, '\.(py|go|js|jsx|mjs|cjs|ts|tsx)$', '', 'i'), '/'), lambda x: x <> '' AND x <> '.'), '.'), '(^|\.)__init__$', '') AS module, regexp_matches(lower(p), '\.(py|go|js|jsx|mjs|cjs|ts|tsx)$') AND NOT list_has_any(string_split(p, '/'), ['build', 'dist', 'vendor']) AS indexable FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'src/m' || page_id || '/__init__.py' WHEN 1 THEN 'build/x' || page_id || '.go' WHEN 2 THEN 'web/y' || page_id || '.TSX' ELSE 'doc/z' || page_id || '.md' END AS p FROM pages)"),
}


def _imports_of_first(s: SparkSession, d: str) -> DataFrame:
    symbols, relations = b.page_imports(s, d)
    first = symbols.join(relations.select(F.col("from_id").alias("id")), "id", "left_semi").agg(F.min("file_path").alias("x")).first()["x"]
    return lookups.imports_of(symbols, relations, first if first is not None else "")


def _class_name(s: SparkSession, d: str) -> str:
    got = b.symbols(s, d).where("kind = 'class'").agg(F.min("name").alias("x")).first()["x"]
    return got if got is not None else ""


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(b.symbols(s, d), b.references(s, d), b.aliases(s, d))


_REF = f"""WITH {SYM}, {REL},
ref AS (SELECT from_id * 1000000 + to_symbol_id AS id, from_id, CASE k WHEN 0 THEN fqid WHEN 2 THEN 'al_' || to_name WHEN 3 THEN to_name || ' gone' ELSE to_name END AS to_name,
  CASE k WHEN 1 THEN 'mod_' || module || '.' || to_name ELSE to_name END AS expr, relation IN ('CALLS', 'INHERITS') AS linked FROM (SELECT r.*, s.fqid, s.module, (r.from_id + r.to_symbol_id) % 6 AS k FROM every r JOIN sym s ON s.id = r.to_symbol_id)),
ali AS (SELECT file_path, alias, arg_max(target, id) AS target FROM (SELECT file_path, 'mod_' || module AS alias, module AS target, 0 AS id FROM sym UNION ALL SELECT file_path, 'al_' || name, fqid, id FROM sym) GROUP BY 1, 2),
fq AS (SELECT fqid, max(id) AS id FROM sym GROUP BY 1), nm AS (SELECT name, min(id) AS id, count(*) AS n FROM sym GROUP BY 1),
res AS (SELECT ref.id, ref.from_id, ref.to_name, linked, CASE WHEN linked THEN coalesce(f1.id, f2.id, f3.id, nm.id) END AS to_symbol_id,
  CASE WHEN NOT linked THEN NULL WHEN f1.id IS NOT NULL THEN 1.0 WHEN f2.id IS NOT NULL THEN 0.9 WHEN f3.id IS NOT NULL THEN 0.8 WHEN nm.n = 1 THEN 0.7 WHEN nm.n > 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence
  FROM ref JOIN sym s ON s.id = ref.from_id LEFT JOIN fq f1 ON f1.fqid = ref.to_name AND contains(ref.to_name, '.')
  LEFT JOIN ali a2 ON a2.file_path = s.file_path AND contains(ref.expr, '.') AND a2.alias = string_split(ref.expr, '.')[1]
  LEFT JOIN fq f2 ON f2.fqid = a2.target || '.' || substr(ref.expr, instr(ref.expr, '.') + 1)
  LEFT JOIN ali a3 ON a3.file_path = s.file_path AND a3.alias = ref.to_name LEFT JOIN fq f3 ON f3.fqid = a3.target LEFT JOIN nm ON nm.name = ref.to_name)
"""
QUERIES["resolve_cascade"] = (lambda s, d: _resolved(s, d).select("id", "from_id", "to_name", "to_symbol_id", "confidence"), _REF + "SELECT * EXCLUDE (linked) FROM res")
QUERIES["resolution_stats"] = (QUERIES["resolution_stats"][0], _REF + "SELECT count(*) AS total, count(*) FILTER (WHERE to_symbol_id IS NOT NULL AND confidence >= 0.9) AS exact, count(*) FILTER (WHERE to_symbol_id IS NOT NULL AND confidence >= 0.7 AND confidence < 0.9) AS good, count(*) FILTER (WHERE to_symbol_id IS NOT NULL AND confidence < 0.7) AS weak, count(*) FILTER (WHERE to_symbol_id IS NULL) AS unresolved FROM res WHERE linked")


def _context(s: SparkSession, d: str) -> DataFrame:
    g = _graph(s, d)
    row = graph.context(b.symbols(s, d), b.relations(s, d), _metrics(s, d), _start(g), 2, g)
    return row.select("name", "kind", "file_path", *[F.array_join(c, ",").alias(c) for c in ("calls", "called_by", "callgraph", "impact")])


def _halves(s: SparkSession, d: str) -> DataFrame:
    """Hashes of both halves of each text's lines."""
    n = F.size(F.split("text", "\n"))
    half = F.floor(n / 2).cast("int")
    return b.table(s, d, "documents").select("doc_id", scalars.span_hash(F.col("text"), F.lit(1), half + 1).alias("head"), scalars.span_hash(F.col("text"), half + 1, n + 1).alias("tail"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("src/m"), k, F.lit("/__init__.py"))).when(k % 4 == 1, F.concat(F.lit("build/x"), k, F.lit(".go"))).when(k % 4 == 2, F.concat(F.lit("web/y"), k, F.lit(".TSX"))).otherwise(F.concat(F.lit("doc/z"), k, F.lit(".md")))
    return b.table(s, d, "pages").select("page_id", path.alias("p")).select("page_id", scalars.module_of(F.col("p")).alias("module"), scalars.is_indexable(F.col("p")).alias("indexable"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
