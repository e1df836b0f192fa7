"""Queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, neardup, quality, sharding, tokencount, toxicity, urlrules, warc
from .common import stored

#: The rules of the URL query as (action, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(_table(spark, sf_dir, "documents"))


def quality_base_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.base_stats(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "stats.n_words", "stats.word_chars", "stats.n_symbols", "stats.n_dup_lines", "stats.n_repeat_words", "stats.base_failed")


def op2_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model)


def op3_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = langid.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    scored = toxicity.score(docs.select("doc_id", "text", held.alias("held_out")), model)
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), urlrules.rules_table(spark, URL_RULES))


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_warc(_table(spark, sf_dir, "pages"))
    back = warc.read_warc(spark, path, with_payload=False)
    return back.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def sample_edits(text: str = "text"):
    """Three edits of a text: at each quarter, the characters up to 12 on give way to the text's first 9."""
    n = F.coalesce(F.length(text), F.lit(0))
    one = lambda k: F.struct((n * k / 4).cast("int").alias("start"), F.lit(12).alias("removed"), F.coalesce(F.substring(text, 1, 9), F.lit("")).alias("inserted"))
    return F.array(*[one(k) for k in (1, 2, 3)])


def op10_edit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts every text once and keeps its tree, then applies three edits to the kept trees."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = stored(tokencount.count_edits(docs, "text", with_state=True).select("doc_id", F.col("new_text").alias("text"), "leaf_chars", "leaf_tokens"))
    return tokencount.count_edits(kept.withColumn("edits", sample_edits()), "text", "edits", state=("leaf_chars", "leaf_tokens"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_mcd, op2_language_centroids, op3_toxicity_fm, op4_jump_shards, op5_lsh_forest, op6_url_rules, op7_spaced_seeds, op8_warc_salvage, op9_fair_mix, op10_edit_tokens, quality_base_stats, pipeline)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_BASE = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, t, w,
             CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')) ELSE [] END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM e) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
s AS (SELECT g.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
             coalesce(c.n, 0) AS n_repeat_words
      FROM g LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed
FROM s"""

#: One step of the generator and of the jump, unrolled: with n shards at most n jumps happen.
def _jumps(n: int, name: str) -> str:
    steps, src = [], "keys"
    for i in range(n):
        steps.append(f"""{name}{i} AS (SELECT *, CASE WHEN {name}_j < {n} THEN {name}_j ELSE {name}_b END AS {name}_b2,
  CASE WHEN {name}_j < {n} THEN ({name}_k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT ELSE {name}_k END AS {name}_k2,
  CASE WHEN {name}_j < {n} THEN floor(({name}_j + 1) * (2147483648.0::DOUBLE / ((((({name}_k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT) // 8589934592::HUGEINT) + 1)::DOUBLE)))::BIGINT ELSE {name}_j END AS {name}_j2
  FROM {src}),
{name}{i}r AS (SELECT row_id, k, {name}_b2 AS {name}_b, {name}_k2 AS {name}_k, {name}_j2 AS {name}_j FROM {name}{i})""")
        src = f"{name}{i}r"
    return ",\n".join(steps)


def _crc_table() -> str:
    """The 256 remainders of the checksum's polynomial, by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(f"{c}::BIGINT")
    return f"[{', '.join(out)}]"


_CRC = f"""
crc AS (SELECT row_id, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
        lambda c, b: xor(c // 256, {_crc_table()}[1 + (xor(c, b) % 256)])), 4294967295) AS text_crc32 FROM docs)"""

_SHARDS = f"""
WITH docs AS (SELECT doc_id, text, row_number() OVER () AS row_id FROM documents),
keys AS (SELECT row_id, k, 0::BIGINT AS a_b, k AS a_k, 0::BIGINT AS a_j, 0::BIGINT AS z_b, k AS z_k, 0::BIGINT AS z_j
         FROM (SELECT row_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::HUGEINT AS k FROM docs)),
{_jumps(8, 'a')},
{_jumps(9, 'z')},
{_CRC.strip()},
r AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, text_crc32::BIGINT AS text_crc32, a_b::INTEGER AS shard, z_b::INTEGER AS grown_shard
      FROM docs JOIN a7r USING (row_id) JOIN z8r USING (row_id) JOIN crc USING (row_id))
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM r"""

_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n_shingles + y.n_shingles - both_n)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT u.b, c.root FROM c JOIN u ON u.a = c.node)
SELECT n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN (SELECT node, min(root) AS component_id FROM c GROUP BY node) m ON m.node = n.doc_id"""

_URLS = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
h AS (SELECT page_id, x, regexp_extract(x, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(x, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(action, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, action, rh || rp AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)"""

_WARC = """
WITH b AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, upper(sha1(body)) AS hex FROM b),
q AS (SELECT page_id, payload_bytes,
        array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda k:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 5 * g, 5))::BIGINT) >> (15 - 5 * k)) & 31)::INTEGER, 1)), '')), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM q)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

_MIX = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER] AS weight FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(2 * source_size) OVER k, 0)::DOUBLE AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER k, 0) AS weights,
             row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS place
      FROM w WINDOW k AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 2 * source_size * weights <= weight * rest AS capped FROM o),
l AS (SELECT rest AS level_rest, weights AS level_weights FROM c WHERE NOT capped ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE weight * (SELECT level_rest FROM l) / (SELECT level_weights FROM l) END AS target FROM c),
q AS (SELECT d.doc_id, d.size, d.key, t.source, t.source_size, t.target, sum(d.size) OVER (PARTITION BY t.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS done
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (done + p * source_size)::DOUBLE / target AS f FROM q, (VALUES (0), (1)) v(p) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY f, key, source NULLS LAST, p ROWS UNBOUNDED PRECEDING) AS upto FROM e),
x AS (SELECT doc_id, sum(size) AS taken FROM r WHERE upto <= (SELECT sum(target) FROM t) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(x.taken, 0)::BIGINT AS taken FROM q LEFT JOIN x USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"quality_base_stats": _BASE, "op4_jump_shards": _SHARDS, "op5_lsh_forest": _NEAR, "op6_url_rules": _URLS, "op8_warc_salvage": _WARC, "op9_fair_mix": _MIX}
