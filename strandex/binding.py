"""The driver's tables in the roles of a code index: parts are symbols, consecutive line items are relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The kind of an order's relations by the first digit of its priority.
KINDS = {"1": "CALLS", "2": "IMPORTS", "3": "INHERITS", "4": "DEFINES"}
OTHER = "USES"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of a brand is its class, the others are functions and methods of it by parity."""
    part = table(spark, sf_dir, "part")
    first = part.groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    p = part.join(first, "p_brand")
    kind = F.when(F.col("p_partkey") == F.col("first"), "class").when(F.col("p_partkey") % 2 == 0, "function").otherwise("method")
    owner = F.when(F.col("p_partkey") != F.col("first"), F.col("first"))
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), F.concat_ws("/", "p_brand", "p_type").alias("file_path"),
        F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"), F.lit("").alias("hash"), F.col("p_type").alias("language"),
        F.concat_ws(".", "p_brand", "p_name").alias("fqid"), F.col("p_brand").alias("module"), owner.alias("owner_symbol_id"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (brand, type) pairs; the time of a file is its smallest part key plus 1."""
    part = table(spark, sf_dir, "part")
    rows = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("k"))
    return rows.select(F.concat_ws("/", "p_brand", "p_type").alias("path"), F.sha1(F.concat_ws("/", "p_brand", "p_type").cast("binary")).alias("content_hash"), F.col("p_brand").alias("branch"), F.col("p_type").alias("language"), (F.col("k") + 1).alias("last_indexed_at"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item refers to the next of its order (by line, part, supplier); the order's priority gives the kind."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = items.select("l_orderkey", F.col("l_partkey").alias("from_id"), F.lead("l_partkey").over(order).alias("to_symbol_id")).where("to_symbol_id is not null")
    digit = F.substring("o_orderpriority", 1, 1)
    kind = F.coalesce(*[F.when(digit == k, v) for k, v in KINDS.items()], F.lit(OTHER))
    pairs = pairs.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), kind.alias("relation")), "l_orderkey")
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("to_symbol_id"), F.col("p_name").alias("to_name"))
    return pairs.join(names, "to_symbol_id").select(F.lit(0).cast("long").alias("id"), "from_id", "relation", "to_name", "to_symbol_id", F.lit(1.0).alias("confidence"), F.lit("").alias("call_expression"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page hosts import the targets of their links, unresolved."""
    pages = table(spark, sf_dir, "pages").select("url", "html")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), 1))
    return pages.select(host.alias("file_path"), target.alias("to_name"))


def page_imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and relations of the same: one sentinel for each host that links, numbered by its first page."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("file_path"))
    symbols = pages.groupBy("file_path").agg(F.min("page_id").alias("id"))
    return symbols, links(spark, sf_dir).join(symbols, "file_path").select(F.col("id").alias("from_id"), F.lit("IMPORTS").alias("relation"), "to_name")


def nation_imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, relations and modules of nations that import each other: by the last part of a path, and by name."""
    nation = table(spark, sf_dir, "nation")
    path = F.concat(F.lit("src/"), "n_name", F.lit(".py"))
    symbols = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("<module>").alias("name"), path.alias("file_path"))
    modules = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), path.alias("path"))
    k = F.col("n_nationkey")
    wanted = nation.select(k.cast("long").alias("from_id"), F.explode(F.array(F.struct(((2 * k + 1) % 25).alias("to"), F.lit("example.com/pkg/").alias("head")), F.struct(((k + 1 + F.col("n_regionkey")) % 25).alias("to"), F.lit("").alias("head")))).alias("w"))
    names = nation.select(k.alias("to"), F.col("n_name").alias("target"))
    relations = wanted.select("from_id", "w.*").join(names, "to").select("from_id", F.lit("IMPORTS").alias("relation"), F.concat("head", "target").alias("to_name"))
    return symbols, relations, modules


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations rewritten so that every rule of the cascade has work: by remainder of both ends."""
    s = symbols(spark, sf_dir).select(F.col("id").alias("to_symbol_id"), "fqid", "module")
    r = relations(spark, sf_dir).join(s, "to_symbol_id")
    k = (F.col("from_id") + F.col("to_symbol_id")) % 6
    name = F.when(k == 0, F.col("fqid")).when(k == 2, F.concat(F.lit("al_"), "to_name")).when(k == 3, F.concat("to_name", F.lit(" gone"))).otherwise(F.col("to_name"))
    expr = F.when(k == 1, F.concat(F.lit("mod_"), "module", F.lit("."), "to_name")).otherwise(F.lit(""))
    rid = F.col("from_id") * 1_000_000 + F.col("to_symbol_id")
    return r.select(rid.alias("id"), "from_id", "relation", name.alias("to_name"), F.lit(None).cast("long").alias("to_symbol_id"), F.lit(None).cast("double").alias("confidence"), expr.alias("call_expression"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each file: ``mod_<brand>`` for its own brand, and ``al_<name>`` for its parts."""
    s = symbols(spark, sf_dir)
    mods = s.select("file_path", F.concat(F.lit("mod_"), "module").alias("alias"), F.col("module").alias("resolved_fqid")).distinct().withColumn("id", F.lit(0).cast("long"))
    names = s.select("file_path", F.concat(F.lit("al_"), "name").alias("alias"), F.col("fqid").alias("resolved_fqid"), "id")
    return mods.unionByName(names)
