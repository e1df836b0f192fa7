"""Entity linking: references to symbols by a confidence cascade.

Three small indexes (qualified name, alias in file, plain name) are grouped once, each join is an equi-join that AQE
may broadcast, and the cascade is one expression.  Order decides ties: qualified names and aliases last by id, plain
names first by id.  All rows are recomputed, so a second run changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that null join keys are dealt over.
SPREAD = 4096


def resolve(symbols: DataFrame, relations: DataFrame, aliases: DataFrame, by_path: bool = False) -> DataFrame:
    """``relations`` with ``to_symbol_id`` and ``confidence`` set for calls and bases; other rows as they were.

    ``by_path``: symbols are ordered by file and id instead of the id alone."""
    named = symbols.where("kind <> 'module'")
    order = F.struct("file_path", "id") if by_path else F.col("id")
    fqids = named.where("fqid <> ''").groupBy("fqid").agg(F.max_by("id", order).alias("fq_id"))
    names = named.groupBy("name").agg(F.min_by("id", order).alias("name_id"), F.count(F.lit(1)).alias("name_n"))
    scope = aliases.groupBy("file_path", "alias").agg(F.max_by("resolved_fqid", "id").alias("target"))
    files = symbols.select(F.col("id").alias("from_id"), "file_path")

    subject = F.col("relation").isin("CALLS", "INHERITS")
    expr = F.when(F.coalesce(F.col("call_expression"), F.lit("")) == "", F.col("to_name")).otherwise(F.col("call_expression"))
    dotted = F.instr(expr, ".") > 0
    rows = relations.where(subject).join(files, "from_id", "left")
    rows = rows.withColumn("_obj", F.when(dotted, F.substring_index(expr, ".", 1))).withColumn("_attr", F.when(dotted, F.substring(expr, F.instr(expr, ".") + 1, F.length(expr))))
    rows = rows.withColumn("_full", F.when(F.instr("to_name", ".") > 0, F.col("to_name")))

    alias = lambda on, as_: scope.select("file_path", F.col("alias").alias(on), F.col("target").alias(as_))
    fq = lambda on, as_: fqids.select(F.col("fqid").alias(on), F.col("fq_id").alias(as_))
    # most keys are null; each null becomes one of many texts that name nothing, so no task gets them all
    spread = lambda c: F.coalesce(c, F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("from_id", "to_name"), F.lit(SPREAD)).cast("string")))
    rows = rows.withColumn("_obj", spread(F.col("_obj")))
    rows = rows.join(alias("_obj", "_base"), ["file_path", "_obj"], "left").join(alias("to_name", "_plain"), ["file_path", "to_name"], "left")
    rows = rows.withColumns({"_member": spread(F.concat("_base", F.lit("."), "_attr")), "_full": spread(F.col("_full")), "_plain": spread(F.col("_plain"))})
    rows = rows.join(fq("_full", "_id1"), "_full", "left").join(fq("_member", "_id2"), "_member", "left").join(fq("_plain", "_id3"), "_plain", "left")
    rows = rows.join(names.select(F.col("name").alias("to_name"), "name_id", "name_n"), "to_name", "left")
    confidence = F.when(F.col("_id1").isNotNull(), 1.0).when(F.col("_id2").isNotNull(), 0.9).when(F.col("_id3").isNotNull(), 0.8).when(F.col("name_n") == 1, 0.7).when(F.col("name_n") > 1, 0.5).otherwise(0.0)
    linked = rows.withColumn("to_symbol_id", F.coalesce("_id1", "_id2", "_id3", "name_id")).withColumn("confidence", confidence)
    return linked.select(*relations.columns).unionByName(relations.where(~subject))


def resolution_stats(resolved: DataFrame) -> DataFrame:
    rows = resolved.where(F.col("relation").isin("CALLS", "INHERITS"))
    linked = F.col("to_symbol_id").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(linked & (F.col("confidence") >= 0.7)).alias("resolved"), F.count_if(linked & (F.col("confidence") < 0.7)).alias("partially_resolved"), F.count_if(~linked).alias("unresolved"))
