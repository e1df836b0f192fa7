"""Point lookups over files, symbols, relations and aliases.  Results carry explicit order keys; filters reach
the scan, and the side a filter leaves is the one that AQE may broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is(column: str, value) -> Column:
    return F.col(column) == (value if isinstance(value, Column) else F.lit(value))


def symbol(symbols: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Exact name, with the file's branch and language, by file and line."""
    hit = symbols.where(_is("name", name))
    return hit.join(files.select(F.col("path").alias("file_path"), "branch"), "file_path").select("id", "name", "kind", "file_path", "start_line", "end_line", "branch").orderBy("file_path", "start_line", "id")


def by_fqid(symbols: DataFrame, fqid: str) -> DataFrame:
    """The first symbol with that qualified name."""
    return symbols.where(_is("fqid", fqid)).orderBy("id").limit(1)


def callers(symbols: DataFrame, relations: DataFrame, name: str) -> DataFrame:
    """Callers by the called name; one row for each call, repeats kept."""
    calls = relations.where((F.col("relation") == "CALLS") & _is("to_name", name)).select("from_id", "to_name")
    return calls.join(symbols, calls["from_id"] == symbols["id"]).select("name", "kind", "file_path", "start_line", "to_name").orderBy("file_path", "start_line", "name")


def imports_of(symbols: DataFrame, relations: DataFrame, path: str) -> DataFrame:
    """Import targets of a file, repeats kept."""
    own = symbols.where(_is("file_path", path)).select("id", "file_path")
    return relations.where("relation = 'IMPORTS'").join(own, F.col("from_id") == own["id"]).select("file_path", "to_name").orderBy("to_name")


def aliases_of(aliases: DataFrame, path: str) -> DataFrame:
    return aliases.where(_is("file_path", path)).orderBy("alias", "id")


def owned(symbols: DataFrame, class_name: str) -> DataFrame:
    """Symbols owned by the first class of that name, by line."""
    owner = symbols.where((F.col("kind") == "class") & _is("name", class_name)).agg(F.min("id").alias("owner"))
    return symbols.join(owner, symbols["owner_symbol_id"] == owner["owner"]).select("id", "name", "kind", "file_path", "start_line", "end_line", "owner_symbol_id").orderBy("start_line", "id")


def in_module(symbols: DataFrame, module: str) -> DataFrame:
    return symbols.where(_is("module", module) & (F.col("kind") != "module")).orderBy("kind", "name", "id")


def file_list(files: DataFrame) -> DataFrame:
    return files.select("path", "content_hash", "branch", "language").orderBy("path")


def file_hash(files: DataFrame, path: str) -> DataFrame:
    return files.where(_is("path", path)).select("content_hash")


def direct_calls(symbols: DataFrame, relations: DataFrame, name: str) -> DataFrame:
    """Distinct names that symbols of this name call."""
    own = symbols.where(_is("name", name)).select("id")
    return relations.where("relation = 'CALLS'").join(own, F.col("from_id") == own["id"]).select("to_name").distinct().orderBy("to_name")


def orphans(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Integrity check: symbols whose file is unknown."""
    return symbols.join(files, symbols["file_path"] == files["path"], "left_anti")
