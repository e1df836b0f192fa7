"""File discovery and extraction as DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..functions.scalars import LANGUAGES, SKIP_DIRS, fqid_of, is_indexable, language_of, module_of, span_hash
from . import extract

_OUT = "path string, error string, symbols array<struct<name:string,kind:string,start_line:int,end_line:int,owner:string>>, relations array<struct<from_symbol:string,ordinal:int,relation:string,to_name:string,call_expression:string>>, aliases array<struct<alias:string,source_module:string,source_name:string>>"


#: Bits of an id below its path's hash, bits of the hash, and paths that may share one hash: the two bits above it tell them apart.
ORDINAL_BITS, HASH_BITS, TURNS = 22, 40, 4


def path_hash() -> Column:
    """40 bits of the hash of ``path``, never negative."""
    return F.expr("xxhash64(path) & 1099511627775L")


def hash_in(id: Column) -> Column:
    """The path's hash that an id holds."""
    return F.shiftright(id, ORDINAL_BITS).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def turn_in(id: Column) -> Column:
    """The turn of the path among paths of its hash that an id holds."""
    return F.shiftrightunsigned(id, ORDINAL_BITS + HASH_BITS).cast("int")


def turns(paths: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``path, turn`` of the paths whose hash another path has too: by path, the turns that ``held`` (path, turn) leaves free.

    More than ``TURNS`` paths of one hash are an error."""
    rows = paths.select("path", F.lit(None).cast("int").alias("turn"))
    rows = rows.unionByName(held.select("path", "turn")) if held is not None else rows
    alike = Window.partitionBy("hash")
    few = rows.withColumn("hash", path_hash()).withColumn("n", F.count(F.lit(1)).over(alike)).where("n > 1")
    groups = few.groupBy("hash").agg(F.sort_array(F.collect_set(F.when(F.col("turn").isNull(), F.col("path")))).alias("wait"), F.collect_set("turn").alias("taken"))
    free = F.array_except(F.array(*[F.lit(t) for t in range(TURNS)]), F.col("taken"))
    dealt = groups.select(free.alias("free"), F.posexplode("wait").alias("at", "path"))
    return dealt.select("path", F.coalesce(F.get("free", F.col("at")), F.raise_error(F.concat(F.lit("no id is free for "), F.col("path"))).cast("int")).alias("turn"))


#: Bytes of files that the driver holds at a time, and paths that are read one by one rather than by a scan.
PIECE_BYTES, MOST_PATHS = 32 << 20, 10_000
_SUFFIXES = "*.{" + ",".join(sorted({x for e in LANGUAGES for x in (e[1:], e[1:].upper())})) + "}"
_CONTENT = "path string, content binary"


def _hidden(path: str) -> bool:
    """Whether Spark's listing leaves a path out (a part with a leading ``_`` or ``.``, such as ``__init__.py``)."""
    return any(p[:1] in "_." for p in path.split("/"))


def _wanted(path: str) -> bool:
    return not set(path.split("/")) & set(SKIP_DIRS) and f".{path.rpartition('.')[2].lower()}" in LANGUAGES


class _Tree:
    """A folder on any Hadoop file system, and paths below it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, jvm = spark, spark._jvm
        self.path, self.io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self.base = self.path(root)
        self.fs = self.base.getFileSystem(spark._jsc.hadoopConfiguration())
        self.top = self.fs.makeQualified(self.base).toString().rstrip("/")

    def hidden(self) -> Iterator[str]:
        found = self.fs.listFiles(self.base, True)
        while found.hasNext():
            path = found.next().getPath().toString()[len(self.top) + 1 :]
            if _hidden(path) and _wanted(path):
                yield path

    def is_file(self, path: str) -> bool:
        at = self.path(f"{self.top}/{path}")
        return self.fs.exists(at) and self.fs.getFileStatus(at).isFile()

    def read_hidden(self, paths: Iterable[str]) -> DataFrame:
        """Files that Spark does not list go through the driver, ``PIECE_BYTES`` at a time; pieces beyond the first
        are written to the shared folder before the next is read.  A file that cannot be read has a null content."""
        rows, size, folder = [], 0, None
        for path in paths:
            try:
                stream = self.fs.open(self.path(f"{self.top}/{path}"))
                try:
                    rows.append((path, bytearray(self.io.toByteArray(stream))))
                finally:
                    stream.close()
            except Py4JJavaError:
                rows.append((path, None))
            size += len(rows[-1][1] or b"")
            if size >= PIECE_BYTES:
                folder = folder or f"{shared_folder(self.spark)}/hidden-{uuid.uuid4().hex}"
                self.spark.createDataFrame(rows, _CONTENT).write.mode("append").parquet(folder)
                rows, size = [], 0
        last = self.spark.createDataFrame(rows, _CONTENT)
        return last if folder is None else self.spark.read.schema(_CONTENT).parquet(folder).unionByName(last)

    def listed(self, *paths: str) -> DataFrame:
        """``path, content`` of files that Spark lists: of the whole tree, or of the given paths.  Files that cannot be read are left out."""
        reader = self.spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
        reader = reader if paths else reader.option("recursiveFileLookup", "true").option("pathGlobFilter", _SUFFIXES)
        files = reader.load([f"{self.top}/{p}" for p in paths] if paths else [self.top])
        return files.select(F.expr(f"substring(path, {len(self.top) + 2})").alias("path"), "content")


def _sources(found: DataFrame) -> DataFrame:
    rows = found.where("content is not null").select("path", F.col("content").cast("string").alias("source"), F.sha1("content").alias("content_hash"))
    return rows.where(is_indexable(F.col("path"))).withColumn("language", language_of(F.col("path")))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below the root), ``source, content_hash, language`` of every file that can be indexed and read."""
    tree = _Tree(spark, root)
    return _sources(tree.listed().unionByName(tree.read_hidden(tree.hidden())))


def paths_in(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every file that can be indexed, whether it can be read or not."""
    tree = _Tree(spark, root)
    more = spark.createDataFrame([(p,) for p in tree.hidden()], "path string")
    return tree.listed().select("path").where(is_indexable(F.col("path"))).unionByName(more)


def scan_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The same as ``scan`` for the given paths alone: nothing else is listed or read.  Paths that are no file are left out."""
    tree = _Tree(spark, root)
    there = [p for p in dict.fromkeys(paths) if _wanted(p) and tree.is_file(p)]
    plain, rest = [p for p in there if not _hidden(p)], [p for p in there if _hidden(p)]
    found = tree.read_hidden(rest)
    return _sources(found.unionByName(tree.listed(*plain)) if plain else found)


def extract_files(sources: DataFrame) -> DataFrame:
    """``path, source, language`` to one row of nested symbols, relations and aliases for each file.

    The extractors travel with the function, so workers need no package."""
    cloudpickle.register_pickle_by_value(extract)
    one = extract.extract

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, source, language in zip(b["path"], b["source"], b["language"], strict=True):
                x = one(language, source or "")
                rows.append((path, x.error, x.symbols, x.relations, x.aliases))
            yield pd.DataFrame(rows, columns=["path", "error", "symbols", "relations", "aliases"])

    return sources.select("path", "source", "language").mapInPandas(run, _OUT)


def tables(sources: DataFrame, extracted: DataFrame, compat: bool = False, held: DataFrame | None = None) -> dict[str, DataFrame]:
    """Symbols (module sentinels included), relations and aliases with ids.

    An id is 40 bits of the path's hash and the symbol's ordinal, so files do not move each other's ids; paths of equal hashes
    are told apart by two bits above it (``held``: path and turn of those that have ids already).  Relations bind to their symbol
    by ordinal; ``compat`` binds by name, the last of a file winning.
    """
    turn = F.shiftleft(F.coalesce(F.col("turn"), F.lit(0)).cast("long"), ORDINAL_BITS + HASH_BITS)
    key = F.col("key")
    # texts are larger than Spark estimates from their columns' types: they are sorted by path, never broadcast
    known = extracted.join(sources.select("path", "source", "language").hint("merge"), "path").withColumn("module", module_of(F.col("path")))
    known = known.join(turns(sources, held).hint("merge"), "path", "left").withColumn("key", F.shiftleft(path_hash(), ORDINAL_BITS).bitwiseOR(turn))
    s = known.select("path", "key", "source", "language", "module", F.posexplode("symbols").alias("ordinal", "s")).select("path", "key", "source", "language", "module", "ordinal", "s.*")
    s = s.withColumn("id", key + F.col("ordinal") + 1).withColumn("fqid", fqid_of(F.col("module"), F.col("name"), F.col("owner")))
    classes = s.where("fqid <> ''").groupBy("path", F.col("fqid").alias("owner_fqid")).agg(F.max("id").alias("owner_symbol_id"))
    owner = F.when((F.col("owner") != "") & (F.col("fqid") != ""), F.regexp_replace("fqid", r"\.[^.]*$", ""))
    s = s.withColumn("owner_fqid", owner).join(classes, ["path", "owner_fqid"], "left")
    symbols = s.select("id", "name", "kind", F.col("path").alias("file_path"), "start_line", "end_line", span_hash(F.col("source"), F.col("start_line"), F.col("end_line")).alias("hash"), "language", "fqid", "module", "owner_symbol_id")
    top = known.where(F.exists("relations", lambda r: r["from_symbol"] == "<module>"))
    sentinel = top.select(key.alias("id"), F.lit("<module>").alias("name"), F.lit("module").alias("kind"), F.col("path").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit("").alias("hash"), "language", F.col("module").alias("fqid"), "module", F.lit(None).cast("long").alias("owner_symbol_id"))
    r = known.select("path", "key", F.posexplode("relations").alias("rpos", "r")).select("path", "key", "rpos", "r.*")
    if compat:
        last = s.groupBy("path", F.col("name").alias("from_symbol")).agg(F.max("id").alias("named"))
        r = r.join(last, ["path", "from_symbol"], "left").withColumn("from_id", F.when(F.col("ordinal") < 0, key).otherwise(F.col("named")))
    else:
        r = r.withColumn("from_id", key + F.col("ordinal") + 1)
    relations = r.where("from_id is not null").select((key + F.col("rpos")).alias("id"), "from_id", "relation", "to_name", F.lit(None).cast("long").alias("to_symbol_id"), F.lit(None).cast("double").alias("confidence"), "call_expression", F.col("path").alias("file_path"))
    a = known.select("path", "key", F.posexplode("aliases").alias("apos", "a")).select("path", "key", "apos", "a.*")
    aliases = a.select((key + F.col("apos")).alias("id"), F.col("path").alias("file_path"), "alias", "source_module", "source_name", F.concat_ws(".", "source_module", F.nullif("source_name", F.lit(""))).alias("resolved_fqid"))
    return {"symbols": symbols.unionByName(sentinel), "relations": relations, "import_aliases": aliases}
