"""The index on storage: versioned, bucketed Parquet tables, one writer, readers never see half a build.

Every table but ``meta`` is dealt into buckets by the hash of a row's path, which its id holds as well.  A build writes the
buckets that change under a new version folder, then a manifest that names the version of every bucket, and marks the version
ready last; readers take the newest ready version.  So a change of a few files writes a few buckets, whatever the
index holds.  Folders go through the Hadoop file system, so any store that Spark reaches works.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import resolve as resolver
from ..streaming import incremental
from . import files as source_files

#: Buckets of a new store; a store keeps the number it was made with.
BUCKETS = 16


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = self._manifest(v)["buckets"] if (v := self.version()) else buckets

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(self.folder) if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.folder}/{n}/_READY")))

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _manifest(self, version: int) -> dict:
        """``buckets`` and, for each table, the version that holds each bucket."""
        if not version:
            return {"buckets": self.buckets, "tables": {}}
        stream = self._fs.open(self._path(f"{self.folder}/v{version}/_MANIFEST"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def bucket(self, name: str) -> Column:
        """The bucket of a row of a table: by its path's hash, which ids hold above their ordinals."""
        path_hash = source_files.path_hash() if name in ("files", "modules") else source_files.hash_in(F.col("id"))
        return (path_hash % self.buckets).cast("int")

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The newest ready version of a table, or of some of its buckets; empty before the first build."""
        v = self.version()
        if v and name == "meta":
            found = [f"{self.folder}/v{v}/meta"]
        else:
            held = self._manifest(v)["tables"].get(name, {})
            found = [f"{self.folder}/v{at}/{name}/b={k}" for k, at in held.items() if buckets is None or int(k) in buckets]
        if not found:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        return self.spark.read.schema(schemas.TABLES[name]).parquet(*found)

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.table("meta").collect()}

    def write(self, tables: dict[str, tuple[DataFrame, list[int] | None]], meta: dict[str, str]) -> int:
        """Stage a version and mark it ready: of each table the given buckets (None: all of them), the rest stays where it is."""
        v = self.version() + 1
        manifest = self._manifest(v - 1) | {"buckets": self.buckets}
        self._fs.delete(self._path(f"{self.folder}/v{v}"), True)  # left by a build that failed
        for name, (df, buckets) in tables.items():
            if buckets == []:
                continue
            want = self.spark.createDataFrame([], schemas.TABLES[name]).schema
            rows = df.select(*[F.col(c.name).cast(c.dataType) for c in want], self.bucket(name).alias("b"))
            rows.hint("rebalance", "b").write.partitionBy("b").parquet(f"{self.folder}/v{v}/{name}")
            stay = {} if buckets is None else {k: at for k, at in manifest["tables"].get(name, {}).items() if int(k) not in buckets}
            manifest["tables"][name] = stay | {n[2:]: v for n in self._names(f"{self.folder}/v{v}/{name}") if n[:2] == "b="}
        self.spark.createDataFrame([(k, str(x)) for k, x in sorted(meta.items())], schemas.META).coalesce(1).write.parquet(f"{self.folder}/v{v}/meta")
        stream = self._fs.create(self._path(f"{self.folder}/v{v}/_MANIFEST"))
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        self._fs.create(self._path(f"{self.folder}/v{v}/_READY")).close()
        self._clean()
        return v

    def _clean(self) -> None:
        """Remove what neither of the last two versions uses."""
        *old, before, last = [0, 0, *self._versions()]
        used = {(at, name, f"b={k}") for v in (before, last) if v for name, held in self._manifest(v)["tables"].items() for k, at in held.items()}
        for v in filter(None, old):
            if not any(at == v for at, _, _ in used):
                self._fs.delete(self._path(f"{self.folder}/v{v}"), True)
                continue
            for name in set(self._names(f"{self.folder}/v{v}")) & set(schemas.TABLES):
                for b in self._names(f"{self.folder}/v{v}/{name}"):
                    if (v, name, b) not in used:
                        self._fs.delete(self._path(f"{self.folder}/v{v}/{name}/{b}"), True)

    def all(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in schemas.TABLES if n != "meta"}

    def _buckets(self, name: str, rows: DataFrame) -> list[int]:
        return sorted(r["b"] for r in rows.select(self.bucket(name).alias("b")).distinct().collect())

    def update(self, sources: DataFrame, branch: str, clock: int, removed: DataFrame | None = None, partial: bool = False, compat: bool = False, paths: DataFrame | None = None) -> dict:
        """Bring the index to ``sources`` (path, source, content_hash, language); returns the run's counters.

        Files of the same hash keep their rows.  ``partial``: sources are a few files, others stay; ``removed``
        (path) are dropped.  Links into replaced files are cleared; ``resolve`` sets them again.  ``paths``: what should
        have been read; files that could not be count as errors and keep the rows they have.
        """
        known = self.table("files")
        sources = sources.persist()
        state = incremental.status(sources, known)
        unread = 0
        if paths is not None:
            missing = paths.join(sources.select("path"), "path", "left_anti").select("path", F.lit(True).alias("missing")).persist()
            unread = missing.count()
            state = state.join(missing, "path", "left").withColumn("status", F.when(F.col("missing") & (F.col("status") == "orphan"), "unread").otherwise(F.col("status")))
        if partial:
            gone = removed if removed is not None else self.spark.createDataFrame([], "path string")
            state = state.where("status <> 'orphan'").select("path", "status").unionByName(gone.select("path", F.lit("orphan").alias("status")).join(known.select("path"), "path", "left_semi"))
        state = state.select("path", "status").persist()
        fresh = sources.join(state.where("status in ('new', 'changed')").select("path"), "path", "left_semi")
        extracted = source_files.extract_files(fresh).persist()
        drop = state.where("status in ('changed', 'orphan')").select("path").persist()
        touched = self._buckets("files", state.where("status not in ('same', 'unread')"))
        old = {n: self.table(n, touched) for n in ("symbols", "import_aliases")}
        # paths that stay and whose hash a fresh path has too keep their ids; they lie in the fresh path's bucket
        alike = incremental.delete_paths(self.table("files", touched), drop, "path").select("path", source_files.path_hash().alias("hash"))
        alike = alike.join(fresh.select(source_files.path_hash().alias("hash")), "hash", "left_semi").select("path")
        held = old["symbols"].select(F.col("file_path").alias("path"), source_files.turn_in(F.col("id")).alias("turn")).join(alike, "path", "left_semi").distinct().persist()
        new = source_files.tables(fresh, extracted, compat, held)
        dropped_ids = old["symbols"].join(drop.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(F.col("id").alias("k")).persist()
        # links into replaced files come from any bucket; two columns of all relations find them
        into = self.table("relations").select("id", F.col("to_symbol_id").alias("k")).join(dropped_ids, "k", "left_semi")
        relinked = sorted({*touched, *self._buckets("relations", into)})
        kept_rel = self.table("relations", relinked)
        kept_rel = kept_rel.join(dropped_ids, kept_rel["from_id"] == dropped_ids["k"], "left_anti")
        gone_target = dropped_ids.select("k", F.lit(True).alias("gone"))
        kept_rel = kept_rel.join(gone_target, kept_rel["to_symbol_id"] == gone_target["k"], "left")
        kept_rel = kept_rel.withColumn("to_symbol_id", F.when(F.col("gone").isNull(), F.col("to_symbol_id"))).withColumn("confidence", F.when(F.col("gone").isNull(), F.col("confidence"))).drop("gone", "k")
        current = sources.select("path", "content_hash", F.lit(branch).alias("branch"), "language", F.lit(clock).cast("long").alias("last_indexed_at"))
        stamped = self._buckets("files", state) if partial else None  # a full build stamps every file
        stay = incremental.delete_paths(self.table("files", stamped), drop, "path") if partial else known.join(state.where("status = 'unread'").select("path"), "path", "left_semi")
        files = incremental.upsert(stay, current, ["path"], ["last_indexed_at"])
        modules = files.where(self.bucket("files").isin(touched)).select(F.xxhash64("path").alias("id"), source_files.module_of(F.col("path")).alias("name"), "path")
        tables = {
            "files": (files, stamped),
            "modules": (modules, touched),
            "symbols": (incremental.delete_paths(old["symbols"], drop, "file_path").unionByName(new["symbols"]), touched),
            "relations": (kept_rel.unionByName(new["relations"].drop("file_path")), relinked),
            "import_aliases": (incremental.delete_paths(old["import_aliases"], drop, "file_path").unionByName(new["import_aliases"]), touched),
        }
        stats = incremental.run_stats(state).first().asDict()
        stats["errors"] = unread + extracted.where("error is not null").count()
        stats["symbols_added"], stats["relations_added"] = new["symbols"].count(), new["relations"].count()
        self.write(tables, self.meta() | {"branch": branch, "schema_version": "2", "last_run": json.dumps(stats)})
        for df in (sources, state, extracted, drop, dropped_ids, held):
            df.unpersist()
        return stats | {"branch": branch}

    def build(self, root: str, branch: str, clock: int, compat: bool = False) -> dict:
        """Full build of a folder; files that are gone are purged."""
        return self.update(source_files.scan(self.spark, root), branch, clock, compat=compat, paths=source_files.paths_in(self.spark, root))

    def apply(self, root: str, actions: DataFrame, clock: int) -> dict:
        """Debounced file actions (path, action) of a watch, in one version.  Only the named files are looked at; a batch of
        more than ``MOST_PATHS`` is read by a scan of the folder."""
        todo = actions.groupBy("path").agg(F.max_by("action", F.when(F.col("action") == "index", 1).otherwise(0)).alias("action"))
        wanted = todo.where("action = 'index'").select("path")
        paths = [r["path"] for r in wanted.limit(source_files.MOST_PATHS + 1).collect()]
        if len(paths) > source_files.MOST_PATHS:
            some = source_files.scan(self.spark, root).join(wanted, "path", "left_semi")
        else:
            some = source_files.scan_paths(self.spark, root, paths)
        return self.update(some, self.meta().get("branch", ""), clock, todo.where("action = 'remove'").select("path"), partial=True)

    def resolve(self) -> dict:
        """Link references of the whole index; a second run changes nothing."""
        t = self.all()
        linked = resolver.resolve(t["symbols"], t["relations"], t["import_aliases"], by_path=True).persist()
        stats = resolver.resolution_stats(linked).first().asDict()
        self.write({"relations": (linked, None)}, self.meta())
        linked.unpersist()
        return stats
