"""Tables of extracted files: joins of long texts, ids of paths whose hashes are equal."""

import re

import pytest
from pyspark.sql import functions as F

from strandex.sources import files
from strandex.sources.store import Store


def test_long_texts_are_not_broadcast(spark):
    path = F.concat(F.lit("src/p"), F.col("id").cast("string"), F.lit(".go"))
    sources = spark.range(300).select(path.alias("path"), F.concat(F.repeat(F.lit("// long text\n"), F.lit(4000)), F.lit("func main() {\n    run()\n}\n")).alias("source"), F.lit("go").alias("language"))
    symbols = files.tables(sources, files.extract_files(sources))["symbols"]
    plan = symbols._jdf.queryExecution().sparkPlan().toString()  # before anything is counted, by Spark's estimates alone
    assert re.search(r"SortMergeJoin \[path#\d+\]", plan) and not re.search(r"BroadcastHashJoin \[path#\d+\]", plan)
    assert [tuple(r) for r in symbols.groupBy("name", "start_line", "end_line").count().collect()] == [("main", 4001, 4003, 300)]


#: Two paths whose hashes have equal last 40 bits.
ALIKE = ("src/p244055.py", "src/p783238.py")


def test_paths_of_equal_hashes_have_ids_of_their_own(spark):
    text = "import os\n\nclass A:\n    def run(self):\n        os.go()\n"
    rows = [(p, text) for p in (*ALIKE, "src/p1.py")]
    sources = spark.createDataFrame(rows, "path string, source string").withColumn("language", F.lit("python"))
    assert sources.select(files.path_hash()).distinct().count() == 2
    t = files.tables(sources, files.extract_files(sources))
    symbols = t["symbols"].collect()
    assert len({r["id"] for r in symbols}) == len(symbols) == 9
    names = {r["id"]: (r["file_path"], r["name"]) for r in symbols}
    assert all(names[r["owner_symbol_id"]] == (r["file_path"], "A") for r in symbols if r["name"] == "run")
    assert sorted(names[r["from_id"]] for r in t["relations"].where("relation = 'CALLS'").collect()) == sorted((p, "run") for p, _ in rows)
    assert t["import_aliases"].select("id").distinct().count() == 3
    assert t["symbols"].where(files.hash_in(F.col("id")) != F.expr("xxhash64(file_path) & 1099511627775L")).count() == 0


def test_turns_of_many_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(files, "path_hash", lambda: F.lit(7).cast("long"))
    paths = spark.createDataFrame([(p,) for p in "abcd"], "path string")
    assert {r["path"]: r["turn"] for r in files.turns(paths).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    sources = paths.select("path", F.lit("def f():\n    g()\n").alias("source"), F.lit("python").alias("language"))
    t = files.tables(sources, files.extract_files(sources))
    ids = t["symbols"].select("id", files.turn_in(F.col("id")).alias("turn"), files.hash_in(F.col("id")).alias("hash")).collect()
    assert len({r["id"] for r in ids}) == 4 and sorted(r["turn"] for r in ids) == [0, 1, 2, 3] and {r["hash"] for r in ids} == {7}
    held = spark.createDataFrame([("x", 0), ("y", 2)], "path string, turn int")
    assert {r["path"]: r["turn"] for r in files.turns(paths.limit(2), held).collect()} == {"a": 1, "b": 3}
    with pytest.raises(Exception, match="no id is free for"):
        files.turns(paths, held).collect()


def test_store_keeps_paths_of_equal_hashes_apart(spark, tmp_path):
    store, one = Store(spark, str(tmp_path / "index")), "import os\n\ndef f():\n    g()\n"

    def held():
        """What the store holds of each path: names in the order of their ids, and links of its calls."""
        store.resolve()
        symbols, relations = store.table("symbols").collect(), store.table("relations").collect()
        at = {r["id"]: (r["file_path"], r["name"]) for r in symbols}
        assert len(at) == len(symbols) and all(r["from_id"] in at for r in relations)
        links = sorted((*at[r["from_id"]], r["to_name"], at.get(r["to_symbol_id"])) for r in relations if r["relation"] == "CALLS")
        return sorted(at.values()), links

    def update(clock, partial=False, removed=None, **texts):
        rows = [(ALIKE[int(k[1])], text) for k, text in texts.items()]
        sources = spark.createDataFrame(rows, "path string, source string").select("path", "source", F.sha1(F.col("source").cast("binary")).alias("content_hash"), F.lit("python").alias("language"))
        gone = None if removed is None else spark.createDataFrame([(removed,)], "path string")
        return store.update(sources, "main", clock, gone, partial)

    def of(*which, more=()):
        return sorted((ALIKE[i], n) for i in which for n in ("<module>", "f", *(["g"] if i in more else [])))

    update(1, p1=one)
    stats = update(2, True, p0=one)  # its hash is held
    assert (stats["symbols_added"], stats["relations_added"]) == (2, 2)
    assert held() == (of(0, 1), [(ALIKE[0], "f", "g", None), (ALIKE[1], "f", "g", None)])
    ids = {r["id"] for r in store.table("symbols").where(F.col("file_path") == ALIKE[0]).collect()}
    update(3, p0=one, p1=one + "\ndef g():\n    pass\n")  # the first holder changes, the other stays
    assert held() == (of(0, 1, more=(1,)), [(ALIKE[0], "f", "g", (ALIKE[1], "g")), (ALIKE[1], "f", "g", (ALIKE[1], "g"))])
    assert ids == {r["id"] for r in store.table("symbols").where(F.col("file_path") == ALIKE[0]).collect()}
    update(4, True, ALIKE[1])
    assert held() == (of(0), [(ALIKE[0], "f", "g", None)])
