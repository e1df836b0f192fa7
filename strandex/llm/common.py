"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters that are not ASCII white space.
WORD = "[^ \\t-\\r]+"
GAP = "[ \\t-\\r]+"

#: Rows that a Python function gets at a time.  Texts reach megabytes, so this bounds a worker's memory.
ARROW_ROWS = 512


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    """Number of words, 0 for null; one regex pass, no Python."""
    return F.size(words(text)).cast("long")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that do not clash with a column of ``df`` (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers (once for each application); no setting is changed."""
    sc = spark.sparkContext
    if _SENT.get("app") != sc.applicationId:
        _SENT["app"] = sc.applicationId
        top = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp()) / f"{top.name}.zip"  # code, not data: Spark serves it to executors
        with zipfile.ZipFile(out, "w") as z:
            for f in (top / "__init__.py", *sorted((top / "llm").glob("*.py"))):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(out))


_SENT: dict[str, str] = {}


def small(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, whatever the session's batch size is.

    Spark bounds its own batches by bytes as well (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB by default), so
    neither what arrives nor what is made of it at a time grows with the table."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def in_arrow(df: DataFrame, function, schema: T.StructType | str, rows: int = ARROW_ROWS) -> DataFrame:
    """``mapInArrow`` in batches of at most ``rows``."""
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: function(small(batches, rows)), schema)


def map_arrow(df: DataFrame, function, schema: T.StructType | str) -> DataFrame:
    """``in_arrow`` for columns of any name: workers see positions, the result gets the schema's names."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    safe = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(want)])
    names = safe.names

    def renamed(batches):
        for b in function(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names)

    return in_arrow(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), renamed, safe).toDF(*want.names)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` when it is set, else a
    folder in the warehouse (which a cluster shares as well)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later stages survive the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there, so later passes read the columns they need."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df`` in as few partitions as about ``rows`` rows need, so that small steps of a loop leave few files behind,
    whatever the session's number of partitions; large ones stay as they are."""
    return df.coalesce(max(1, -(-rows // each)))


def join_small(left: DataFrame, right: DataFrame, on: list[str], rows: int, most: int, how: str = "left") -> DataFrame:
    """Join a table of ``rows`` counted rows: broadcast up to ``most`` rows, a shuffled join beyond."""
    return left.join(F.broadcast(right) if rows <= most else right, on, how)
