"""Facts from a git work tree.

The driver asks git for text; what is read out of it (names in a diff, files of a log) are expressions over a frame of
numbered lines, so the same plans serve a repository's diff and a table of many.  Outside of a work tree, or when git fails
or takes too long, every fact is empty.
"""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a section that name a wanted word (at most), and lines that stand in when none does.
MOST_LINES, FIRST_LINES = 10, 8


def ask(folder: str | Path, *words: str, seconds: int = 5) -> str:
    """What ``git words`` prints in a folder, without blank ends; empty after any failure."""
    try:
        done = subprocess.run(["git", "-C", str(folder), *words], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, timeout=seconds, check=True)
    except (OSError, subprocess.SubprocessError):
        return ""
    return done.stdout.decode("utf-8", "replace").strip()


def root_of(path: str | Path) -> Path | None:
    """The top folder of the work tree that ``path`` lies in."""
    top = ask(path, "rev-parse", "--show-toplevel")
    return Path(top) if top else None


def branch(path: str | Path) -> str:
    """The branch that is checked out, or the first 12 digits of a detached commit."""
    return ask(path, "symbolic-ref", "--short", "HEAD") or ask(path, "rev-parse", "--verify", "HEAD")[:12]


def lines(spark: SparkSession, text: str) -> DataFrame:
    """``pos, line`` of a text."""
    one = spark.createDataFrame([(text,)], "text string")
    return one.select(F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def first_of_each(rows: DataFrame, value: str) -> DataFrame:
    """Each value once, in the order in which it appears first (``pos``); empty ones are left out."""
    return rows.where(F.col(value) != "").groupBy(value).agg(F.min("pos").alias("pos")).orderBy("pos", value)


def recent_files(spark: SparkSession, path: str | Path, n: int = 10) -> list[str]:
    """Files of the last ``n`` commits, newest first."""
    found = lines(spark, ask(path, "log", f"-{n}", "--name-only", "--pretty=format:")).select("pos", F.trim("line").alias("file"))
    return [r["file"] for r in first_of_each(found, "file").collect()]


def recent_commits(path: str | Path, n: int = 5) -> str:
    return ask(path, "log", f"-{n}", "--oneline")


def named(line: Column) -> Column:
    """The function or class that a line of a diff names: behind a hunk's head, or on an added line; else empty."""
    code = F.when(line.startswith("@@"), F.element_at(F.split(line, "@@"), -1)).when(line.startswith("+"), F.substring(line, 2, 1 << 20))
    words = F.split(F.trim(F.translate(code, "\t", " ")), " +")
    words = F.when(F.get(words, F.lit(0)) == "async", F.slice(words, 2, 2)).otherwise(words)
    is_head = F.get(words, F.lit(0)).isin("def", "class")
    return F.coalesce(F.when(is_head, F.regexp_extract(F.get(words, F.lit(1)), "^[A-Za-z_][A-Za-z_0-9]*", 0)), F.lit(""))


def changed_names(diff: DataFrame) -> DataFrame:
    """``name, pos`` of functions and classes in the lines (``pos, line``) of a diff, in order, each once."""
    return first_of_each(diff.select("pos", named(F.col("line")).alias("name")), "name")


def changed_symbols(spark: SparkSession, path: str | Path, since: str = "HEAD~3") -> list[str]:
    diff = ask(path, "diff", "--unified=0", since, "HEAD", seconds=10)
    return [r["name"] for r in changed_names(lines(spark, diff)).collect()] if diff else []


def relevant(rows: DataFrame, words: list[str]) -> DataFrame:
    """Lines (``pos, line``) that hold one of the words whatever their case; where none does, the first ones."""
    hits = rows.where(F.exists(F.array(*[F.lit(w.lower()) for w in words]).cast("array<string>"), lambda w: F.contains(F.lower("line"), w)))
    picked = hits if hits.take(1) else rows.orderBy("pos").limit(FIRST_LINES)
    return picked.orderBy("pos").limit(MOST_LINES)


def diff_section(spark: SparkSession, path: str | Path, words: list[str]) -> str:
    """What changed in the last three commits (or is not committed yet) near the words, and the latest commits."""
    indented = lambda title, xs: title + "".join(f"\n  {x}" for x in xs)
    stat = ask(path, "diff", "--stat", "HEAD~3", "HEAD") or ask(path, "diff", "--stat")
    log = recent_commits(path)
    out = [indented("Changed files:", [r["line"] for r in relevant(lines(spark, stat), words).collect()])] if stat else []
    return "\n\n".join([*out, *([indented("Recent commits:", log.split("\n"))] if log else [])])
