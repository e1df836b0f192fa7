"""Scalar expressions (all JVM-side): hashes, paths, tokens, keywords, trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source extensions with their language, skipped folders, stop words.
LANGUAGES = {".py": "python", ".go": "go", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}
SKIP_DIRS = [".git", ".hg", ".svn", "__pycache__", ".venv", "venv", "env", ".env", ".mypy_cache", ".pytest_cache", ".ruff_cache", "node_modules", ".next", "dist", "build", ".webpack", ".go", "vendor", "target", ".tox", "coverage", ".coverage"]
STOP_WORDS = ["a", "an", "the", "in", "for", "of", "to", "with", "and", "or", "not", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "this", "that", "these", "those", "it", "its", "from", "by", "at", "on"]
TRIM_MARK = "\n\n[... context trimmed to fit token budget ...]"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension, null when the extension is unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))


def is_indexable(path: Column) -> Column:
    """Known extension, and no part of the path is a skipped folder."""
    skip = F.array(*[F.lit(d) for d in SKIP_DIRS])
    return F.coalesce(language_of(path).isNotNull() & ~F.arrays_overlap(F.split(path, "/"), skip), F.lit(False))


def module_of(path: Column) -> Column:
    """``a/b/__init__.py`` and ``a/b.py`` to ``a.b``; parts joined by dots."""
    known = "|".join(e[1:] for e in LANGUAGES)
    stem = F.regexp_replace(path, rf"(?i)\.({known})$", "")
    dotted = F.array_join(F.filter(F.split(stem, "/"), lambda p: (p != "") & (p != ".")), ".")
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def fqid_of(module: Column, name: Column, owner: Column | None = None) -> Column:
    """``module[.Owner].name``; empty without a module."""
    parts = F.concat_ws(".", module, F.nullif(owner, F.lit("")) if owner is not None else F.lit(None).cast("string"), name)
    return F.when(F.coalesce(module, F.lit("")) == "", F.lit("")).otherwise(parts)


def content_hash(content: Column) -> Column:
    return F.sha1(content.cast("binary"))


def span_hash(source: Column, start_line: Column, end_line: Column) -> Column:
    """First 16 hex digits of SHA-1 over the lines from ``start_line`` to before ``end_line`` (1-based): a symbol's
    last line does not count, so a one-line symbol hashes the empty text."""
    n = F.greatest(end_line - start_line, F.lit(0))
    lines = F.slice(F.split(source, "\n"), F.greatest(start_line, F.lit(1)), n)
    return F.substring(F.sha1(F.array_join(lines, "\n").cast("binary")), 1, 16)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def keywords(text: Column) -> Column:
    """Identifiers of three characters or more that are no stop words; order and repeats stay."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), 0)
    return F.filter(found, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, F.lower(w)))


def trim_to(text: Column, token_cap: Column | int) -> Column:
    """Cut at the cap (4 characters a token), back to the last line end past the half, and mark the cut."""
    cap = (F.lit(token_cap) if isinstance(token_cap, int) else token_cap) * 4
    head = F.substring(text, F.lit(1), cap)
    last = F.length(head) - F.instr(F.reverse(head), "\n")  # characters before the last line end
    cut = F.when((F.instr(head, "\n") > 0) & (last > F.floor(cap / 2)), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(cut, F.lit(TRIM_MARK)))


def name_overlap(words: Column, name: Column) -> Column:
    """How many query words are underscore-separated parts of the name (case ignored)."""
    return F.size(F.array_intersect(F.array_distinct(F.transform(words, lambda w: F.lower(w))), F.split(F.lower(name), "_")))


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
