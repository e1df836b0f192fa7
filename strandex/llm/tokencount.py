"""Edit-aware token counts: segment trees over pre-token runs.

A text is cut into leaves of about ``LEAF`` characters at places where every pre-token pattern of this family
splits: a blank between two letters.  A leaf's tokens do not depend on its neighbours.  The tree holds subtree
sums of characters and tokens.  An edit finds its leaves by descending the character sums, takes one more leaf
where its boundary context reaches it, re-cuts and re-encodes that region alone, and updates the sums on the
paths above; the total equals a full re-encoding.

The state of a document is two arrays (characters and tokens of each leaf); the tree above them is rebuilt in linear
time without encoding.  Everything is one map over whole texts, no shuffle.  The vocabulary is a file (a
parameter) read once on the driver and sent to workers (its size is fixed, about 1 MB).

Nulls: a null text has no leaves and 0 tokens, edits of it insert into an empty text.  Edit positions beyond the
text are clipped to it; null edits and null insertions count as nothing.  Edits apply in order, each to the result so far.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, map_arrow

#: Characters of a leaf aimed at, and characters around an edit that can move a cut.
LEAF, CONTEXT = 512, 2
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_ENCODERS: dict = {}


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The encoder of a rank file's bytes, built once in each process."""
    key = (hashlib.sha1(ranks).digest(), pattern)
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def leaves(text: str, size: int = LEAF) -> list[str]:
    """``text`` cut at safe places; joined, they are ``text``."""
    out, at = [], 0
    while at < len(text):
        found = _CUT.search(text, at + size) if at + size < len(text) else None
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


class SegmentTree:
    """Subtree sums of (characters, tokens) over a list of leaves."""

    def __init__(self, enc, chars: list[int], tokens: list[int]):
        self.enc = enc
        self.encoded = 0  # characters that were encoded since the tree was made
        self._build(chars, tokens)

    @classmethod
    def of(cls, enc, text: str, size: int = LEAF) -> SegmentTree:
        parts = leaves(text, size)
        tree = cls(enc, [len(p) for p in parts], [len(enc.encode_ordinary(p)) for p in parts])
        tree.encoded = len(text)
        return tree

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.n, self.base = len(chars), 1
        while self.base < self.n:
            self.base *= 2
        pad = [0] * (self.base - self.n)
        self.chars, self.tokens = [0] * self.base + chars + pad, [0] * self.base + tokens + pad
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def state(self) -> tuple[list[int], list[int]]:
        return self.chars[self.base : self.base + self.n], self.tokens[self.base : self.base + self.n]

    def find(self, position: int) -> tuple[int, int]:
        """Leaf that holds the character at ``position`` (clipped), and its first position."""
        i, start = 1, 0
        position = max(0, min(position, self.chars[1] - 1))
        while i < self.base:
            i *= 2
            if position - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.base, start

    def edit(self, text: str, start: int, removed: int, inserted: str, size: int = LEAF) -> str:
        """Apply one edit; returns the new text.  Only the touched region is encoded."""
        start = max(0, min(start, len(text)))
        stop = min(len(text), start + max(0, removed))
        new = text[:start] + inserted + text[stop:]
        if not self.n:
            parts = leaves(new, size)
            self.encoded += len(new)
            self._build([len(p) for p in parts], [len(self.enc.encode_ordinary(p)) for p in parts])
            return new
        first, lo = self.find(start - CONTEXT)
        last, at = self.find(stop + CONTEXT)
        hi = at + self.chars[self.base + last]
        region = text[lo:start] + inserted + text[stop:hi]
        parts = leaves(region, size)
        self.encoded += len(region)
        lengths, counts = [len(p) for p in parts], [len(self.enc.encode_ordinary(p)) for p in parts]
        if len(parts) == last - first + 1:
            for i, (c, t) in enumerate(zip(lengths, counts, strict=True), first):
                self._set(i, c, t)
        else:
            chars, tokens = self.state()
            self._build(chars[:first] + lengths + chars[last + 1 :], tokens[:first] + counts + tokens[last + 1 :])
        return new

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.base
        dc, dt = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def count_edits(df: DataFrame, text: str = "text", edits: str | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN, state: tuple[str, str] | None = None, with_state: bool = False) -> DataFrame:
    """Every column of ``df`` but text, edits and state, plus counts (names made unique).

    ``edits``: a column array<struct<start int, removed int, inserted string>>.  ``state``: columns with the
    leaves' characters and tokens from an earlier call ``with_state``; without it the text is encoded once.  Adds
    ``n_tokens`` (before the edits), ``n_tokens_after, n_leaves, n_encoded_chars`` (encoded for the edits alone), and
    ``with_state`` also ``new_text, leaf_chars, leaf_tokens`` (after the edits).
    """
    spark: SparkSession = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    drop = {text, edits, *(state or ())}
    keep = [c for c in df.columns if c not in drop]
    rest = df.select(*[col(c) for c in keep])
    added = fresh(rest, "n_tokens", "n_tokens_after", "n_leaves", "n_encoded_chars", *(["new_text", "leaf_chars", "leaf_tokens"] if with_state else []))
    schema = rest.schema
    for name, kind in zip(added, [T.LongType()] * 4 + [T.StringType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType())], strict=False):
        schema = schema.add(name, kind)
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    inputs = [col(text), col(edits) if edits else F.lit(None).cast("array<struct<start:int,removed:int,inserted:string>>")]
    inputs += [col(c) for c in state] if state else [F.lit(None).cast("array<int>")] * 2

    def one(enc, whole: str | None, changes: list | None, chars: list | None, counts: list | None) -> tuple:
        tree = SegmentTree(enc, chars, counts) if chars is not None else SegmentTree.of(enc, whole or "")
        before, tree.encoded, new = tree.total, 0, whole or ""
        for e in changes or []:
            if e is not None:
                new = tree.edit(new, e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
        return (before, tree.total, tree.n, tree.encoded, *((new, *tree.state()) if with_state else ()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        k = len(keep)
        for b in batches:
            got = [one(enc, *row) for row in zip(*(b.column(k + i).to_pylist() for i in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(k)], *[pa.array([g[i] for g in got], kinds[i]) for i in range(len(added))]], [*keep, *added])

    return map_arrow(df.select(*[col(c) for c in keep], *[c.alias(f"in{i}") for i, c in enumerate(inputs)]), count, schema)
