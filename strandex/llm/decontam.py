"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs between ASCII punctuation and white space; a character of a script that is written without
spaces is a word.  Each fixed mask selects six words of a window and ignores the others; equal hashes in a benchmark item and a
document are hits.  A hit fixes a diagonal; the ungapped alignment along it is scored (+1 match, -2 substitution), each
stretch ends where its score is highest, and a stretch of ``LEAST`` equal words or more is an overlap, so at least two
thirds of it agree.  An item of fewer words than ``LEAST`` must be quoted whole, word for word (one of fewer than six words
has a mask of its own length); so an item of one word is found in every document that has that word.  Of several
overlaps of a document and an item, the one with the most equal words is returned, of equal ones the shorter, then the first.
Substitutions at any period of four or more leave hits.

Scale: the benchmark is broadcast while its text stays below ``BROADCAST_CHARS`` (checked first); documents are then
scanned once, whole, without a shuffle, and only contaminated pairs come out.  Hashes of a larger benchmark fill a bitmap
of fixed size, which thins those of the documents where they are made; what passes meets the benchmark in a shuffled join,
and only texts with hits are shuffled for verification, keyed by 128 bits of their content.

Nulls: null or empty texts give no pair; null ids of rows and items come back as null.  Very long texts are whole.
Repeated rows, and repeated items of one id, give one pair, the best (ties as above).  Extra columns are ignored; empty
tables give no pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, fresh, in_arrow, map_arrow
from .hashing import mix, window_hashes

#: Masks, equal words of an overlap, cost of a substitution.
MASKS = ("111111", "11011011", "1100110011")
LEAST, PENALTY = 10, 2
#: Benchmark text that may be broadcast, and bits of the bitmap of a larger one's hashes (16 MB).
BROADCAST_CHARS, BITMAP_BITS = 16_000_000, 27
PAIRS = "doc_id long, item_id long, doc_start long, item_start long, n_overlap long, n_matched long"
_SPLIT = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256))
#: Scripts without spaces: Thai, Lao, Myanmar, Khmer, kana and ideographs.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def tokens(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word of a whole text."""
    low = (text or "").lower()
    if not low.isascii() and _UNSPACED.search(low):
        low = _UNSPACED.sub(r" \g<0> ", low)
    return window_hashes(low.encode("utf-8", "surrogatepass").translate(_SPLIT).split(), 1)


def _selected(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = max(0, len(words) - len(mask) + 1)
    acc = np.full(n, salt, np.uint64)
    for at in (i for i, c in enumerate(mask) if c == "1"):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + words[at : at + n]
    return mix(acc)


def seeds(words: np.ndarray, short: tuple[int, ...] = ()) -> list[np.ndarray]:
    """For each mask, one hash for each position where the mask fits; ``short``: lengths of solid masks besides."""
    return [_selected(words, m, k + 1) for k, m in enumerate(MASKS)] + [_selected(words, "1" * n, 100 + n) for n in short]


def item_seeds(words: np.ndarray) -> list[np.ndarray]:
    """Seeds of a benchmark item: one of its whole length where the masks are longer."""
    return seeds(words, (len(words),) if 0 < len(words) < len(MASKS[0]) else ())


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """Best overlap along ``doc position - item position = diagonal``: (doc start, item start, length, equal words)."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    least = min(LEAST, len(item))
    if hi - lo < max(least, 1):
        return None
    same = doc[lo + diagonal : hi + diagonal] == item[lo:hi]
    if int(same.sum()) < least:
        return None
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -PENALTY))))
    starts = np.flatnonzero(total == np.minimum.accumulate(total))  # each new lowest total starts a stretch
    ends = np.append(starts[1:], len(total))
    best = None
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a <= least:
            continue
        end = a + int(total[a:b].argmax())
        n = int(same[a:end].sum())
        got = (lo + a + diagonal, lo + a, end - a, n)
        if n >= least and (best is None or _rank(got) < _rank(best)):
            best = got
    return best


def _rank(x: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    return (-x[3], x[2], x[0], x[1])


class Index:
    """Seeds of all items: sorted hashes with item and position, behind a bitmap that rejects most lookups."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.words = [tokens(t) for _, t in items]
        self.ids = [i for i, _ in items]
        self.short = tuple(sorted({len(w) for w in self.words if 0 < len(w) < len(MASKS[0])}))
        h, item, at = [], [], []
        for k, w in enumerate(self.words):
            for s in item_seeds(w):
                h.append(s)
                item.append(np.full(len(s), k, np.int32))
                at.append(np.arange(len(s), dtype=np.int32))
        self.hash = np.concatenate(h) if h else np.zeros(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int32)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, np.int32)
        self.shift = np.uint64(64 - min(26, max(16, len(self.hash).bit_length() + 4)))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[self.hash >> self.shift] = True

    def hits(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) of every hit."""
        out: set[tuple[int, int]] = set()
        for s in seeds(words, self.short):
            pos = np.flatnonzero(self.bitmap[s >> self.shift])
            if len(pos):
                lo, hi = np.searchsorted(self.hash, s[pos], "left"), np.searchsorted(self.hash, s[pos], "right")
                for p, a, b in zip(pos[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    out.update(zip(self.item[a:b].tolist(), (p - self.at[a:b]).tolist(), strict=True))
        return out

    def found(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item id, doc start, item start, length, equal words), the best overlap of each item."""
        words = tokens(text)
        best: dict[int, tuple] = {}
        for k, diagonal in self.hits(words):
            got = overlap(words, self.words[k], diagonal)
            if got and (k not in best or _rank(got) < _rank(best[k])):
                best[k] = got
        return [(self.ids[k], *best[k]) for k in sorted(best)]


def contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Distinct pairs: ``doc_id, item_id, doc_start, item_start, n_overlap, n_matched`` (word positions)."""
    docs = df.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    items = benchmark.select(col(item_id).cast("long").alias("item_id"), col(item_text).alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if chars > broadcast_chars:
        keyed = docs.where("text is not null").withColumn("id", _content_key())
        return _best(keyed.select("doc_id", "id").join(_joined(keyed.select("id", "text"), items), "id"))
    shared = _index(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in shared.value.found(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], ["doc_id", "item_id", "doc_start", "item_start", "n_overlap", "n_matched"])

    return _best(in_arrow(docs, scan, PAIRS))


def _index(items: DataFrame):
    """The broadcast index of a benchmark whose size was checked."""
    got = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return items.sparkSession.sparkContext.broadcast(Index(got))


def _best(pairs: DataFrame) -> DataFrame:
    """Of repeated ids and items, the best overlap."""
    rank = F.struct((-F.col("n_matched")).alias("a"), "n_overlap", "doc_start", "item_start", "n_matched")
    one = pairs.groupBy("doc_id", "item_id").agg(F.min(rank).alias("x"))
    return one.select("doc_id", "item_id", "x.doc_start", "x.item_start", "x.n_overlap", "x.n_matched")


def _content_key(text: str = "text") -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """One bit for each value that the leading ``BITMAP_BITS`` bits of a hash can have; its size is fixed."""
    at = F.shiftrightunsigned("hash", 64 - BITMAP_BITS) + 1  # Spark numbers bits of a bitmap from 1
    parts = hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in parts.toLocalIterator():
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["k"] - 1) * len(bits) : r["k"] * len(bits)] = bits
    return out


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Overlaps of each distinct text of ``docs`` (``id``: its content's key, ``text``) by a shuffled join of hashes, for a
    benchmark of any size: ``id`` and the columns of ``PAIRS`` but the first."""
    spark = docs.sparkSession

    def emit_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = tokens(t)
                s = item_seeds(w)
                h = np.concatenate(s).astype(np.int64)
                at = np.concatenate([np.arange(len(x)) for x in s])
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(h), pa.binary()), pa.array(h), pa.array(at), pa.array([len(w)] * len(h), pa.int32())], ["item", "hash", "item_at", "n"])

    right = items.withColumn("item", _content_key())
    right_hits = cut(in_arrow(right.select("item", "text"), emit_items, "item binary, hash long, item_at long, n int").distinct())
    short = tuple(sorted(r["n"] for r in right_hits.where(F.col("n") < len(MASKS[0])).select("n").distinct().collect()))
    known = spark.sparkContext.broadcast(_bitmap(right_hits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - BITMAP_BITS)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s in seeds(tokens(t), short):
                    p = (s >> shift).astype(np.int64)
                    at = np.flatnonzero(known.value[p >> 3] >> (p & 7).astype(np.uint8) & 1)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.binary()), pa.array(s[at].astype(np.int64)), pa.array(at)], ["id", "hash", "at"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, k, ds, t, u in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w, v = tokens(t), tokens(u)
                rows += [(i, k, *got) for d in ds if (got := overlap(w, v, d))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 6)]], ["id", "item_id", "doc_start", "item_start", "n_overlap", "n_matched"])

    left_hits = in_arrow(docs, emit, "id binary, hash long, at long")
    pairs = left_hits.join(right_hits, "hash").select("id", "item", (F.col("at") - F.col("item_at")).alias("d")).distinct()
    pairs = cut(pairs.groupBy("id", "item").agg(F.collect_list("d").alias("d")))  # at most the words of both texts
    with_item = pairs.join(right.select("item", "item_id", F.col("text").alias("item_text")), "item")
    texts = docs.join(pairs.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    both = with_item.join(texts, "id").select("id", "item_id", "d", "text", "item_text")
    return in_arrow(both, check, "id binary, " + PAIRS.partition(", ")[2])


def remove_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows of ``df`` without any overlap, all columns as they were; one map, no shuffle."""
    items = benchmark.select(col(item_id).cast("long").alias("item_id"), col(item_text).alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if chars > broadcast_chars:
        (key,) = fresh(df, "text_key")
        keyed = df.withColumn(key, F.unhex(F.md5(col(text).cast("binary"))))
        bad = _joined(keyed.select(col(key).alias("id"), col(text).alias("text")).where("text is not null"), items)
        return keyed.join(cut(bad.select(F.col("id").alias(key)).distinct()), key, "left_anti").select(*[col(c) for c in df.columns])
    shared = _index(items)
    where = df.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not shared.value.found(t) for t in b.column(where).to_pylist()], pa.bool_()))

    return map_arrow(df, scan, df.schema)
