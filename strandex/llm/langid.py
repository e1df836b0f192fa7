"""Language identification by nearest centroid over TF-IDF character n-grams.

Texts become hashed counts of character trigrams and bigrams of lower-cased letter runs (other
characters act as one blank), damped by a square root, weighted by IDF and normalised.  Each language is
several centroids from spherical k-means; the prediction is the language of the centroid with the largest
cosine.  Distance-based rejection: a row is ``rejected`` when that cosine is below the language's limit,
a low quantile of its own training cosines.

The model is fitted on at most about ``SAMPLE`` labelled rows of each language (chosen by a hash of the
document id), at most ``MOST_LANGUAGES`` languages, 32 KB for each centroid, so shipping it to workers is bounded whatever
the corpus.  Prediction is one map over whole texts without a shuffle; very long texts are counted in blocks that carry on.

Nulls: a null text, an empty one or one without letters is ``und`` with score 0; rows without a language do not train;
with nothing to learn from (an empty table), every row is ``und``.  Ties go to the language first by code point.  Repeated
rows are judged alike and train as often as they occur (all or none of them, as the sample goes by id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, in_arrow, map_arrow

#: Hashed dimensions, centroids of a language, expected training rows of a language, k-means rounds.
DIMS, CENTROIDS, SAMPLE, ROUNDS = 8192, 4, 400, 8
#: Languages that are learnt: those with the most labelled rows.
MOST_LANGUAGES = 512
#: Quantile of training cosines below which a text is rejected, and the slack under it.
REJECT_QUANTILE, REJECT_SLACK = 0.005, 0.8
#: Code points of a text that are counted at a time; bounds memory for very long texts.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(65536)])


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None when it has no letter.  The text is one stream of symbols that starts and
    ends with a blank; blocks carry its last two symbols on, so where a block ends does not matter."""
    low, out = (text or "").lower(), np.zeros(DIMS, np.int64)
    tail, seen = np.array([32], np.uint64), False
    for at in range(0, len(low) + 1, BLOCK):
        points = np.frombuffer(low[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        near = points < 65536
        alpha = _letters()[np.where(near, points, 0)]
        if not near.all():
            alpha[~near] = [chr(c).isalpha() for c in points[~near].tolist()]
        seen = seen or bool(alpha.any())
        x = np.where(alpha, points, 32).astype(np.uint64)
        if at + BLOCK > len(low):
            x = np.append(x, np.uint64(32))
        blank = np.concatenate((tail[-1:], x)) == 32
        x = np.concatenate((tail, x[~(blank[1:] & blank[:-1])]))  # runs of blanks count once
        two = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] * np.uint64(0x165667B19E3779F9) + x[2:] * np.uint64(0x85EBCA77C2B2AE63)
        grams = np.concatenate((two[len(tail) - 1 :], three[max(0, len(tail) - 2) :]))
        out += np.bincount(grams >> np.uint64(64 - DIMS.bit_length() + 1), minlength=DIMS)
        tail = x[-2:]
    return out if seen else None


@dataclass
class LanguageModel:
    idf: np.ndarray = field(default_factory=lambda: np.zeros(DIMS, np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    owner: list[str] = field(default_factory=list)
    limit: dict[str, float] = field(default_factory=dict)

    def vector(self, got: np.ndarray) -> np.ndarray:
        v = np.sqrt(got).astype(np.float32) * self.idf
        norm = float(np.sqrt(v @ v))
        return v / norm if norm else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        got = counts(text) if self.owner else None
        if got is None:
            return "und", 0.0, True
        cosines = self.centroids @ self.vector(got)
        best = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.owner[best], score, score < self.limit[self.owner[best]]


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, deterministic: each start is the row farthest from the earlier ones."""
    centers = [x.mean(axis=0)]
    while len(centers) < min(k, len(x)):
        centers.append(x[int(np.max(x @ np.array(centers).T, axis=1).argmin())])
    c = np.array(centers, np.float32)
    for _ in range(ROUNDS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))], np.float32)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, k: int = CENTROIDS) -> LanguageModel:
    """Fit on a bounded sample of each language of ``labelled`` (all its rows may train)."""
    rows = labelled.where(col(lang).isNotNull() & col(text).isNotNull()).select(col(doc_id).alias("i"), col(text).alias("t"), col(lang).alias("l"))
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return LanguageModel()
    share = F.create_map(*[F.lit(x) for k_, n in sorted(sizes.items()) for x in (k_, min(1.0, sample / n))])
    picked = rows.where(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 20)) < share[F.col("l")] * (1 << 20))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(lang_, g) for t, lang_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (g := counts(t)) is not None]
            at = [np.flatnonzero(g).astype(np.int16) for _, g in kept]
            n = [np.minimum(g[a.astype(np.int64)], 1 << 30).astype(np.int32) for (_, g), a in zip(kept, at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.string()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([x.tobytes() for x in n], pa.binary())], ["l", "at", "n"])

    got = sorted((r["l"], bytes(r["at"]), bytes(r["n"])) for r in in_arrow(picked.select("t", "l"), grams, "l string, at binary, n binary").collect())
    if not got:
        return LanguageModel()
    x = np.zeros((len(got), DIMS), np.float32)
    for i, (_, at, n) in enumerate(got):
        x[i, np.frombuffer(at, np.int16).astype(np.int64)] = np.frombuffer(n, np.int32)
    model = LanguageModel(idf=np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1))
    np.sqrt(x, out=x)
    x *= model.idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    langs, parts = [r[0] for r in got], []
    for one in sorted(set(langs)):
        own = x[[i for i, v in enumerate(langs) if v == one]]
        c = _kmeans(own, k)
        parts.append(c)
        model.owner += [one] * len(c)
        model.limit[one] = float(np.quantile((own @ c.T).max(axis=1), REJECT_QUANTILE)) * REJECT_SLACK
    model.centroids = np.concatenate(parts)
    return model


def predict(df: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Every column of ``df`` but the text, plus prediction, score and rejection (names made unique)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    (t,) = fresh(df, "whole_text")
    keep = [c for c in df.columns if c != text]
    added = fresh(df.select(*[col(c) for c in keep]), *names)
    schema = df.select(*[col(c) for c in keep]).schema.add(added[0], "string").add(added[1], "double").add(added[2], "boolean")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(x) for x in b.column(len(keep)).to_pylist()]
            cols = [b.column(i) for i in range(len(keep))] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, *added])

    return map_arrow(df.select(*[col(c) for c in keep], col(text).alias(t)), label, schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold that never trains (a null id: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
