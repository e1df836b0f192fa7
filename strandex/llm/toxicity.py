"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words (whole runs of letters), the first four and five characters of longer words, and
the four-character grams of runs over ``GLUED`` letters (glued words, scripts without spaces), hashed; a term counts
once, weighted by IDF.  Score = sigmoid(w0 + sum w_i x_i + sum <v_i, v_j> x_i x_j): the
factors learn pairs, such as an insult with a group mention, that additive weights miss.  A term is learnt when
it parts the classes alone (chi-square of ``CHI2``) or among the sample rows of another term (``PAIR_CHI2``, as many
pairs are tried), so words that only a pair reveals count.  Others carry no weight, nor do terms too rare in the
sample, so long clean texts gather no noise.

The model is fitted on the driver by AdaGrad on at most about ``SAMPLE`` labelled rows of each class (by a
hash of the id); its size is fixed (terms x (1 + factors) floats).  Labels join by a shuffled join on the
narrow id column and texts of the sample only.  Scoring is one map over whole texts without a shuffle.

Nulls: null and empty texts get the score of the empty text (never 1); null labels and ids do not train; labels above 0
are toxic; several labels of one id: the largest.  With no labels of either class (empty tables) every score is 0.  Very
long texts are split in blocks that end between words, so every word counts.  Repeated rows get equal scores and train as
often as they occur.  Ties: terms and rows are taken in the order of their hashes and ids, so refits agree.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, fresh, in_arrow, map_arrow

#: Hashed terms (a power of two), factors, expected training rows of a class, epochs.
TERMS, FACTORS, SAMPLE, EPOCHS = 1 << 18, 8, 2500, 12
#: Sample rows a term needs and its chi-square against the label; learning rate, L2 penalty, and the score from
#: which a text is called toxic.
LEAST_ROWS, CHI2, RATE, L2, THRESHOLD = 4, 15.0, 0.15, 1e-4, 0.7
#: Chi-square against the label among the rows of another term (a level of 2e-11, for about a billion pairs).
PAIR_CHI2 = 45.0
#: Weight of false alarms when the intercept is set so that the classes part at ``THRESHOLD``.
ALARM = 5.0
#: Starts of words that count as terms, and letters from which a run counts by its grams as well.
STEMS, GLUED, GRAM = (4, 5), 24, 4
#: Characters of a text that are split at a time.
BLOCK = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")


def _ids(word: str) -> tuple[int, ...]:
    forms = ["w" + word] + [f"{n}{word[:n]}" for n in STEMS if len(word) >= n]
    if len(word) > GLUED:
        forms += {"g" + word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}
    return tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) & (TERMS - 1) for f in forms)


_seen_ids = lru_cache(maxsize=200_000)(_ids)


def _term_ids(word: str) -> tuple[int, ...]:
    return _seen_ids(word) if len(word) <= GLUED else _ids(word)  # long runs are rare and would fill the cache


def terms(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a whole text, sorted."""
    seen: set[str] = set()
    low = (text or "").lower()
    at = 0
    while at < len(low):
        end = min(len(low), at + BLOCK)
        while end < len(low) and low[end].isalnum():  # blocks end between words
            end += 1
        seen.update(_WORD.findall(low, at, end))
        at = end
    return np.unique(np.fromiter((i for w in seen for i in _term_ids(w)), np.int64))


@dataclass
class FactorizationMachine:
    """Weights of the terms that were learnt: sorted hashed ``ids``, their scale, weights and factors."""

    ids: np.ndarray
    x: np.ndarray
    w: np.ndarray
    v: np.ndarray
    w0: float = 0.0
    trained: bool = False

    def rows(self, found: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
        return at[self.ids[at] == found]

    def raw(self, at: np.ndarray) -> float:
        x, v = self.x[at], self.v[at]
        s = x @ v
        return float(self.w0 + self.w[at] @ x + 0.5 * (s @ s - float(((x[:, None] * v) ** 2).sum())))

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(self.rows(terms(text))), -30, 30)))) if self.trained else 0.0


def train(samples: list[tuple[np.ndarray, int]]) -> FactorizationMachine:
    """AdaGrad on (distinct terms, label) rows; deterministic in the order of ``samples``."""
    none = FactorizationMachine(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros((0, FACTORS)))
    labels = np.array([y for _, y in samples])
    if len(set(labels.tolist())) < 2:
        return none
    df = np.bincount(np.concatenate([t for t, _ in samples]), minlength=TERMS)
    hit = np.bincount(np.concatenate([t for t, y in samples if y]), minlength=TERMS)
    n, pos = float(len(samples)), float(labels.sum())
    expected = df * (pos / n)
    spread = expected * (1 - pos / n) * (1 - df / n)
    alone = (df >= LEAST_ROWS) & ((hit - expected) ** 2 >= CHI2 * np.maximum(spread, 1e-9))
    ids = np.flatnonzero(alone | _paired([t for t, _ in samples], labels, df, alone))
    idf = np.log((1 + len(samples)) / df[ids])
    rng = np.random.default_rng(7)
    m = FactorizationMachine(ids, idf / np.log(1 + len(samples)), np.zeros(len(ids)), rng.normal(0, 0.02, (len(ids), FACTORS)), trained=True)
    at = [m.rows(t) for t, _ in samples]
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    gw, gv, g0 = np.full(len(ids), 1e-2), np.full((len(ids), FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            a = at[i]
            x, v = m.x[a], m.v[a]
            s = x @ v
            raw = m.w0 + m.w[a] @ x + 0.5 * (s @ s - float(((x[:, None] * v) ** 2).sum()))
            err = weight[i] * (1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - labels[i])
            dw = err * x + L2 * m.w[a]
            dv = err * (x[:, None] * s[None, :] - (x**2)[:, None] * v) + L2 * v
            gw[a] += dw**2
            gv[a] += dv**2
            g0 += err**2
            m.w[a] -= RATE * dw / np.sqrt(gw[a])
            m.v[a] -= 0.2 * RATE * dv / np.sqrt(gv[a])
            m.w0 -= RATE * err / np.sqrt(g0)
    m.w0 += float(np.log(THRESHOLD / (1 - THRESHOLD))) - _cut(np.array([m.raw(a) for a in at]), labels)
    return m


def _paired(rows: list[np.ndarray], labels: np.ndarray, df: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Terms that do not part the classes alone but do among the rows of another term, and those others.

    Counts of all pairs, one term at a time; the deviation is corrected by 1/2 and its variance taken as 1 at least.
    """
    out = np.zeros(TERMS, bool)
    # a count deviates by its term's rows at most, and by a quarter of the rows it is taken among; less cannot reach the level
    least = PAIR_CHI2**0.5 + 0.5
    ids = np.flatnonzero(df >= least)
    place = np.full(TERMS, -1)
    place[ids] = np.arange(len(ids))
    at = [p[p >= 0] for p in (place[t] for t in rows)]
    of = np.repeat(np.arange(len(at)), [len(a) for a in at])[np.argsort(np.concatenate(at), kind="stable")]
    ends = np.cumsum(df[ids])
    for k in np.flatnonzero(df[ids] >= 4 * least):
        end = ends[k]
        own = of[end - df[ids[k]] : end]
        n, pos = len(own), int(labels[own].sum())
        if min(pos, n - pos) == 0:
            continue
        hit = np.bincount(np.concatenate([at[i] for i in own if labels[i]]), minlength=len(ids))
        both = hit + np.bincount(np.concatenate([at[i] for i in own if not labels[i]]), minlength=len(ids))
        expected = both * (pos / n)
        spread = np.maximum(expected * (1 - pos / n) * (1 - both / n), 1.0)
        found = ids[np.maximum(np.abs(hit - expected) - 0.5, 0) ** 2 >= PAIR_CHI2 * spread]
        found = found[~alone[found]]
        out[found] = True
        out[ids[k]] |= len(found) > 0
    return out


def _cut(raw: np.ndarray, labels: np.ndarray) -> float:
    """The raw score that best parts the classes (false alarms count ``ALARM`` fold), midway between its neighbours."""
    order = np.argsort(raw, kind="stable")
    raw, y = raw[order], labels[order]
    missed = np.concatenate(([0], np.cumsum(y))) / y.sum()
    alarms = np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0])) / (1 - y).sum()
    best = np.flatnonzero(missed + ALARM * alarms <= (missed + ALARM * alarms).min() + 1e-12)
    edges = np.concatenate(([raw[0] - 1], raw, [raw[-1] + 1]))
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> FactorizationMachine:
    """Fit on a bounded sample of the labelled rows of ``docs``."""
    y = labels.where(col(label).isNotNull() & col(doc_id).isNotNull()).groupBy(col(doc_id).alias("i")).agg((F.max(col(label).cast("int")) > 0).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    if not sizes:
        return train([])
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, sample / n))])
    picked = y.where(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 20)) < share[F.col("y")] * (1 << 20))
    rows = docs.select(col(doc_id).alias("i"), col(text).alias("t"))
    # the sample is bounded by the parameter above, so it may be broadcast: texts are not shuffled
    sampled = rows.join(F.broadcast(cut(picked)), "i")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [terms(t).astype(np.int32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary()), b.column(2)], ["i", "t", "y"])

    schema = sampled.select("i", F.lit(b"").alias("t"), "y").schema
    got = sorted((r["i"], bytes(r["t"]), r["y"]) for r in in_arrow(sampled.select("i", "t", "y"), found, schema).collect())
    return train([(np.frombuffer(t, np.int32).astype(np.int64), y_) for _, t, y_ in got])


def score(df: DataFrame, model: FactorizationMachine, text: str = "text", name: str = "score") -> DataFrame:
    """Every column of ``df`` but the text, plus the score (its name made unique)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c != text]
    rest = df.select(*[col(c) for c in keep])
    (added,) = fresh(rest, name)
    (t,) = fresh(df, "whole_text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.score(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(got, pa.float64())], [*keep, added])

    return map_arrow(df.select(*[col(c) for c in keep], col(text).alias(t)), rate, rest.schema.add(added, "double"))
