"""Near-duplicate groups by an LSH forest over MinHash signatures.

Documents link when the Jaccard similarity of their sets of five-word shingles is at least 0.75; a group is
a connected component.  Equal sets collapse first, so exact copies cost one row.

The forest has ``TREES`` sorted signature orders.  Documents that share the first ``DEPTH`` values of an
order form a region.  Round 1: regions above ``DENSE`` rows descend further (adaptive depth), and inside
a region the longest-common-prefix neighbours and the region's first document become candidates; every
document keeps its best and its smallest one, they are confirmed on full sets, and components form.  This
is linear, however large a group of near copies is.  Round 2 loses nothing that shares a region: in each
region at minimum depth that still holds several components, all pairs across components whose sketches
agree are confirmed on full sets in the region's task, and only links that merge components leave it, so
output stays linear.  In such regions above ``DENSE`` rows the largest component is dealt into tiles of that size, and only
rows outside of it (strangers) meet the tiles and each other.

Recall at similarity s is 1 - (1 - s^DEPTH)^TREES: 0.99998 at 0.75 and above 0.999999 at 0.8.

Scale: a node is a distinct set, whatever ids its rows have.  Orders are sorted over ranges, so a region of any size
spreads over tasks; the few rows at the ends of ranges meet in a second pass.  Sets are made and shuffled for nodes with
candidates only; everything else is narrow rows.  Ids whose texts are needed are broadcast up to ``BROADCAST_NODES``
(counted first), beyond that texts meet them by a shuffled join.  Nothing else is broadcast by hand and nothing is
collected.  A dense region of b rows in its largest component and s strangers moves b * ceil(s / DENSE) +
s * (ceil(b / DENSE) + ceil(s / DENSE)) rows: linear in b for up to ``DENSE`` strangers, b * s / 256 for many.

Nulls: null texts, empty ones and ones without words have empty sets and stay alone.  Repeated rows share a node.  An id
with several texts is in the group of each; it does not link them.  A null id links like any other, but a group's id is the
smallest that is not null (null if there is none).  Ties: the smallest id wins, ``keep_one`` takes one of the rows that share it.
Very long texts are whole; one long word counts by its digest.  Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, cut, in_arrow, map_arrow, sized, stored
from .components import components
from .hashing import _mixed, mix, window_hashes

SHINGLE, PERCENT = 5, 75
TREES, DEPTH, VALUES = 20, 3, 128
#: Rows of a region compared as one tile; agreeing sketch values (of VALUES) a candidate needs (4.9 standard
#: deviations below the mean at the threshold); ids that may be broadcast.
DENSE, AGREE, BROADCAST_NODES = 512, 72, 200_000
_MULT, _ADD = _mixed(VALUES, 11) | np.uint64(1), _mixed(VALUES, 12)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's five-word shingles (fewer words: one shingle)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(window_hashes(words, min(SHINGLE, len(words)))) if words else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a non-empty set."""
    out = None
    for at in range(0, len(shingles), 1024):
        got = ((shingles[at : at + 1024, None] * _MULT + _ADD) >> np.uint64(32)).min(axis=0)
        out = got if out is None else np.minimum(out, got)
    return out


def _tree_keys(sig: np.ndarray) -> np.ndarray:
    first = sig[: TREES * DEPTH].reshape(TREES, DEPTH)
    key = np.arange(1, TREES + 1, dtype=np.uint64)
    for d in range(DEPTH):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + first[:, d])
    return key.astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, sets, keys, sketch = [], [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            if len(s):
                sig = signature(s)
                sets.append(_set_key(s))
                keys.append(_tree_keys(sig))
                sketch.append((sig & np.uint64(255)).astype(np.uint8).tobytes())
            else:
                sets.append(None)
                keys.append(None)
                sketch.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "set_key", "keys", "sketch"])


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """part, node, n, comp as arrays, sketches as a matrix."""
    rot = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(b.num_rows, VALUES)
    return (*(b.column(i).to_numpy(zero_copy_only=False) for i in range(4)), rot)


def _near(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, node, n, -, rot) to (node, other, agree): the row before, and the region's first row."""
    carry = None
    for b in batches:
        if not b.num_rows:
            continue
        part, node, n, _, rot = _columns(b)
        if carry is None:
            carry = (part[:1], node[:1], n[:1], rot[:1], node[:1], n[:1], rot[:1])
            fresh_start = True
        else:
            fresh_start = False
        cp, cn, cs, cr, hn, hs, hr = carry
        part_, node_, n_, rot_ = np.concatenate((cp, part)), np.concatenate((cn, node)), np.concatenate((cs, n)), np.concatenate((cr, rot))
        start = np.concatenate(([True], part_[1:] != part_[:-1]))
        if fresh_start:
            start[1] = True
        at = np.maximum.accumulate(np.where(start, np.arange(len(part_)), 0))
        hub_node, hub_n, hub_rot = node_[at], n_[at], rot_[at]
        head = at == 0  # the region that began in an earlier batch
        hub_node[head], hub_n[head], hub_rot[head] = hn[0], hs[0], hr[0]
        same = ~start
        out = []
        for other, size, sk in ((node_[:-1], n_[:-1], rot_[:-1]), (hub_node[1:], hub_n[1:], hub_rot[1:])):
            agree = (rot_[1:] == sk).sum(axis=1)
            ok = same[1:] & (agree >= AGREE) & _near(n_[1:], size) & (other != node_[1:])
            out += [(node_[1:][ok], other[ok], agree[ok]), (other[ok], node_[1:][ok], agree[ok])]
        carry = (part_[-1:], node_[-1:], n_[-1:], rot_[-1:], hub_node[-1:], hub_n[-1:], hub_rot[-1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(3)], ["node", "other", "agree"])


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in one range of the sorted order, and the range's first and last rows (with their sketches)."""
    ends: list[pa.RecordBatch] = []
    first: list[pa.RecordBatch] = []

    def marked() -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                first.extend([b.slice(0, 1)] if not first else [])
                ends[:] = [b.slice(b.num_rows - 1)]
                yield b

    def full(links: pa.RecordBatch | None, at: pa.RecordBatch | None) -> pa.RecordBatch:
        n = links.num_rows if at is None else at.num_rows
        none = lambda kind: pa.nulls(n, kind)
        cols = [links.column(0), links.column(1), links.column(2), none(pa.int64()), none(pa.int64()), none(pa.binary())] if at is None else [at.column(1), none(pa.int64()), none(pa.int64()), at.column(0), at.column(2), at.column(4)]
        return pa.RecordBatch.from_arrays(cols, ["node", "other", "agree", "part", "n", "rot"])

    for links in _neighbours(marked()):
        yield full(links, None)
    for at in first + ends:
        yield full(None, at)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, as batches that hold whole parts."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(0).to_numpy()
        cutoff = int(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))[-1])
        if held and (cutoff or held[-1].column(0)[-1].as_py() != part[0]):
            yield pa.concat_batches([*held, b.slice(0, cutoff)])
            held = []
        elif cutoff:
            yield b.slice(0, cutoff)
        held.append(b.slice(cutoff))
    if held:
        yield pa.concat_batches(held)


def _parts(b: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    part = b.column(0).to_numpy()
    bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))).tolist()
    return zip(bounds[:-1], bounds[1:], strict=True)


def _candidates(i: int, hi: int, n: np.ndarray, comp: np.ndarray, rot: np.ndarray, side: np.ndarray, two: bool) -> np.ndarray:
    """Later rows of the part, in another component, that may link with row ``i``."""
    rest = slice(i + 1, hi)
    ok = (comp[rest] != comp[i]) & _near(n[rest], n[i])
    if two:
        ok &= side[rest] == 1
    js = np.flatnonzero(ok) + i + 1
    return js[(rot[js] == rot[i]).sum(axis=1) >= AGREE] if len(js) else js


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (part, node, n, comp, rot, side) by part, those with a candidate in another component.

    A part is a region (side 0 throughout), or a tile of a dense one (pairs of side 0 with side 1).
    """
    for b in _regions(batches):
        _, _, n, comp, rot = _columns(b)
        side = b.column(5).to_numpy()
        flag = np.zeros(b.num_rows, bool)
        for lo, hi in _parts(b):
            if hi - lo == 1 or (comp[lo:hi] == comp[lo]).all():
                continue
            two = bool(side[lo:hi].any())
            for i in range(lo, hi - 1):
                if two and side[i]:
                    break
                js = _candidates(i, hi, n, comp, rot, side, two)
                if len(js):
                    flag[i] = True
                    flag[js] = True
        yield b.filter(pa.array(flag))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those rows with full sets, by part, to confirmed links that merge components (a, b)."""
    for b in _regions(batches):
        _, node, n, comp, rot = _columns(b)
        side, comp = b.column(5).to_numpy(), comp.copy()
        raw = b.column(6)
        links: list[tuple[int, int]] = []
        for lo, hi in _parts(b):
            two = bool(side[lo:hi].any())
            sets = [np.frombuffer(raw[i].as_py(), np.uint64) for i in range(lo, hi)]
            for i in range(lo, hi - 1):
                if two and side[i]:
                    break
                js = _candidates(i, hi, n, comp, rot, side, two)
                if not len(js):
                    continue
                x, ys = sets[i - lo], [sets[j - lo] for j in js.tolist()]
                sizes = np.array([len(y) for y in ys])
                every = np.concatenate(ys)
                hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
                shared = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
                for j in js[100 * shared >= PERCENT * (len(x) + sizes - shared)].tolist():
                    if comp[j] != comp[i]:
                        links.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
                        view = comp[lo:hi]
                        view[view == comp[j]] = comp[i]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _set_key(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [shingle_set(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in got], pa.binary()), pa.array([s.tobytes() for s in got], pa.binary())], ["set_key", "set"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            ok.append(100 * shared >= PERCENT * (len(both) - shared))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "linked"])


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``doc_id`` (integer), ``n_shingles, component_id, kept``."""
    signed, groups = _grouped(df.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")))
    out = signed.select("doc_id", "n_shingles", "set_key").join(groups.select("set_key", "component_id"), "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text`` to signed rows (``doc_id, n_shingles, set_key, ..``) and groups: ``set_key, component_id, chosen`` for
    every set; ``chosen`` is one set of each group that the group's smallest id has."""
    signed = cut(in_arrow(docs, _sign, "doc_id long, n_shingles long, set_key binary, keys array<long>, sketch binary"))
    classes = signed.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    comp = _components(docs, classes)
    linked = classes.select("set_key", "node", "low").join(comp, "node")
    order = F.struct(F.col("low").isNull().alias("z"), "low", "set_key")
    best = linked.groupBy("comp").agg(F.min("low").alias("component_id"), F.min(order)["set_key"].alias("best"))
    found = linked.join(best, "comp").select("set_key", "component_id", (F.col("set_key") == F.col("best")).alias("chosen"))
    alone = classes.join(comp, "node", "left_anti").select("set_key", F.col("low").alias("component_id"), F.lit(True).alias("chosen"))
    return signed, found.unionByName(alone)


def _components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, comp`` of every set that is linked with another one."""
    # regions at minimum depth with at least two sets
    rows = classes.select("node", F.posexplode("keys").alias("tree", "key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = rows.join(sizes, "key")
    turn = F.expr(f"concat(substring(sketch, 1 + tree * {DEPTH}), substring(sketch, 1, tree * {DEPTH}))")
    regions = cut(shared.join(classes.select("node", "n", "sketch"), "node").select("key", "rows", "node", "n", turn.alias("rot")))

    # round 1: neighbours by longest common prefix, deeper in dense regions
    deeper = F.when(F.col("rows") > DENSE, F.least(F.lit(VALUES - DEPTH), 1 + F.ceil(F.log2(F.col("rows") / DENSE))).cast("int")).otherwise(0)
    part = F.xxhash64("key", F.expr(f"substring(rot, {DEPTH + 1}, deeper)"))
    ordered = regions.withColumn("deeper", deeper).select(part.alias("part"), "node", "n", F.col("node").alias("comp"), "rot")
    ordered = ordered.repartitionByRange("part", "rot", "node").sortWithinPartitions("part", "rot", "node")
    near = stored(in_arrow(ordered, _ranged, "node long, other long, agree long, part long, n long, rot binary"))
    # first and last rows of the ranges: two for each of them
    ends = near.where("other is null").select("part", "node", "n", F.col("node").alias("comp"), "rot").distinct().repartition(1).sortWithinPartitions("part", "rot", "node")
    near = near.where("other is not null").select("node", "other", "agree").unionByName(in_arrow(ends, _neighbours, "node long, other long, agree long"))
    best = near.groupBy("node").agg(F.max_by("other", F.struct(F.col("agree"), -F.col("other"))).alias("x"), F.min(F.when(F.col("agree") * 100 >= VALUES * PERCENT, F.col("other"))).alias("y"))
    pairs = best.select("node", F.explode(F.array("x", "y")).alias("other")).where("other is not null")
    tested = cut(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    tested = sized(tested, tested.count())
    sets = _sets_of(docs, classes, tested.select(F.col("a").alias("node")).union(tested.select(F.col("b").alias("node"))).distinct())
    links = cut(_linked(tested, sets))
    comp = cut(components(links))

    # round 2: what still lies apart in a region; sketches move for such regions alone
    labelled = regions.select("key", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counts = cut(labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")))
    mixed = counts.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("rows"), F.max(F.struct("n", "comp")).alias("big")).where("comps > 1")
    mixed = cut(sized(mixed, counts.count()).select("key", F.col("rows").alias("all"), F.col("big.n").alias("big_rows"), F.col("big.comp").alias("big")))
    apart = labelled.join(mixed, "key")
    apart = cut(regions.drop("rows").join(apart, ["key", "node"]))
    by_part = lambda x: x.repartition("part").sortWithinPartitions("part", "side", "node")
    close = cut(in_arrow(by_part(_tiles(apart)), _across, "part long, node long, n long, comp long, rot binary, side int"))
    missing = close.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    more = _sets_of(docs, classes, missing)
    merged = cut(in_arrow(by_part(close.join(sets.union(more), "node").select(*close.columns, "set")), _merge, "a long, b long").distinct())
    return cut(components(links.union(merged))) if merged.take(1) else comp


def _tiles(apart: DataFrame) -> DataFrame:
    """Rows of regions (``key, node, n, comp, rot``, the region's rows ``all``, its largest component ``big`` and that one's
    rows) as parts to compare: a region as it is, or for a dense one strangers with tiles of the largest component (sides 0 and
    1) and with each other."""
    out = ["node", "n", "comp", "rot"]
    whole = apart.where(F.col("all") <= DENSE).select(F.col("key").alias("part"), *out, F.lit(0).alias("side"))
    dense = apart.where(F.col("all") > DENSE)
    tiles = {"big_tiles": F.ceil(F.col("big_rows") / DENSE).cast("int"), "odd_tiles": F.ceil((F.col("all") - F.col("big_rows")) / DENSE).cast("int")}
    inside = F.col("comp") == F.col("big")
    dense = dense.withColumns(tiles).withColumn("own", F.pmod(F.xxhash64("node"), F.when(inside, F.col("big_tiles")).otherwise(F.col("odd_tiles"))).cast("int"))
    part = lambda kind, i, j: F.xxhash64("key", F.lit(kind), i, j).alias("part")
    big = dense.where(inside).withColumn("to", F.explode(F.expr("sequence(0, odd_tiles - 1)"))).select(part("big", F.col("own"), F.col("to")), *out, F.lit(1).alias("side"))
    odd = dense.where(~inside)
    meet = odd.withColumn("to", F.explode(F.expr("sequence(0, big_tiles - 1)"))).select(part("big", F.col("to"), F.col("own")), *out, F.lit(0).alias("side"))
    each = odd.withColumn("to", F.explode(F.expr("sequence(0, odd_tiles - 1)"))).select(part("odd", F.least("own", "to"), F.greatest("own", "to")), *out, F.when(F.col("own") > F.col("to"), 1).otherwise(0).alias("side"))
    return whole.unionByName(big).unionByName(meet).unionByName(each)


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Full sets (``node, set``) of the given nodes, from the texts of their smallest ids."""
    wanted = cut(classes.select("node", "set_key", "low").join(nodes, "node", "left_semi"))
    lows = wanted.select("low").distinct()
    few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    texts = docs.join(F.broadcast(lows) if few else lows, docs["doc_id"].eqNullSafe(lows["low"]), "left_semi").select("text")
    sets = in_arrow(texts, _sets, "set_key binary, set binary").groupBy("set_key").agg(F.first("set").alias("set"))
    return cut(sets.join(wanted, "set_key").select("node", "set"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
    return in_arrow(both, _confirm, "a long, b long, linked boolean").where("linked").select("a", "b")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay when one document of each group does, one that has the group's smallest id; rows without
    words all stay.  All columns as they were.

    An id of one row is decided by id.  Ids to drop, repeated and null ones are broadcast up to ``BROADCAST_NODES`` (counted
    first), so texts stay where they are read; beyond that they are shuffled.  Rows of repeated and null ids are told apart by
    their sets and meet their group by a shuffle."""
    signed, groups = _grouped(df.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")))
    groups = cut(groups)
    rows = signed.select("doc_id", "set_key").join(groups, "set_key", "left")
    stays = F.col("set_key").isNull() | (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    verdict = rows.groupBy(F.col("doc_id").alias("own_id")).agg(F.count(F.lit(1)).alias("n"), F.max(stays).alias("stays"))
    odd = cut(verdict.where("own_id is null or n > 1 or not stays"))  # every other id is one row that stays
    few = odd.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    names = [f"r{i}" for i in range(len(df.columns))]
    whole = df.select(*[col(c).alias(n) for c, n in zip(df.columns, names, strict=True)], col(doc_id).cast("long").alias("kept_id"), col(text).alias("kept_text"))

    def meet(ids: DataFrame, how: str) -> DataFrame:
        return whole.join(F.broadcast(ids) if few else ids, whole["kept_id"].eqNullSafe(ids["own_id"]), how)

    alone = meet(odd.select("own_id"), "left_anti").select(*names)
    repeated = odd.where("(own_id is null or n > 1) and stays").select("own_id")
    if repeated.take(1):
        some = meet(repeated, "left_semi")
        keyed = map_arrow(some, _with_key, T.StructType([*some.schema.fields, T.StructField("kept_key", T.BinaryType())]))
        last = groups.where("chosen").select(F.col("set_key").alias("kept_key"), F.col("component_id").alias("kept_of"))
        best = keyed.join(last, "kept_key").where(F.col("kept_id").eqNullSafe(F.col("kept_of")))
        one = best.groupBy("kept_key").agg(F.first(F.struct(*names)).alias("row")).select("row.*")
        alone = alone.unionByName(keyed.where("kept_key is null").select(*names)).unionByName(one)
    return alone.toDF(*df.columns)


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is the text, plus its set's key."""
    for b in batches:
        keys = [_set_key(shingle_set(t)) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], [*b.schema.names, "kept_key"])
