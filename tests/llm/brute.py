"""Plain Python versions of the operators, for small tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(docs):
    """The smallest id reachable from each row of (id, text), in order; all pairs of rows compared."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    low = {}
    for a, (i, _) in enumerate(docs):
        r = find(a)
        low[r] = min((x for x in (i, low.get(r)) if x is not None), default=None)
    return [low[find(a)] for a in range(len(docs))]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def shard(doc_id, n):
    return jump(int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16), n)


def targets(sizes):
    """Source to target by repeated resharing; sizes: source (or None) to words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, total = {}, set(order), 1.5 * sum(sizes.values())
    while left:
        rest = total - sum(out.values())
        w = sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * rest / w >= 2 * sizes[s]]
        if not over:
            out |= {s: weight[s] * rest / w for s in left}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= set(over)
    return out


def mix(docs):
    """docs: (id, text, source), ids distinct; id to (size, target, taken), and the ids taken in order of finish."""
    rows = [(i, len(words(t)), s) for i, t, s in docs]
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    goal = targets(dict(sizes))
    turns = []
    for s in sizes:
        done = 0
        own = sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
        for i, n, _ in own:
            done += n
            if n and goal[s]:
                turns += [((done + p * sizes[s]) / goal[s], hashlib.md5(str(i).encode()).hexdigest(), s is None, s or "", p, i, n) for p in (0, 1)]
    taken, order, used, budget = Counter(), [], 0, sum(goal.values())
    for t in sorted(turns):
        used += t[-1]
        if used > budget:
            break
        taken[t[-2]] += t[-1]
        order.append(t[-2])
    return {i: (n, goal[s], taken[i]) for i, n, s in rows}, order


def tokens(text):
    spaced = "".join(f" {c} " if 0x3400 <= ord(c) <= 0x9FFF else c for c in (text or "").lower())
    return [w for w in re.split(r"[^0-9a-z\u0080-\U0010ffff]+", spaced) if w]


def overlap(doc, item, least=10):
    """Most equal words of an overlap over all diagonals that hold a run of the masks, or 0."""
    best, least = 0, min(least, len(item))
    masks = ("111111", "11011011", "1100110011") + ("1" * len(item),) * (len(item) < 6)
    for d in range(-len(item), len(doc)):
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        same = [doc[i + d] == item[i] for i in range(lo, hi)]
        seeded = any(all(same[i + k] for k, c in enumerate(m) if c == "1") for m in masks for i in range(len(same) - len(m) + 1))
        if not seeded:
            continue
        score = n = top = got = 0
        for x in [*same, *[False] * len(same)]:  # the tail closes the last stretch
            score, n = score + (1 if x else -2), n + x
            if score <= 0:
                best = max(best, got if got >= least else 0)
                score = n = top = got = 0
            elif score > top:
                top, got = score, n
    return best


def verdict(rules, url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [(len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def logdet(c):
    return np.linalg.slogdet(c)[1]


def _covariance(x):
    return np.cov(x.T, bias=True) / 1024**2 + np.eye(x.shape[1]) / 1024**2


def mcd_of_every_subset(x, keep=0.75):
    """Mean, covariance and log determinant of the best of all subsets."""
    h = math.ceil(keep * len(x))
    best = min((np.array(s) for s in itertools.combinations(range(len(x)), h)), key=lambda s: logdet(_covariance(x[s])))
    return x[best].mean(axis=0) / 1024, _covariance(x[best]), logdet(_covariance(x[best]))


def mcd(x, keep=0.75, starts=60):
    """The same by concentration from many random small subsets."""
    rng, h, best = np.random.default_rng(0), math.ceil(keep * len(x)), None
    for _ in range(starts):
        own = x[rng.permutation(len(x))[: x.shape[1] + 1]]
        for _ in range(50):
            m, s = own.mean(axis=0) / 1024, _covariance(own)
            near = x[np.argsort(distance(x, m, s), kind="stable")[:h]]
            if len(own) == len(near) and (own == near).all():
                break
            own = near
        got = (logdet(_covariance(own)), own.mean(axis=0) / 1024, _covariance(own))
        best = got if best is None or got[0] < best[0] else best
    return best[1], best[2], best[0]


def shrunk(own, n, parent, prior=100):
    w, gap = n / (n + prior), own[0] - parent[0]
    return w * own[0] + (1 - w) * parent[0], w * own[1] + (1 - w) * parent[1] + w * (1 - w) * np.outer(gap, gap)


def distance(x, m, s):
    z = x / 1024 - m
    return np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z)


def crc(text):
    return zlib.crc32((text or "").encode())
