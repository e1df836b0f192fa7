"""Quality rules by robust multivariate outliers (minimum covariance determinant), DataFrame only.

Base statistics of every whole text come from one native pass.  Location and scatter of the rows that pass the base rules
are estimated by MCD, the ``KEEP_SHARE`` of rows whose covariance has the smallest determinant, for three nested groups:
a language's source, the language, all rows.  Each group has three deterministic robust starts (spreads, spatial signs,
hyperbolic tangents); concentration steps refit on the rows nearest by Mahalanobis distance, after ``SCREEN`` steps the
start with the smallest determinant goes on until the determinants fall no more.  A source's estimate is shrunk towards its
language's and that towards the one of all rows, by the weight n / (n + ``PRIOR``), so small groups are judged by the same
formula as large ones.  A document goes when its transformed statistic vector lies beyond ``CUTOFF``, where the scatter is
the group's plus the sampling noise of that text: its counts vary like Poisson counts, so a long text is judged more sharply
than a short one.  The only floor is a ridge of one fixed-point unit, which keeps the matrix regular.

Scale: statistics are written once as narrow rows; every later pass is a grouped aggregate with map-side partial sums, so a
source that holds a third of all rows costs one partial row per task.  Sums run over fixed-point integers and quantiles over
integer bins (0.1 % of a distance wide), hence results do not depend on partitioning.

Nulls: a null text has no words (``base_failed``); null languages and sources are values of their own; a null id is kept.
Empty texts fail the base rules; very long ones are whole, as any other.  Ties: rows of one distance bin enter a
concentration step together.  Repeated rows count as often as they occur and are judged alike.  Extra columns are ignored
whatever their names.  An empty table, or one without a row that passes the base rules, has no estimates and rejects nothing more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, col, cut, fresh, join_small, sized, stored, words

#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Share of a group's rows that a concentration step keeps, steps for all starts, the fall of all log determinants together
#: below which steps end, and the most steps (a guard: steps never raise a determinant, so they end by themselves).
KEEP_SHARE, SCREEN, CONVERGED, MOST_STEPS = 0.75, 2, 1e-3, 40
#: Squared-distance limit (0.999 quantile of chi-square with five degrees of freedom), and the factor that
#: makes the scatter of the nearest 75 % consistent for normal data.
CUTOFF, CONSISTENCY = 20.52, 1.41
#: Rows that a group's parent counts for when estimates are shrunk; groups that may be broadcast.
PRIOR, BROADCAST_GROUPS = 100, 20_000
#: Fixed-point unit of the transformed statistics; one unit is also the ridge (a standard deviation) of every scatter.
SCALE = 1024
DIMS = ("x_len", "x_sym", "x_dup", "x_rep", "x_up")
_P = len(DIMS)
_LOWER = [(i, j) for i in range(_P) for j in range(i + 1)]
#: Fixed point of the sums of bounded values in the starts.
_UNIT = 1 << 20


def _repeat_words(hashes: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more; ``hashes``: one hash per word."""
    n = F.size(hashes)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(sorted_windows: Column) -> Column:
        twice = F.filter(
            sorted_windows,
            lambda x, k: F.coalesce(F.get(sorted_windows, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_windows, k + 1)["h"] == x["h"], F.lit(False)),
        )
        begins = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            begins,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def count(bound: Column) -> Column:
        # hash sets are linear; only texts that do repeat pay for the sort
        order = F.array_sort(F.transform(bound, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(bound)) == F.size(bound), F.lit(0)).otherwise(F.get(F.transform(F.array(order), covered), F.lit(0)))

    return F.get(F.transform(F.array(windows), count), F.lit(0))


def base_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus one struct column (its name is the last of ``columns``) of base statistics.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters`` (long)
    and ``base_failed``.  A generator binds the words once, so no expression is evaluated twice.
    """
    (name,) = fresh(df, "stats")
    whole = F.coalesce(col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0)

    def derive(w: Column, ls: Column) -> Column:
        n = F.size(w).cast("long")
        chars = F.length(F.array_join(w, "")).cast("long")
        repeated = F.get(F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), _repeat_words), F.lit(0)).cast("long")
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            F.length(F.regexp_replace(whole, "\\P{Lu}+", "")).cast("long").alias("n_upper"),
        )

    one = F.transform(F.array(F.struct(words(col(text)).alias("w"), lines.alias("l"))), lambda x: derive(x["w"], x["l"]))
    out = df.select("*", F.explode(one).alias(name))
    failed = (F.col(f"{name}.n_words") < MIN_WORDS) | (100 * F.col(f"{name}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{name}.n_words"))
    return out.withColumn(name, F.col(name).withField("base_failed", failed))


def _vector(s: str) -> dict[str, Column]:
    """Transformed statistics as fixed-point integers; each is bounded, so sums of products fit a long."""
    get = lambda f: F.col(f"{s}.{f}").cast("double")
    n = F.greatest(get("n_words"), F.lit(1.0))
    raw = {
        # shrunk mean word length: short texts vary more
        "x_len": F.log((get("word_chars") + 300.0) / (get("n_words") + 50.0)),
        "x_sym": F.sqrt(get("n_symbols") / n),
        "x_dup": F.sqrt(get("n_dup_lines") / (get("n_lines") + 4.0)),
        "x_rep": F.sqrt(get("n_repeat_words") / n),
        "x_up": F.sqrt(get("n_upper") / (get("word_chars") + 40.0)),
    }
    return {k: F.round(F.least(v, F.lit(12.0)) * SCALE).cast("long") for k, v in raw.items()}


def _noise(s: str) -> dict[str, Column]:
    """Sampling variance of each transformed statistic of one text, its counts taken as Poisson.

    The square root of such a count has the variance 1/4; repeated words come in pairs of windows.
    """
    get = lambda f: F.col(f"{s}.{f}").cast("double")
    n, chars = F.greatest(get("n_words"), F.lit(1.0)), get("word_chars")
    raw = [chars / F.pow(chars + 300.0, 2), 0.25 / n, 0.25 / (get("n_lines") + 4.0), 0.25 * 2 * WINDOW / n, 0.25 / (chars + 40.0)]
    return {f"v{i}": v for i, v in enumerate(raw)}


def _key(lang: Column, source: Column) -> tuple[Column, Column]:
    tag = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    return tag(lang), tag(source)


def _groups(gl: str = "gl", gs: str = "gs") -> list[Column]:
    """The nested groups of a row: its language's source, its language, all rows."""
    return [F.concat_ws("\u0001", F.lit("source"), gl, gs), F.concat_ws("\u0001", F.lit("language"), gl), F.lit("all")]


def _x(i: int) -> str:
    return f"({DIMS[i]} * {1 / SCALE}D)"


def _inverted(rows: DataFrame) -> DataFrame:
    """Rows of a scatter ``c{i}{j}`` to those plus ``logdet`` and its inverse ``w{i}{j}``, one pivot swept at a time.

    Columns are marked as never null and divisions written as powers, so generated code stays small."""
    rest = [c for c in rows.columns]
    out = rows.selectExpr(*rest, *[f"coalesce(c{i}{j}, {float(i == j)}D) as w{i}{j}" for i, j in _LOWER], "0D as logdet")
    w = lambda i, j: f"w{max(i, j)}{min(i, j)}"
    for k in range(_P):
        out = out.selectExpr(*rest, *[w(i, j) for i, j in _LOWER], f"logdet + ln({w(k, k)}) as logdet", f"power({w(k, k)}, -1D) as inv")
        swept = {(i, j): "-inv" if i == j == k else f"{w(i, j)} * inv" if k in (i, j) else f"{w(i, j)} - {w(i, k)} * {w(j, k)} * inv" for i, j in _LOWER}
        out = out.selectExpr(*rest, *[f"{v} as {w(i, j)}" for (i, j), v in swept.items()], "logdet")
    return out.selectExpr(*rest, *[f"-{w(i, j)} as {w(i, j)}" for i, j in _LOWER], "logdet")


def _distance() -> Column:
    """Squared Mahalanobis distance of the vector to ``m*`` by the inverse scatter ``w*``."""
    z = [f"({_x(i)} - m{i})" for i in range(_P)]
    return F.expr("greatest(0D, " + " + ".join(f"{1 if i == j else 2}D * w{i}{j} * {z[i]} * {z[j]}" for i, j in _LOWER) + ")")


def _starts(members: DataFrame, quartiles: DataFrame, n: int) -> DataFrame:
    """Robust first estimates ``g, s, m*, c*`` of each group: spreads alone, spatial signs, hyperbolic tangents."""
    at, spread = {i: F.col("q")[i][1] / SCALE for i in range(_P)}, {i: F.greatest((F.col("q")[i][2] - F.col("q")[i][0]) / (1.349 * SCALE), F.lit(1 / SCALE)) for i in range(_P)}
    scale = cut(quartiles.select("g", *[at[i].alias(f"m{i}") for i in range(_P)], *[spread[i].alias(f"d{i}") for i in range(_P)]))
    z = join_small(members, scale, ["g"], n, BROADCAST_GROUPS, "inner")
    z = z.select("g", *[F.expr(f"({_x(i)} - m{i}) / d{i} as z{i}") for i in range(_P)])
    z = z.withColumn("far", F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, _P)), F.col("z0") * F.col("z0"))))
    z = z.select("g", *[F.when(F.col("far") > 0, F.col(f"z{i}") / F.col("far")).otherwise(0.0).alias(f"u{i}") for i in range(_P)], *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(_P)])
    fixed = lambda v: F.sum(F.round(v * _UNIT).cast("long")) / _UNIT  # noqa: E731  an exact sum, whatever the order of rows
    sums = [fixed(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"uu{i}{j}") for i, j in _LOWER] + [fixed(F.col(f"t{i}")).alias(f"ts{i}") for i in range(_P)] + [fixed(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"tt{i}{j}") for i, j in _LOWER]
    got = z.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *sums).join(scale, "g")
    tanh = {(i, j): F.col(f"tt{i}{j}") / F.col("n") - F.col(f"ts{i}") * F.col(f"ts{j}") / (F.col("n") * F.col("n")) for i, j in _LOWER}
    made = [{(i, j): F.lit(float(i == j)) for i, j in _LOWER}, {(i, j): _P * F.col(f"uu{i}{j}") / F.col("n") for i, j in _LOWER}, tanh]
    rows = [F.struct(F.lit(s).alias("s"), *[(c[i, j] * F.col(f"d{i}") * F.col(f"d{j}") + (F.lit(SCALE**-2.0) if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _LOWER]) for s, c in enumerate(made)]
    return got.select("g", *[f"m{i}" for i in range(_P)], F.explode(F.array(*rows)).alias("e")).select("g", *[f"m{i}" for i in range(_P)], "e.*")


def _step(members: DataFrame, estimates: DataFrame, n: int) -> DataFrame:
    """One concentration step for every group and start: mean and covariance of the nearest rows."""
    bins = F.least(F.floor(1024 * F.log1p(1000 * _distance())), F.lit(1 << 16)).cast("long")
    near = join_small(members, estimates, ["g"], n, BROADCAST_GROUPS, "inner").select("g", "s", *DIMS, bins.alias("bin"))
    limit = cut(sized(near.groupBy("g", "s").agg(F.expr(f"percentile_disc({KEEP_SHARE}) within group (order by bin)").alias("limit")), n))
    kept = join_small(near, limit, ["g", "s"], n, BROADCAST_GROUPS, "inner").where(F.col("bin") <= F.col("limit"))
    sums = kept.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"sum({d}) as s{i}") for i, d in enumerate(DIMS)], *[F.expr(f"sum({DIMS[i]} * {DIMS[j]}) as p{i}{j}") for i, j in _LOWER])
    cov = {(i, j): f"(p{i}{j} / n - (s{i} / n) * (s{j} / n)) / {SCALE**2}D" for i, j in _LOWER}
    moments = sums.selectExpr("g", "s", *[f"s{i} / n / {SCALE}D as m{i}" for i in range(_P)], *[f"{f'greatest(0D, {c}) + {SCALE**-2.0!r}D' if i == j else c} as c{i}{j}" for (i, j), c in cov.items()])
    return cut(_inverted(sized(moments, n)))


def mcd(members: DataFrame) -> tuple[DataFrame, int]:
    """Minimum covariance determinant of each group ``g`` of ``members`` (``g`` and the vector): ``g, n, s, m*, c*, logdet``
    (``c*``: plain covariance of the kept rows plus the ridge), and the number of groups."""
    quartiles = members.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.percentile(d, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for d in DIMS]).alias("q"))
    quartiles = cut(quartiles)
    n = quartiles.count()
    estimates = cut(_inverted(_starts(members, quartiles, n)))
    for _ in range(SCREEN):
        estimates = _step(members, estimates, 3 * n)
    names = [c for c in estimates.columns if c != "g"]
    best = estimates.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("logdet", "s")).alias("e"))
    estimates, before = cut(sized(best, n).select("g", "e.*")), math.inf
    for _ in range(MOST_STEPS):
        estimates = _step(members, estimates, n)
        now = estimates.agg(F.sum("logdet")).first()[0] or 0.0
        if before - now < CONVERGED:
            break
        before = now
    return quartiles.select("g", "n").join(estimates.select("g", "s", *[f"m{i}" for i in range(_P)], *[f"c{i}{j}" for i, j in _LOWER], "logdet"), "g"), n


def _shrunk(own: str, parent: str) -> list[Column]:
    """``m*, c*`` of a group drawn towards its parent's: the moments of ``n`` rows of its own and ``PRIOR`` of the parent."""
    w = F.coalesce(F.col(f"{own}.n"), F.lit(0)) / (F.coalesce(F.col(f"{own}.n"), F.lit(0)) + PRIOR)
    get = lambda side, k: F.coalesce(F.col(f"{side}.{k}"), F.col(f"{parent}.{k}"))
    gap = [get(own, f"m{i}") - F.col(f"{parent}.m{i}") for i in range(_P)]
    means = [(w * get(own, f"m{i}") + (1 - w) * F.col(f"{parent}.m{i}")).alias(f"m{i}") for i in range(_P)]
    return means + [(w * get(own, f"c{i}{j}") + (1 - w) * F.col(f"{parent}.c{i}{j}") + w * (1 - w) * gap[i] * gap[j]).alias(f"c{i}{j}") for i, j in _LOWER]


def fit(rows: DataFrame) -> tuple[DataFrame, int]:
    """Estimates ``gl, gs, m*, c*`` for every pair of language and source, and the number of pairs.  ``rows``: stored rows
    ``gl, gs, base_failed`` and the vector."""
    good = rows.where(~F.col("base_failed"))
    members = good.select(F.explode(F.array(*_groups())).alias("g"), *DIMS)
    estimates, n = mcd(members)
    pairs = cut(rows.select("gl", "gs").distinct().select("gl", "gs", *[g.alias(f"g{k}") for k, g in enumerate(_groups())]))
    consistent = [(CONSISTENCY * (F.col(f"c{i}{j}") - (SCALE**-2.0 if i == j else 0.0)) + (SCALE**-2.0 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _LOWER]
    table = cut(sized(estimates, n).select("g", F.struct("n", *[f"m{i}" for i in range(_P)], *consistent).alias("e")))
    for k in range(3):
        pairs = pairs.join(table.select(F.col("g").alias(f"g{k}"), F.col("e").alias(f"e{k}")), f"g{k}", "left")
    pairs = pairs.where("e2 is not null").withColumn("e1", F.struct(*_shrunk("e1", "e2")))
    out = cut(sized(pairs, n).select("gl", "gs", *_shrunk("e0", "e1")))
    return out, out.count()


def _judge(df: DataFrame, model: tuple[DataFrame, int]) -> DataFrame:
    """Adds ``distance`` to the group's estimates and ``outlier``, the verdict that allows for the text's own noise
    (both null without estimates); ``df`` has ``gl, gs``, the vector and its noise."""
    table, n = model
    got = join_small(df, cut(_inverted(table)).drop("logdet"), ["gl", "gs"], n, BROADCAST_GROUPS)
    got = got.withColumn("distance", _distance()).drop(*[f"w{i}{j}" for i, j in _LOWER])
    got = got.withColumns({f"c{i}{i}": F.col(f"c{i}{i}") + F.col(f"v{i}") for i in range(_P)})
    # a generator keeps a filter on the verdict from drawing the whole inversion into its condition
    return _inverted(got).withColumn("outlier", F.explode(F.array(_distance() > CUTOFF)))


def _vectors(stats: DataFrame, *keep: str | Column) -> DataFrame:
    gl, gs = _key(F.col("_lang"), F.col("_source"))
    return stats.select(*keep, gl.alias("gl"), gs.alias("gs"), "stats.*", *[v.alias(k) for k, v in (_vector("stats") | _noise("stats")).items()])


def quality_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, base statistics, ``base_failed, kept, distance`` (without the text's noise)."""
    src = df.select(col(doc_id).alias("doc_id"), col(text).alias("_text"), col(lang).alias("_lang"), col(source).alias("_source"))
    rows = cut(_vectors(base_stats(src, "_text"), "doc_id"))
    out = _judge(rows, fit(rows))
    kept = ~F.col("base_failed") & ~F.coalesce("outlier", F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def quality_filter(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that pass, all columns as they were.

    Rows that pass the base rules are written once beside their statistics, as Parquet in the shared folder (columns need
    types that Parquet has); estimates read the narrow columns alone and the verdict is a row-local expression, so
    statistics are computed once and texts are never shuffled (beyond ``BROADCAST_GROUPS`` groups, joined by a shuffle).
    """
    names = [f"r{i}" for i in range(len(df.columns))]  # columns of any name, in the writer's eyes
    src = df.select(*[col(c).alias(n) for c, n in zip(df.columns, names, strict=True)], col(text).alias("_text"), col(lang).alias("_lang"), col(source).alias("_source"))
    rows = stored(_vectors(base_stats(src, "_text"), *names).where(~F.col("base_failed")))
    model = fit(rows.drop(*names))
    passed = _judge(rows, model).where(~F.coalesce("outlier", F.lit(False)))
    return passed.select(*names).toDF(*df.columns)
