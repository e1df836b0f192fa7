"""Quality, language, toxicity, sharding, mixing, token counts: brute force and odd inputs."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex.llm import langid, mixing, quality, registry, sharding, tokencount, toxicity
from strandex.llm import decontam  # noqa: F401

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, Stats string, size int, score string, `a.b` int"
LONG = "word " * 300_000


def odd(spark, rows=None):
    """Nulls everywhere, empty and long texts, repeated rows, clashing extra columns."""
    base = rows or [(1, None, None, None), (2, "", "en", "a"), (3, " \t\r\n\x0b\x0c", "en", None), (4, LONG, "en", "a"), (5, "a b", None, "b"), (5, "a b", None, "b"), (None, "x y z", "fr", "c"), (7, "\x00 \u00a0 é\ud7ff 😀", "de", "a")]
    return spark.createDataFrame([(i, t, g, s, 0, True, "s", 1, "x", 9) for i, t, g, s in base], DOCS)


def test_quality_odd_rows(spark):
    got = sorted((r.asDict() for r in quality.quality_rows(odd(spark)).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == 8 and all(r["base_failed"] and not r["kept"] for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0
    assert by[4]["n_words"] == 300_000 and by[4]["n_repeat_words"] == 300_000
    assert by[7]["n_words"] == 4 and by[7]["word_chars"] == 5
    assert quality.quality_rows(odd(spark).where("false")).collect() == []
    assert quality.quality_filter(odd(spark)).count() == 0
    assert quality.quality_filter(odd(spark).where("false")).columns == odd(spark).columns


def test_quality_estimates(spark):
    """Verdicts against the estimator in numpy, on groups of languages and sources."""
    rng = random.Random(1)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    rows = []
    for i in range(900):
        lang, source = ("en", "a") if i < 500 else ("de", None)
        text = " ".join(word(rng.randint(2, 9)) for _ in range(rng.randint(25, 120)))
        if i % 20 == 0:
            text = " | ".join(text.split()) + " $$$" * 10
        if i % 33 == 0:
            text = text.upper()
        rows.append((i, text, lang, source))
    df = odd(spark, rows)
    got = {r["doc_id"]: r for r in quality.quality_rows(df).collect()}
    gl, gs = quality._key(F.col("lang"), F.col("source"))
    stats = quality.base_stats(df)
    vec = stats.select("doc_id", gl.alias("gl"), *[v.alias(k) for k, v in quality._vector(stats.columns[-1]).items()]).toPandas()
    groups = {g: own[list(quality.DIMS)].to_numpy(float) for g, own in vec.groupby("gl")} | {"all": vec[list(quality.DIMS)].to_numpy(float)}
    est = {r["g"]: r for r in quality.mcd(vectors(spark, [(g, v) for g, x in groups.items() for v in x]))[0].collect()}
    eye, model = np.eye(5) / 1024**2, {}
    for g, x in groups.items():
        assert est[g]["logdet"] <= brute.mcd(x)[2] + 0.1  # no random start finds a much smaller determinant (rows of one bin stay together)
        c = np.array([[est[g][f"c{max(i, j)}{min(i, j)}"] for i in range(5)] for j in range(5)])
        model[g] = (np.array([est[g][f"m{i}"] for i in range(5)]), quality.CONSISTENCY * (c - eye) + eye)
    for g in vec["gl"].unique():  # each language has one source here
        own, n = vec[vec["gl"] == g], len(groups[g])
        m, s = brute.shrunk(model[g], n, brute.shrunk(model[g], n, model["all"]))
        for i, v in zip(own["doc_id"], brute.distance(groups[g], m, s), strict=True):
            assert got[i]["distance"] == pytest.approx(v, rel=1e-6, abs=1e-6)
    assert all(got[i]["kept"] == (i % 20 != 0 and i % 33 != 0) for i in got)
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if got[i]["kept"])


def vectors(spark, rows):
    """(group, vector) rows as members."""
    return spark.createDataFrame([(g, *map(int, v)) for g, v in rows], "g string, " + ", ".join(f"{d} long" for d in quality.DIMS))


def test_mcd_against_every_subset(spark):
    rng = np.random.default_rng(3)
    groups = {}
    for k in range(6):
        x = rng.normal(0, 120, (13, 5)) @ rng.normal(0, 1, (5, 5))
        x[10:] += rng.normal(0, 2500, (3, 5))
        groups[f"g{k}"] = np.round(x)
    rows = [(g, v) for g, x in groups.items() for v in x]
    rng.shuffle(rows)
    got = {r["g"]: r for r in quality.mcd(vectors(spark, rows))[0].collect()}
    for g, x in groups.items():
        m, c, det = brute.mcd_of_every_subset(x)
        assert got[g]["logdet"] == pytest.approx(det, abs=1e-6) and got[g]["n"] == 13
        assert [got[g][f"m{i}"] for i in range(5)] == pytest.approx(list(m))
        assert [got[g][f"c{i}{j}"] for i in range(5) for j in range(i + 1)] == pytest.approx([c[i, j] for i in range(5) for j in range(i + 1)])


def test_a_hidden_correlation_alone_makes_outliers(spark):
    """Two statistics that agree; the planted rows are ordinary in each of them, but not together.  A third of one source's
    rows lies far away, and one source has five rows."""
    rng = np.random.default_rng(5)
    a = rng.normal(0, 200, 900)
    x = np.column_stack([a, rng.normal(0, 150, 900), rng.normal(0, 150, 900), rng.normal(0, 150, 900), a + rng.normal(0, 15, 900)])
    x[:10, 0], x[:10, 4] = 250, -250
    x[10:110] += 4000
    gs = ["few" if i < 3 or i in (898, 899) else "many" for i in range(900)]
    rows = [(i, "=en", gs[i], False, *[int(v) for v in np.round(x[i])], *[0.0] * 5) for i in range(900)]
    df = spark.createDataFrame(rows, "i long, gl string, gs string, base_failed boolean, " + ", ".join(f"{d} long" for d in quality.DIMS) + ", " + ", ".join(f"v{i} double" for i in range(5)))
    out = {r["i"]: r["outlier"] for r in quality._judge(df, quality.fit(df)).collect()}
    assert all(out[i] for i in range(110)) and not out[898] and not out[899]
    assert sum(out[i] for i in range(110, 900)) <= 8
    same = {r["i"]: r["outlier"] for r in quality._judge(df.repartition(5), quality.fit(df.repartition(3))).collect()}
    assert same == out


def test_quality_of_few_and_long_rows(spark):
    """Every row that has words gets a distance, whatever its group's size; long texts and pools go through the filter."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda n=60: " ".join(word() for _ in range(n))
    rows = [(i, text(), f"l{i % 7}", f"s{i}") for i in range(60)] + [(60, text(300_000), "l0", "long"), (61, " | ".join(text(200).split()), "l0", "s0"), (62, text().upper(), None, None)]
    got = {r["doc_id"]: r for r in quality.quality_rows(odd(spark, rows)).collect()}
    assert all(r["distance"] is not None and not r["base_failed"] for r in got.values())
    assert [i for i, r in got.items() if not r["kept"]] == [61, 62]
    kept = quality.quality_filter(odd(spark, rows))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [i for i in range(63) if i < 61]


def test_quality_each_statistic_reaches_the_cut(spark):
    """One text with one fault for each statistic goes; short texts with single marks stay."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    line = lambda k=20: " ".join(word() for _ in range(k))
    text = lambda: "\n".join(line() for _ in range(20))
    passage, short = line(50), [line(5) for _ in range(8)]
    faults = {
        "len": "\n".join(" ".join(word() + word() for _ in range(20)) for _ in range(20)),
        "sym": text() + " # $ % & * | < > # $ % & * | < >",
        "dup": "\n".join([line() for _ in range(20)] + short * 2),
        "rep": "\n".join([line() for _ in range(15)] + [f"{passage} {line(10)} {passage}"]),
        "up": text().replace("a", "A"),
    }
    mild = [line(24) + " #", line(24).capitalize() + " |", f"{line()}\nab\nab"]
    texts = [text() for _ in range(400)] + mild + list(faults.values())
    got = {r["doc_id"]: r for r in quality.quality_rows(odd(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {k: got[403 + i]["kept"] for i, k in enumerate(faults)} == dict.fromkeys(faults, False)
    assert all(got[i]["kept"] for i in range(403))


def test_language(spark):
    got = registry.op2_language_centroids(spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = got[got["held_out"]]
    assert len(held) and (held["lang_pred"] == held["doc_id"].map(lang)).mean() > 0.95
    assert got["score"].between(0, 1).all()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    out = langid.predict(odd(spark), model)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [c for c in odd(spark).columns if c != "text"] + ["lang_pred", "_score", "rejected"]
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[1]["_score"] == 0
    assert rows[7]["lang_pred"] != "und" and langid.counts("1 2 # 😀") is None
    assert model.predict("zzzq xxqj " * 50)[2]  # far from every centroid
    empty = langid.fit(docs.where("false"))
    assert empty.predict("hello")[:2] == ("und", 0.0)


def test_language_blocks(monkeypatch):
    """Counts of a text do not depend on its blocks, and are those of a plain loop."""
    rng = random.Random(1)
    texts = ["Ærlig talt, this is a TEXT of some length. " * 40, "x", "  a  ", "", "12 3", "a1b", "😀 é 中文 𐐷𐐷"] + ["".join(rng.choice("ab é.1\n中") for _ in range(rng.randint(1, 60))) for _ in range(200)]

    def plain(text):
        x = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        x = [32 if c == " " else ord(c) for i, c in enumerate(x) if c != " " or i == 0 or x[i - 1] != " "]
        out, m = np.zeros(langid.DIMS, np.int64), 2**64
        for i in range(1, len(x)):
            two = lambda k: (x[k - 1] * 0x9E3779B97F4A7C15 + x[k] * 0xC2B2AE3D27D4EB4F) % m
            out[two(i) >> (64 - 13)] += 1
            if i > 1:
                out[(two(i - 1) * 0x165667B19E3779F9 + x[i] * 0x85EBCA77C2B2AE63) % m >> (64 - 13)] += 1
        return out if any(c.isalpha() for c in text.lower()) else None

    want = [plain(t) for t in texts]
    for block in (1 << 20, 100, 7, 1):
        monkeypatch.setattr(langid, "BLOCK", block)
        for t, w in zip(texts, want, strict=True):
            got = langid.counts(t)
            assert (got is None) == (w is None) and (w is None or (got == w).all())


def test_language_against_dense_arrays(spark):
    """Predictions by a re-computation of TF-IDF, cosines and rejection with dense arrays, from the model's own centroids."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    rows = [(r["doc_id"], langid.counts(r["text"])) for r in docs.collect()]
    ids, x = [i for i, c in rows if c is not None], np.array([c for _, c in rows if c is not None], float)
    w = np.sqrt(x) * model.idf.astype(float)
    cosines = (w / np.linalg.norm(w, axis=1, keepdims=True)) @ model.centroids.astype(float).T
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5) and len(model.owner) == len(model.centroids)
    train = np.array([c for r in docs.where("lang is not null and text is not null").collect() if (c := langid.counts(r["text"])) is not None])
    assert np.allclose(model.idf, np.log((1 + len(train)) / (1 + (train > 0).sum(axis=0))) + 0.1, atol=1e-4)
    for i, c in zip(ids, cosines, strict=True):
        assert got[i]["score"] == pytest.approx(min(1, c.max()), abs=1e-5)
        near = {model.owner[k] for k in np.flatnonzero(c > c.max() - 1e-5)}
        assert got[i]["lang_pred"] in near and got[i]["rejected"] == (got[i]["score"] < model.limit[got[i]["lang_pred"]])


def test_toxicity_held_out(spark):
    got = registry.op3_toxicity_fm(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    held = got[got["held_out"] & got["doc_id"].isin(labels.index)]
    y = held["doc_id"].map(labels)
    assert held[y == 1]["predicted"].mean() > 0.8 and held[y == 0]["predicted"].mean() < 0.02
    assert got["score"].between(0, 1).all()


def test_toxicity_learns_pairs_that_sums_miss():
    """Either word alone is clean, both together are toxic."""
    rng = random.Random(3)
    fill = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(8)]
    rows = []
    for i in range(2400):
        kind = i % 4
        own = ["grumble"] * (kind in (1, 3)) + ["marsian"] * (kind in (2, 3))
        text = " ".join(rng.sample(fill, 8) + own)
        rows.append((toxicity.terms(text), int(kind == 3)))
    m = toxicity.train(rows)
    score = lambda t: m.score(t)
    assert score("waa grumble marsian wbb") > 0.7 > 0.5 > max(score("waa grumble wbb"), score("waa marsian wbb"), score("waa wbb"))


def test_toxicity_learns_pairs_of_words_with_equal_rates():
    """Each word is in half of either class; both or neither is toxic."""
    rng = random.Random(4)
    fill = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(8)]
    rows = []
    for i in range(2400):
        own = ["grumble"] * (i % 4 in (1, 3)) + ["marsian"] * (i % 4 in (2, 3))
        rows.append((toxicity.terms(" ".join(rng.sample(fill, 8) + own)), int(i % 4 in (0, 3))))
    m = toxicity.train(rows)
    assert len(m.ids) == 6  # two words and their starts
    assert min(m.score("waa grumble marsian wbb"), m.score("waa wbb")) > 0.7 > max(m.score("waa grumble wbb"), m.score("waa marsian wbb"))


def test_toxicity_scores_against_a_plain_loop(spark):
    """Scores by the definition, pair by pair, from the model's own weights."""
    import zlib

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.trained and len(model.ids)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    place = {int(h): k for k, h in enumerate(model.ids)}

    def hashes(text):
        out = set()
        for w in __import__("re").findall(r"[^\W\d_]+", (text or "").lower()):
            forms = ["w" + w] + [f"{n}{w[:n]}" for n in (4, 5) if len(w) >= n]
            forms += ["g" + w[i : i + 4] for i in range(len(w) - 3)] if len(w) > 24 else []
            out |= {zlib.crc32(f.encode()) % toxicity.TERMS for f in forms}
        return sorted(out)

    for r in docs.collect()[:300]:
        at = [place[h] for h in hashes(r["text"]) if h in place]
        raw = model.w0 + sum(model.w[i] * model.x[i] for i in at)
        raw += sum(float(model.v[i] @ model.v[j]) * model.x[i] * model.x[j] for k, i in enumerate(at) for j in at[k + 1 :])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-np.clip(raw, -30, 30))), abs=1e-9)


def test_toxicity_terms_are_whole_words():
    long = "ab" * 50
    assert set(toxicity.terms(long + "c")) != set(toxicity.terms(long + "d"))
    glued = "these" * 6 + "badword" + "those" * 6  # a run without spaces still shows its parts
    assert {toxicity.zlib.crc32(b"g" + g) % toxicity.TERMS for g in (b"badw", b"adwo", b"word")} <= set(toxicity.terms(glued).tolist())
    block = toxicity.BLOCK
    assert set(toxicity.terms("x" * (block - 3) + " tail²end")) == set(toxicity.terms("x" * (block - 3))) | set(toxicity.terms("tail²end"))


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(2, 1), (2, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd(spark), labels)
    out = toxicity.score(odd(spark), model)
    assert not model.trained and out.columns[-1] == "_score" and {r["_score"] for r in out.collect()} == {0.0}
    assert toxicity.score(odd(spark).where("false"), model).collect() == []
    assert toxicity.fit(odd(spark).where("false"), labels).trained is False
    assert len(toxicity.terms("Ärger Ärger 12")) == 3 and toxicity.terms(None).size == 0
    # the same rows with a model that was trained
    rows = [(i, " ".join(["filler", "words"] + ["nasty"] * (i % 2)), None, None) for i in range(40)]
    trained = toxicity.fit(odd(spark, rows), spark.createDataFrame([(i, (i % 2) * 3) for i in range(40)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["_score"] for r in toxicity.score(odd(spark), trained).collect()}
    empty = trained.score(None)
    assert trained.trained and got[1] == got[2] == got[3] == got[4] == empty < 0.7 <= trained.score("NASTY words")


def test_sharding(spark):
    keys = np.array([random.Random(9).getrandbits(60) for _ in range(500)])
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump(keys, n).tolist() == [brute.jump(int(k), n) for k in keys]
    df = odd(spark)
    got = [r.asDict() for r in sharding.assign(df).collect()]
    assert len(got) == 8
    for r in got:
        assert r["shard"] == brute.shard(r["doc_id"], 8) and r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {r["doc_id"]: r["text_crc32"] for r in got}[4] == brute.crc(LONG)
    assert sharding.assign(df.where("false")).collect() == []
    names = spark.createDataFrame([("x", "a"), ("y", None)], "doc_id string, text string")
    assert {r["doc_id"] for r in sharding.assign(names).collect()} == {"x", "y"}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_sharding_ranges(spark, monkeypatch, kind):
    """Slots over many ranges: distinct ids of any type, and an id that repeats over several ranges."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    df = spark.range(2000).select(((F.col("id") * 7919) % 100_003).cast(kind).alias("doc_id"), F.lit("t").alias("text"))
    df = df.union(spark.range(500).select(F.lit(5).cast(kind).alias("doc_id"), F.lit("again").alias("text")))
    got = sharding.assign(df).toPandas().sort_values(["shard", "slot"])
    assert len(got) == 2500
    for _, g in got.groupby("shard"):
        assert g["slot"].tolist() == list(range(len(g))) and g["doc_id"].is_monotonic_increasing


def test_sharded_corpus(spark):
    df = odd(spark)
    out = sharding.sharded(df)
    assert out.columns == [*df.columns, "_size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = sorted((str(r["doc_id"]), str(r["text"])[:9], r["shard"]) for r in out.collect())
    assert got == sorted((str(r["doc_id"]), str(r["text"])[:9], brute.shard(r["doc_id"], 8)) for r in df.collect())
    for s in {r["shard"] for r in out.select("shard").collect()}:
        own = [r["slot"] for r in out.where(F.col("shard") == s).select("slot").collect()]
        assert sorted(own) == list(range(len(own)))


@pytest.mark.parametrize("edge", [10_000, 20])
def test_mix_against_brute_force(spark, monkeypatch, edge):
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge)
    monkeypatch.setattr(mixing, "MOST_RANGES", 4)  # so that an edge is cut again and again
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("s"), F.floor(F.sqrt(F.col("doc_id") % 50)).cast("string"))).alias("source"))
    want, order = brute.mix([tuple(r) for r in docs.collect()])
    got = {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert {k: (n, round(t, 6), x) for k, (n, t, x) in got.items()} == {k: (n, round(t, 6), x) for k, (n, t, x) in want.items()}
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {k: v[2] for k, v in got.items()}
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert [r["doc_id"] for r in mixed.collect()] == order  # emitted in order of finish
    assert sorted(r["doc_id"] for r in mixing.mixed_rows(docs, ordered=False).collect()) == sorted(order)
    assert brute.Counter(order) == {k: x // s for k, (s, _, x) in got.items() if x}


def test_mix_odd_rows(spark):
    got = [r.asDict() for r in mixing.mix(odd(spark)).collect()]
    assert len(got) == 8 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(odd(spark).where("false")).collect() == []
    assert all(r["taken"] == 0 for r in mixing.mix(odd(spark).where("doc_id < 4")).collect())
    out = mixing.mixed_rows(odd(spark))
    assert out.columns == odd(spark).columns
    total = sum(r["taken"] for r in got)
    assert sum(len(brute.words(r["text"])) for r in out.collect()) == total


def test_mixed_rows_cut_inside_repeated_rows(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 3)), s, n) for s in ("a", "b", None) for i in range(9 if s == "a" else 2) for n in range(13)]
    docs = spark.createDataFrame([*rows, (None, "w w", "b", 1), (None, None, "b", 2)], "doc_id long, text string, source string, copies int")
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    count = lambda rows: {(r["doc_id"], r["size"]): r["n"] for r in rows if r["n"]}
    size = F.size(F.split("text", " ")).alias("size")
    got = count(mixed.groupBy("doc_id", size).agg(F.count(F.lit(1)).alias("n")).collect())
    want = count(mixing.mix(docs).where("size > 0").groupBy("doc_id", "size").agg(F.sum(F.expr("taken div size")).alias("n")).collect())
    assert got == want
    assert mixed.groupBy(*docs.columns).count().agg(F.max("count")).first()[0] <= mixing.PASSES
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mixed_rows(docs.repartition(5)).collect()))


def test_tokens_equal_a_full_encoding():
    enc = tokencount.encoder(tokencount.read_vocabulary())
    rng = random.Random(5)
    alphabet = ["the ", "word", " ", "  ", "\n", "don't", "é", "😀", "12", " 中文", "?!", "\t", "a b ", "x" * 40]
    for size in (4, 32, 512):
        for _ in range(60):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))
            tree = tokencount.SegmentTree.of(enc, text, size)
            assert tree.total == len(enc.encode_ordinary(text)) and tree.chars[1] == len(text)
            for _ in range(4):
                start, n = rng.randint(0, len(text) + 2), rng.choice([0, 1, 5, 60])
                text2 = text[:start] + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 5)))
                add = text2[start:]
                want = text[: min(start, len(text))] + add + text[min(start, len(text)) + n :]
                text = tree.edit(text, start, n, add, size)
                assert text == want and tree.total == len(enc.encode_ordinary(text)) and sum(tree.state()[0]) == len(text)


def test_token_query(spark):
    got = {r["doc_id"]: r for r in registry.op10_edit_tokens(spark, SMALL).collect()}
    enc = tokencount.encoder(tokencount.read_vocabulary())
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        text, n = r["text"], len(r["text"])
        assert got[r["doc_id"]]["n_tokens"] == len(enc.encode_ordinary(text))
        new = text
        for k in (1, 2, 3):
            at = int(n * k / 4)
            new = new[:at] + text[:9] + new[at + 12 :]
        assert got[r["doc_id"]]["n_tokens_after"] == len(enc.encode_ordinary(new))
        assert n < 8000 or got[r["doc_id"]]["n_encoded_chars"] < n / 2


def test_token_state_and_odd_rows(spark):
    edits = F.from_json(F.lit('[{"start": 1, "removed": 1, "inserted": "new one"}, {"removed": 99}, null]'), "array<struct<start:int,removed:int,inserted:string>>")
    df = odd(spark).withColumn("e", edits)
    first = tokencount.count_edits(df.drop("e"), with_state=True)
    second = tokencount.count_edits(first.select("doc_id", F.col("new_text").alias("text"), "leaf_chars", "leaf_tokens").withColumn("e", edits), edits="e", state=("leaf_chars", "leaf_tokens"), with_state=True)
    enc = tokencount.encoder(tokencount.read_vocabulary())
    for r in second.collect():
        assert r["n_tokens_after"] == len(enc.encode_ordinary(r["new_text"])) and sum(r["leaf_chars"]) == len(r["new_text"])
    assert {r["n_tokens"] for r in first.where("doc_id in (1, 2)").collect()} == {0}
    assert tokencount.count_edits(df.where("false"), edits="e").collect() == []
