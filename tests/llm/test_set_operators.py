"""Near-dedup, decontamination, URL rules, WARC and the pipeline: brute force and odd inputs."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandex.llm import decontam, mixing, neardup, quality, registry, sharding, urlrules, warc
from strandex.llm.components import components
from test_row_operators import LONG, odd

SMALL = "/root/testdata/sf0.001"


def family(rng, n_bases=12, size=9, length=60):
    """Bases, and copies with more and more words changed, so that chains and near misses occur."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    texts = []
    for _ in range(n_bases):
        base = [word() for _ in range(rng.choice([1, 3, 6, length]))]
        texts.append(" ".join(base))
        for k in range(size):
            w = list(base)
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = word()
            texts.append((" " if k % 2 else "\n").join(w).upper() if k % 3 == 0 else " ".join(w))
            if k % 4 == 0:
                base = w  # drift
    return texts


def as_rows(got):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got)


def expected(docs):
    return sorted((str(i), len(brute.shingles(t)), str(c), c == i) for (i, t), c in zip(docs, brute.components(docs), strict=True))


@pytest.mark.parametrize("dense", [2048, 4])
def test_near_duplicates_against_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(neardup, "DENSE", dense)
    rng = random.Random(11)
    docs = [(i, t) for i, t in enumerate(family(rng))]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert as_rows(neardup.near_duplicates(df).collect()) == expected(docs)


@pytest.mark.parametrize("few", [200_000, 0])
def test_near_duplicates_of_repeated_ids(spark, monkeypatch, few):
    """Ids with several texts, equal texts under several ids, null ids, repeated rows; by broadcast and by shuffled texts."""
    monkeypatch.setattr(neardup, "BROADCAST_NODES", few)
    rng = random.Random(5)
    texts = family(rng, 5, 6) + ["", " "]
    docs = [(rng.choice([*range(25), None]), t) for t in texts + rng.sample(texts, 12)]
    docs += docs[:6] + [(100, texts[0] + " more"), (100, "unlike every other text"), (100, "unlike every other text")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert as_rows(neardup.near_duplicates(df).collect()) == expected(docs)
    # one row of each group stays, with the group's smallest id; rows without words all stay
    kept = [(r["doc_id"], r["text"]) for r in neardup.keep_one(df).collect()]
    assert len([t for _, t in kept if not brute.shingles(t)]) == sum(not brute.shingles(t) for _, t in docs)
    with_words = [(i, t) for i, t in kept if brute.shingles(t)]
    roots = linked_groups(docs)
    assert len(with_words) == len(roots)
    for rows in roots:  # exactly one of each, and that with the smallest id
        own = [x for x in with_words if x in rows]
        low = min((i for i, _ in rows if i is not None), default=None)
        assert len(own) == 1 and own[0][0] == low
    assert (100, "unlike every other text") in kept


def linked_groups(docs):
    """Rows with words as their groups, all pairs compared."""
    out = []
    for i, t in docs:
        s = brute.shingles(t)
        near = [g for g in out if s and any(100 * len(s & u) >= 75 * len(s | u) for u in (brute.shingles(x) for _, x in g))]
        if s:
            out = [g for g in out if g not in near] + [[(i, t)] + [x for g in near for x in g]]
    return out


def test_strangers_alone_meet_tiles(spark):
    """A region of 100,000 near copies and ten strangers moves rows in proportion to its size, and no pair is left out."""
    n, odd_ones = 100_000, 10
    rows = spark.range(n + odd_ones).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"), F.lit(50).cast("long").alias("n"), F.when(F.col("id") < n, 0).otherwise(F.col("id")).cast("long").alias("comp"), F.lit(b"x" * neardup.VALUES).alias("rot"), F.lit(n + odd_ones).cast("long").alias("all"), F.lit(n).cast("long").alias("big_rows"), F.lit(0).cast("long").alias("big"))
    tiles = neardup._tiles(rows).groupBy("part").agg(F.collect_set(F.when(F.col("comp") > 0, F.col("node"))).alias("odd"), F.count_if(F.col("comp") == 0).alias("big"), F.count(F.lit(1)).alias("rows"), F.max("side").alias("side")).collect()
    assert sum(r["rows"] for r in tiles) <= 1.1 * n and max(r["rows"] for r in tiles) <= 2 * neardup.DENSE
    assert sum(r["big"] for r in tiles) == n and all(len(r["odd"]) == odd_ones for r in tiles)


def test_near_duplicates_in_one_large_region(spark, monkeypatch):
    """Near copies of one text in regions far above the tile size, over many ranges, with strangers that link and some that do not."""
    monkeypatch.setattr(neardup, "DENSE", 16)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(80)]

    def copy(k):
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = word()
        return " ".join(w)

    docs = [(i, copy(rng.choice([0, 1, 1, 2, 3, 4, 5]))) for i in range(300)] + [(300 + i, word()) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert as_rows(neardup.near_duplicates(df).collect()) == expected(docs)


def test_near_duplicates_odd_rows(spark):
    got = neardup.near_duplicates(odd(spark)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 7)] == [1, 2, 3, 4, 5, 7] and by[5]["n_shingles"] == 1
    assert by[4]["n_shingles"] == 1 and by[None]["component_id"] is None
    assert neardup.near_duplicates(odd(spark).where("false")).collect() == []
    kept = neardup.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 7  # of the repeated row, one
    assert neardup.keep_one(odd(spark).where("false")).count() == 0


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (10, 11), (11, 12), (12, 10), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def planted(rng):
    """(documents, items): quotes whole, in part, with every fourth or fifth word changed, too short, and of short items."""
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)] + [(8, None), (9, "short one"), (10, ""), (11, " ".join(word() for _ in range(9))), (None, "an item of eight words without any id"), (13, "二〇一九年世界大会在哪里举行")]
    docs, filler = [], lambda n: " ".join(word() for _ in range(n))
    for i in range(8):
        w = items[i][1].split()
        for k, quote in enumerate((w, w[5:22], [x if j % 4 else word() for j, x in enumerate(w)], [x if j % 5 else word() for j, x in enumerate(w)], w[:7], [])):
            docs.append((10 * i + k, f"{filler(40)}. {', '.join(quote).title()}! {filler(25)}"))
    short = [items[9][1], "short", items[11][1], " ".join(items[11][1].split()[:8]), items[12][1], "他问二〇一九年世界大会在哪里举行呢"]
    docs += [(90 + k, f"{filler(9)} {x}, {filler(9)}") for k, x in enumerate(short)]
    w = items[0][1].split()  # two stretches of one diagonal: the better-scoring one is too short
    docs.append((99, " ".join([*w[:9], *"vwxyz", *w[14:18], "v", *w[19:25], "w"])))
    return docs, items


def test_decontamination_against_brute_force(spark):
    docs, items = planted(random.Random(2))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i): n for d, t in docs for i, u in items if (n := brute.overlap(brute.tokens(t), brute.tokens(u)))}
    got = decontam.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_matched"] for r in got} == want
    assert {(10 * i + k, i) for i in range(8) for k in range(4)} | {(90, 9), (92, 11), (94, None), (95, 13), (99, 0)} == set(want)
    joined = decontam.contaminated(df, bench, broadcast_chars=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))
    clean = {d for d, _ in docs} - {d for d, _ in want}
    for limit in (decontam.BROADCAST_CHARS, 0):
        assert {r["doc_id"] for r in decontam.remove_contaminated(df, bench, broadcast_chars=limit).collect()} == clean


def test_decontamination_odd_rows(spark):
    docs, items = planted(random.Random(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, None, None, None), (2, "", None, None), (3, LONG, None, None), (4, docs[0][1], None, None), (4, docs[0][1], None, None), (None, docs[6][1], None, None)]
    bench = bench.union(bench.where("item_id = 0")).union(spark.createDataFrame([(0, items[1][1])], bench.schema))  # repeated rows and ids
    for limit in (decontam.BROADCAST_CHARS, 0):
        got = decontam.contaminated(odd(spark, rows), bench, broadcast_chars=limit).collect()
        assert sorted(((r["doc_id"] or -1), r["item_id"]) for r in got) == [(-1, 0), (-1, 1), (4, 0)]
    kept = decontam.remove_contaminated(odd(spark, rows), bench)
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    none = bench.where("false")
    assert decontam.contaminated(odd(spark, rows), none).collect() == [] and decontam.remove_contaminated(odd(spark, rows), none).count() == 6
    assert decontam.contaminated(odd(spark, rows).where("false"), bench).collect() == []


@pytest.mark.parametrize("points", [64, 2])
def test_url_rules_against_brute_force(spark, monkeypatch, points):
    monkeypatch.setattr(urlrules, "RANGE_POINTS", points)
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "ab", "com", "net", "x-y", "A", "é"])
    host = lambda k: ".".join(label() for _ in range(rng.randint(1, k)))
    path = lambda: rng.choice(["", "/", "/en/", "/en/x", "/de", "/en/x/y"])
    rules = [(rng.choice(["allow", "block"]), host(3).lower(), path()) for _ in range(40)]
    urls = [rng.choice(["http://", "https://", "", "x://"]) + host(5) + path() + rng.choice(["", "?q=1", "#f", "/z"]) for _ in range(700)] + [None, "", "://", "no scheme", "http:///p", "a://b://c/d", "http://h\nx/p\nq"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    out = urlrules.judge(df, urlrules.rules_table(spark, rules))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {i: brute.verdict(rules, u) for i, u in enumerate(urls)}


def test_url_rules_of_one_hot_host(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "RANGE_POINTS", 4)
    rng = random.Random(8)
    path = lambda: "/" + "".join(rng.choice("ab/é") for _ in range(rng.randint(0, 9)))
    rules = [(rng.choice(["allow", "block"]), rng.choice(["hot.com", "hot.com", "com", "b.hot.com"]), path()) for _ in range(400)]
    rules += [("block", "hot.com", "/" + "a" * k) for k in range(60)]  # deeply nested
    urls = ["http://" + rng.choice(["hot.com", "a.hot.com", "x.b.hot.com", "hot.com.net"]) + rng.choice([path(), "/" + "a" * rng.randint(0, 70)]) for _ in range(900)]
    urls += urls[:50]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(df, urlrules.rules_table(spark, rules)).collect()}
    assert got == {i: brute.verdict(rules, u) for i, u in enumerate(urls)}


def test_url_rules_odd(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "h", "p")], "page_id long, url string, Host string, rule string")
    rules = spark.createDataFrame([("block", None, "/"), ("block", "", "/"), (None, "net", None)], "action string, host string, path string")
    out = urlrules.judge(df, rules)
    r = out.first()
    assert out.columns == ["page_id", "Host", "rule", "_host", "path", "_rule", "verdict"] and (r["_rule"], r["verdict"]) == ("net", "allow")
    assert urlrules.judge(df.where("false"), rules).collect() == []
    assert urlrules.judge(df, rules.where("false")).first()["verdict"] == "allow"


PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/\r\nx%", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "v", "é" * 1000), (5, "v", "é" * 1000), (None, "w", "<p>one</p>"), (8, "big", "".join(chr(97 + i * i % 26) for i in range(200_000)))]


def pages(spark):
    return spark.createDataFrame([(*p, True, 1) for p in PAGES], "page_id long, url string, html string, kind boolean, sha int")


@pytest.mark.parametrize("few", [True, False])
def test_warc_round_trip(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(warc, "BROADCAST_REVISITS", 0)
    path = warc.write_warc(pages(spark), str(tmp_path / "w"), file_bytes=1000)
    rows = warc.read_warc(spark, path).collect()
    assert {r["kind"] for r in rows} == {"record"} and len(rows) == len(PAGES)
    by = {r["page_id"]: r for r in rows}
    for i, url, html in PAGES:
        body = (html or "").encode()
        assert by[i]["payload_bytes"] == len(body) and by[i]["payload_digest"] == warc.digest(body) and by[i]["url"] == (url or "")
        assert by[i]["record_type"] == "revisit" or by[i]["payload"] == body
    kinds = {i: (by[i]["record_type"], by[i]["refers_to"]) for i in by}
    assert kinds == {1: ("response", None), 2: ("revisit", 1), None: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), 8: ("response", None)}
    assert warc.read_warc(spark, warc.write_warc(pages(spark).where("false"), str(tmp_path / "e"))).collect() == []


def test_warc_files_are_bounded(spark, tmp_path):
    rng = random.Random(2)
    bodies = ["".join(chr(rng.randrange(33, 127)) for _ in range(n)) for n in [10] * 300 + [20_000] * 60]  # long ones last
    df = spark.createDataFrame([(i, "u", b) for i, b in enumerate(bodies)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"), file_bytes=80_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert max(sizes) <= 80_000 + warc.PIECES * 21_000 and len(sizes) > 4
    assert sorted((r["page_id"], r["payload"].decode()) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()) == list(enumerate(bodies))


def test_warc_salvage():
    records = [warc.record(i, f"http://h/{i}", f"<p>{i}</p>".encode() * (50 + i), None, False) for i in range(6)]
    gz = [warc.member(r) for r in records]
    ids = lambda data: [int(f["X-Page-ID"]) for k, _, _, f, _, _ in warc.salvage(data) if k == "record"]
    gaps = lambda data: [(at, n) for k, at, n, _, _, _ in warc.salvage(data) if k == "gap"]
    for parts in (gz, records):
        whole, at = b"".join(parts), np.cumsum([0, *map(len, parts)])
        assert ids(whole) == list(range(6)) and gaps(whole) == []
        bad = bytearray(whole)
        bad[at[2] + len(parts[2]) // 2] ^= 0xFF  # a flipped byte
        assert ids(bytes(bad)) == [0, 1, 3, 4, 5] and gaps(bytes(bad)) == [(at[2], len(parts[2]))]
        cut = whole[: at[1] + 30] + whole[at[2] :]  # a torn record
        assert ids(cut) == [0, 2, 3, 4, 5] and gaps(cut) == [(at[1], 30)]
        junk = whole[: at[3]] + b"junk \x1f\x8b\x08 WARC/1." + whole[at[3] :]
        assert ids(junk) == list(range(6)) and len(gaps(junk)) == 1
        assert ids(whole[:-5]) == list(range(5)) and gaps(whole[:-5])[0][0] == at[5]
    mixed = gz[0] + records[1] + gz[2]
    assert ids(mixed) == [0, 1, 2] and gaps(b"") == []
    big = warc.member(b"x" * (1 << 24))
    assert big[-1] == 0 and gz[0][-1] == 0


def test_warc_members_of_several_records():
    import gzip

    records = [warc.record(i, f"http://h/{i}", f"<p>{i}</p>".encode() * 9, None, False) for i in range(5)]
    one = gzip.compress(b"".join(records[:2]) + b"junk" + records[2]) + gzip.compress(records[3]) + gzip.compress(b"") + records[4]
    got = list(warc.salvage(one))
    assert [int(f["X-Page-ID"]) for k, _, _, f, _, _ in got if k == "record"] == list(range(5))
    gaps = [(at, why) for k, at, _, _, _, why in got if k == "gap"]
    assert [at for at, _ in gaps] == [0] and gaps[0][1].startswith("bytes ")
    assert [k for k, *_ in warc.salvage(gzip.compress(b"nothing") + records[0])] == ["gap", "record"]


def test_warc_damage_is_read_in_linear_time(monkeypatch):
    import time

    monkeypatch.setattr(warc, "MOST_INFLATED", 1 << 16)
    good = warc.record(1, "u", b"x", None, False)
    bomb = warc.member(b"x" * (1 << 20))
    assert [k for k, *_ in warc.salvage(bomb + good)] == ["gap", "record"]
    t = time.time()
    for junk in (b"WARC/1.0\r\nno header\r\n", b"WARC/1.", b"\x1f\x8b\x08 "):
        assert [k for k, *_ in warc.salvage(junk * 100_000 + good)] == ["gap", "record"]
    assert time.time() - t < 20


def test_warc_long_urls(spark, tmp_path):
    rows = [(1, "data:," + "%z" * 60_000, "<p>a</p>"), (2, "http://h/?" + "q" * 300_000, "<p>a</p>"), (3, "http://h/3", "<p>b</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x["page_id"]: x for x in warc.read_warc(spark, warc.write_warc(df, str(tmp_path / "w"))).collect()}
    assert {i: x["url"] for i, x in got.items()} == {i: u for i, u, _ in rows} and got[2]["refers_to"] == 1
    plain = [warc.record(i, u, h.encode(), None, False) for i, u, h in rows]
    assert [k for k, *_ in warc.salvage(b"".join(plain))] == ["record"] * 3


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    verdicts = {r["doc_id"]: r["kept"] for r in quality.quality_rows(docs).collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if verdicts[r["doc_id"]]}
    docs_ = sorted((i, r["text"]) for i, r in rows.items())
    rows = {i: rows[i] for (i, _), c in zip(docs_, brute.components(docs_), strict=True) if c == i}
    bench = [brute.tokens(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = {tuple(b[i : i + 6]) for b in bench for i in range(len(b) - 5)}
    seeds = {i for i, r in rows.items() for w in [brute.tokens(r["text"])] if any(tuple(w[k : k + 6]) in grams for k in range(len(w)))}
    leaked = {i for i in seeds if any(brute.overlap(brute.tokens(rows[i]["text"]), b) for b in bench)}
    rows = {i: r for i, r in rows.items() if i not in leaked}
    taken, _ = brute.mix([(i, r["text"], r["source"]) for i, r in rows.items()])
    want = sorted((i, brute.shard(i, 8)) for i, (n, _, x) in taken.items() if x for _ in range(x // n))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["shard"]) for r in got) == want and leaked
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_stages_keep_columns_and_bear_odd_rows(spark):
    docs = odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SMALL).columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SMALL).count() == frame.count()


def test_registry():
    names = registry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert mixing and sharding and F
