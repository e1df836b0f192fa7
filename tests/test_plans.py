"""Planner rules: intent, budgets, contracts."""

import json

import pytest
from pyspark.sql import functions as F

from strandex.functions import scalars
from strandex.plans import contracts, intent, prompt


def plan(spark, text, **how):
    return intent.plan_tasks(spark.createDataFrame([(text,)], "text string"), **how).first().asDict(recursive=True)


def test_classification(spark):
    t = plan(spark, 'fix the crash in the "billing service" twice')
    assert (t["task_type"], t["sub_type"], t["mode"], t["scope"]) == ("bugfix", "duplicate_event", "surgical", "billing service")
    assert t["confidence"] == 1.0 and t["budget"]["max_tokens"] == 6000 and t["risk_level"] == "medium"
    assert t["constraints"][0] == "minimal_diff" and len(set(t["constraints"])) == len(t["constraints"])
    t = plan(spark, None)
    assert t["task_type"] == "bugfix" and t["confidence"] == 0.1
    t = plan(spark, "whatever", task_hint="migration", mode_hint="deep", scope_hint="db", no_tests=True, preserve_api=True)
    assert (t["task_type"], t["mode"], t["scope"], t["risk_level"]) == ("migration", "deep", "db", "high")
    assert "preserve_public_api" in t["constraints"] and t["evidence"][0] == "task_type forced by CLI verb: migration"
    assert plan(spark, "docs for the api", extra=["no_guessing"])["mode"] == "minimal"


def test_needles_start_every_match():
    import re

    from strandex.plans import dimensions as d

    patterns = [p for rows in [*d.TASK_KEYWORDS.values(), *d.SUBTYPE_KEYWORDS.values(), d.MODE_KEYWORDS] for p, *_ in rows]
    words = re.findall(r"[a-z0-9]+(?: [a-z0-9]+)?", " ".join(patterns)) + ["fail", "flaky", "flake", "clean", "cleanup", "clean up", "migrations", "smallest fix", "small diff", "faster", "broad", "doc", "docs", "document", "test", "write test"]
    for p in patterns:
        n = intent.needle(p)
        assert len(n) >= 3 or n in ("", "ad", "ne"), (p, n)
        assert all(m.group().startswith(n) for w in words for m in [re.search(p, w)] if m), p


def test_greedy_skips_and_goes_on(spark):
    df = spark.createDataFrame([([50, 60, 30, 20, 1],)], "t array<int>")
    assert df.select(prompt.greedy(F.col("t"), F.lit(100))).first()[0] == [0, 2, 3]


def test_budget_leaves_late_blocks_out(spark):
    planned = intent.plan_tasks(spark.createDataFrame([("fix x",)], "text string")).withColumn("budget", F.col("budget").withField("max_tokens", F.lit(400)))
    b = prompt.compile_tasks(planned).first()
    out = [x for x in b["blocks"] if not x["included"]]
    assert out and all("budget exceeded" in x["omit_reason"] for x in out) and b["prompt_tokens"] <= 400


def test_validation(spark):
    df = spark.createDataFrame([('{"coverage_plan":1,"fixtures":2,"tests":3,"zzz":4}',), ('{"tests":1}',), ("no json",), (None,)], "o string")
    got = [r[0].asDict() for r in df.select(contracts.validate(F.lit("test_generation"), F.col("o"), True)).collect()]
    assert not got[0]["is_valid"] and got[0]["unknown_fields"] == ["zzz"] and got[0]["warnings"] and not got[0]["errors"]
    assert got[1]["missing_required"] == ["coverage_plan", "fixtures"] and got[1]["present_required"] == ["tests"]
    assert got[2]["missing_required"] == got[3]["missing_required"] == ["coverage_plan", "fixtures", "tests"]
    lenient = df.limit(1).select(contracts.validate(F.lit("test_generation"), F.col("o"))).first()[0]
    assert lenient["is_valid"]
    with pytest.raises(Exception, match="Missing required fields for DEBUGGING"):
        contracts.enforce(df.limit(2), "debugging", "o").collect()
    v = contracts.validate(F.lit("test_generation"), F.col("o"), True)
    text = df.limit(1).select(contracts.summary(F.lit("test_generation"), v)).first()[0]
    assert text.startswith("Validation: FAIL\nTask Type: TEST_GENERATION")
    done = json.loads(df.limit(1).select(contracts.serialize(F.lit("test_generation"), F.col("o"), F.lit("2024-01-01T00:00:00Z"), validation=v)).first()[0])
    assert done["schema_version"] == "1.0" and done["output"]["zzz"] == 4 and done["validation"]["unknown_fields"] == ["zzz"]


def test_schema():
    s = contracts.json_schema("debugging", strict=True)
    assert s["required"] == sorted(s["required"]) and not s["additionalProperties"] and s["title"] == "DEBUGGING Output"
    assert "- patch_if_applicable (optional)" in contracts.schema_text(s)
    assert contracts.json_schema("architecture")["title"] == "CLEANUP Output"


def test_scalars(spark):
    df = spark.createDataFrame([("a/b/__init__.py", "one\ntwo\nthree"), ("node_modules/x.js", "x"), (None, None)], "p string, t string")
    got = df.select(scalars.module_of(F.col("p")).alias("m"), scalars.is_indexable(F.col("p")).alias("i"), scalars.token_estimate(F.col("t")).alias("n"), scalars.trim_to(F.col("t"), 2).alias("c")).collect()
    assert [(r["m"], r["i"], r["n"]) for r in got] == [("a.b", True, 3), ("node_modules.x", False, 1), (None, False, 1)]
    assert got[0]["c"] == "one\ntwo" + scalars.TRIM_MARK
