"""The index end to end on a small corpus: build, link, search, graph, metrics, increments, watch, prompts."""

import datetime
import json
import random
import subprocess

import pytest

from strandex import cli
from strandex.api import CodeIndex, rows
from strandex.operators import graph
from strandex.sources import config, git

CORPUS = {
    "auth.py": "def login(user):\n    check(user)\n    return make_token(user)\n\n\ndef make_token(user):\n    return user\n\n\nclass Guard:\n    def allow(self, user):\n        return login(user)\n\n    def deny(self, user):\n        pass\n",
    "handler.py": "from auth import login as sign_in\nimport auth\n\n\ndef handle(request):\n    sign_in(request)\n    auth.make_token(request)\n    guard.allow(request)\n",
    "pkg/__init__.py": "def helper():\n    missing_thing()\n",
    "web/app.ts": "import { x } from './lib/util';\nexport function render_page(a: string): void {\n  helper(a);\n}\n",
    "vendor/skip.py": "def hidden(): pass\n",
    "notes.md": "# not code\n",
}


@pytest.fixture
def repo(tmp_path):
    for name, text in CORPUS.items():
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "src"


@pytest.fixture
def index(spark, repo, tmp_path):
    ix = CodeIndex(spark, str(tmp_path / "index"))
    ix.build(str(repo), clock=1000)
    return ix


def test_build_and_lookups(index):
    assert [r["path"] for r in rows(index.list_files())] == ["auth.py", "handler.py", "pkg/__init__.py", "web/app.ts"]
    s = {r["name"]: r for r in rows(index._t("symbols"))}
    assert s["allow"]["fqid"] == "auth.Guard.allow" and s["helper"]["module"] == "pkg" and s["render_page"]["language"] == "typescript"
    assert s["allow"]["owner_symbol_id"] == s["Guard"]["id"]
    assert len(s["login"]["hash"]) == 16
    assert [r["name"] for r in rows(index.get_owned_symbols("Guard"))] == ["allow", "deny"]
    assert [r["name"] for r in rows(index.get_callers("login"))] == ["allow"]
    assert [r["to_name"] for r in rows(index.get_imports("handler.py"))] == ["auth", "auth"]
    assert rows(index.get_symbol_by_fqid("auth.login"))[0]["name"] == "login"
    assert [(r["alias"], r["resolved_fqid"]) for r in rows(index.get_aliases("handler.py"))] == [("auth", "auth"), ("sign_in", "auth.login")]
    assert index.get_stats()["by_kind"]["method"] == 2


def test_resolution_cascade_is_idempotent(index):
    first = index.resolve()
    assert index.resolve() == first
    got = {(r["to_name"], r["call_expression"]): r["confidence"] for r in rows(index._t("relations")) if r["relation"] == "CALLS"}
    assert got[("make_token", "auth.make_token")] == 0.9
    assert got[("sign_in", "sign_in")] == 0.8
    assert got[("make_token", "make_token")] == 0.7
    assert got[("missing_thing", "missing_thing")] == 0.0
    hot = rows(index.hotspots())
    assert hot[0]["name"] in ("login", "make_token") and hot[0]["fan_in"] == 2
    assert {r["name"] for r in rows(index.dead_code())} >= {"handle", "deny", "render_page"}
    assert rows(index.coupling())[0] == {"from_module": "handler", "to_module": "auth", "call_count": 3}
    assert index.health()["total_symbols"] == 8


def test_search_and_graph(index):
    hits = rows(index.search_symbols("make token"))
    assert [h["name"] for h in hits] == ["make_token"] and hits[0]["rank_position"] == 1
    assert [f["name"] for f in hits[0]["factors"]][:2] == ["text_relevance", "call_frequency"]
    assert rows(index.search_symbols("  ")) == [] and rows(index.search_symbols('"')) == []
    assert {h["name"] for h in rows(index.search_symbols("log"))} == {"login"}
    assert {r["name"]: r["depth"] for r in rows(index.get_callgraph("allow"))} == {"login": 1, "check": 2, "make_token": 2}
    assert {r["name"] for r in rows(index.get_impact("make_token"))} == {"login", "handle", "allow"}
    assert rows(index.get_callgraph("nobody")) == [] and rows(index.get_callgraph("allow", 0)) == []
    context = rows(index.get_context("login"))[0]
    assert context["calls"] == ["check", "make_token"] and context["called_by"] == ["allow"] and context["impact"] == ["allow", "handle"]


def test_incremental_equals_full(spark, index, repo, tmp_path):
    (repo / "auth.py").write_text("def login(user):\n    return 1\n")
    (repo / "handler.py").unlink()
    stats = index.build(str(repo), clock=2000)
    assert (stats["indexed"], stats["skipped"], stats["removed"]) == (1, 2, 1)
    full = CodeIndex(spark, str(tmp_path / "full"))
    full.build(str(repo), clock=2000)
    for t in ("files", "symbols", "relations", "import_aliases"):
        assert sorted(map(str, rows(index._t(t)))) == sorted(map(str, rows(full._t(t)))), t


def test_a_change_writes_its_buckets_alone(spark, index, repo, tmp_path):
    store = index.store
    held = lambda name: store._manifest(store.version())["tables"][name]
    index.resolve()
    first = {n: held(n) for n in ("symbols", "relations", "import_aliases", "modules")}
    for k in range(4):
        (repo / "web" / "app.ts").write_text(f"export function render_page(a: string): void {{\n  helper(a, {k});\n}}\n")
        index.build(str(repo), clock=2000 + k)
    own = {str(b) for b in store._buckets("files", store.table("files").where("path = 'web/app.ts'"))}
    for name, before in first.items():
        assert {b for b, v in held(name).items() if before.get(b) != v} <= own, name
    assert set(held("symbols").values()) == {1, store.version()} and not (tmp_path / "index" / "v3").exists()
    full = CodeIndex(spark, str(tmp_path / "full"))
    full.build(str(repo), clock=2003)
    index.resolve(), full.resolve()
    for t in ("files", "symbols", "relations", "import_aliases", "modules"):
        assert sorted(map(str, rows(index._t(t)))) == sorted(map(str, rows(full._t(t)))), t
    # a changed target is unlinked in the buckets of its callers
    (repo / "pkg" / "__init__.py").write_text("x = 1\n\n\ndef helper():\n    pass\n")
    index.build(str(repo), clock=3000)
    calls = [r for r in rows(index._t("relations")) if r["to_name"] == "helper"]
    assert calls and all(r["to_symbol_id"] is None and r["confidence"] is None for r in calls)


def test_watch(spark, index, repo, tmp_path):
    (repo / "new.py").write_text("def fresh():\n    pass\n")
    (repo / "moved.py").write_text(CORPUS["handler.py"])
    (repo / "handler.py").unlink()
    inbox = tmp_path / "events"
    inbox.mkdir()
    t = datetime.datetime(2024, 1, 1)
    event = lambda k, p, s, dest=None: json.dumps({"kind": k, "path": p, "dest": dest, "ts": (t + datetime.timedelta(milliseconds=s)).isoformat()})
    (inbox / "a.json").write_text("\n".join([event("CREATED", "new.py", 0), event("MODIFIED", "new.py", 100), event("MODIFIED", "new.py", 200), event("MOVED", "handler.py", 0, "moved.py"), event("CREATED", "x.txt", 5), event("DELETED", "pkg/__init__.py", 9), event("CREATED", "late.py", 60_000)]))
    stream = spark.readStream.schema("kind string, path string, dest string, ts timestamp").json(str(inbox))
    seen = []
    q = index.watch(str(repo), stream, str(tmp_path / "ck"), seen.append, once=True)
    q.awaitTermination(120)
    assert [r["path"] for r in rows(index.list_files())] == ["auth.py", "moved.py", "new.py", "web/app.ts"]
    assert seen and seen[0]["indexed"] == 2 and seen[0]["removed"] == 2


def test_prompts(index, repo):
    got = index.compile("Fix the duplicate token bug in login", str(repo))
    assert got["task"]["task_type"] == "bugfix" and got["task"]["sub_type"] == "duplicate_event"
    assert "Symbols (" in got["prompt"] and "OUTPUT FORMAT" in got["prompt"]
    assert [m["role"] for m in got["messages"]] == ["system", "user"]
    lean = index.compile("quick look at login", task_hint="bugfix", mode_hint="minimal", with_context=False)
    assert "VERIFICATION" not in lean["prompt"] and "compact" in lean["prompt"]
    assert index.compile("Fix the duplicate token bug in login", str(repo))["prompt"] == got["prompt"]


def test_cyclic_components_of_any_length(spark):
    ring = [(f"m{i}", f"m{(i + 1) % 7}") for i in range(7)]
    g = spark.createDataFrame([*ring, ("a", "b"), ("b", "a"), ("b", "m0"), ("m3", "x"), ("y", "y")], "src string, dst string")
    assert sorted(r["component"] for r in rows(graph.cyclic_components(g))) == [["a", "b"], [f"m{i}" for i in range(7)]]


def test_cycles_have_no_bound(spark):
    ring = [(f"m{i:02}", f"m{(i + 1) % 12:02}") for i in range(12)] + [("m00", "m06"), ("x", "m00"), ("m03", "y")]
    got = [r["cycle"] for r in rows(graph.simple_cycles(spark.createDataFrame(ring, "src string, dst string")))]
    assert sorted(map(len, got)) == [7, 12] and len(got[0]) == 12
    assert rows(graph.simple_cycles(spark.createDataFrame([("a", "b")], "src string, dst string"))) == []


def test_cycles_by_search_and_by_joins(spark, monkeypatch):
    rng = random.Random(6)
    g = spark.createDataFrame([(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(26)], "src string, dst string").cache()
    for longest in (None, 4):
        monkeypatch.setattr(graph, "SEARCHED_EDGES", 100)
        searched = [r["cycle"] for r in rows(graph.simple_cycles(g, longest))]
        monkeypatch.setattr(graph, "SEARCHED_EDGES", 0)
        assert searched and searched == [r["cycle"] for r in rows(graph.simple_cycles(g, longest))]


def test_unread_files_keep_their_rows(spark, index, repo, monkeypatch):
    from strandex.sources import files

    real = files.scan
    monkeypatch.setattr(files, "scan", lambda s, root: real(s, root).where("path <> 'auth.py'"))  # one file cannot be read
    stats = index.build(str(repo), clock=2000)
    assert (stats["errors"], stats["removed"], stats["skipped"]) == (1, 0, 3)
    assert {r["path"]: r["last_indexed_at"] for r in rows(index._t("files"))}["auth.py"] == 1000
    assert [r["name"] for r in rows(index.get_owned_symbols("Guard"))] == ["allow", "deny"]


def test_hidden_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    from strandex.sources import files

    monkeypatch.setattr(files, "PIECE_BYTES", 10)
    for k in range(5):
        (tmp_path / f"_m{k}.py").write_text(f"x = {k}\ndef f{k}(): pass\n")
    (tmp_path / "plain.py").write_text("y = 1\n")
    assert sorted(r["path"] for r in files.scan(spark, str(tmp_path)).collect()) == [*[f"_m{k}.py" for k in range(5)], "plain.py"]
    some = files.scan_paths(spark, str(tmp_path), ["_m1.py", "plain.py", "gone.py", "notes.md"])
    assert {r["path"]: r["language"] for r in some.collect()} == {"_m1.py": "python", "plain.py": "python"}


def test_status_goes_by_presence(spark):
    from strandex.streaming import incremental

    side = lambda xs: spark.createDataFrame(xs, "path string, content_hash string")
    got = incremental.status(side([("a", None), ("b", "1"), ("c", "1"), ("d", None)]), side([("a", None), ("b", "1"), ("c", "2"), ("e", None)]))
    assert {r["path"]: r["status"] for r in got.collect()} == {"a": "changed", "b": "same", "c": "changed", "d": "new", "e": "orphan"}


def test_cycles(spark):
    g = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "a")], "src string, dst string")
    assert [r["cycle"] for r in rows(graph.simple_cycles(g, 5))] == [["a", "b", "c"], ["a", "b"]]


def test_git_and_config(spark, tmp_path):
    assert git.branch(tmp_path) == "" and git.recent_files(spark, tmp_path) == [] and git.diff_section(spark, tmp_path, ["a"]) == ""
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-b", "topic/x")
    for k in range(4):
        (tmp_path / f"m{k}.py").write_text(f"def first_{k}(x):\n    return x\n\n\nclass Second{k}:\n    async def third(self):\n        pass\n")
        (tmp_path / "all.py").write_text("\n".join(f"x{i} = {k}" for i in range(k + 1)) + "\n")
        run("add", "-A")
        run("commit", "-m", f"change {k}")
    assert git.branch(tmp_path) == "topic/x" and git.root_of(tmp_path / "m1.py") is None and git.root_of(tmp_path) == tmp_path.resolve()
    assert git.recent_files(spark, tmp_path, 2) == ["all.py", "m3.py", "m2.py"]
    assert git.changed_symbols(spark, tmp_path) == ["first_1", "Second1", "third", "first_2", "Second2", "first_3", "Second3"]
    said = git.diff_section(spark, tmp_path, ["M2", "nothing"])
    assert said.startswith("Changed files:\n   m2.py") and "m1.py" not in said and "change 3" in said
    assert "m1.py" in git.diff_section(spark, tmp_path, ["nothing"])
    run("checkout", "--detach")
    assert len(git.branch(tmp_path)) == 12
    diff = "@@ -1 +1 @@ def a(x)\n+class B:\n+    async def c(self):\n-def d():\n@@ -2 +2 @@ def a(x)\n+define(x)\n+++ b/def.py\n"
    assert [r["name"] for r in git.changed_names(git.lines(spark, diff)).collect()] == ["a", "B", "c"]
    (tmp_path / ".strandex.toml").write_text('default_mode = "nonsense"\nmax_tokens = 5\nalways_on_constraints = ["no_guessing", "?"]\n[task_mode_overrides]\nbugfix = "deep"\n')
    s = config.load(tmp_path, tmp_path / "none.toml")
    assert s.default_mode is None and s.max_tokens == 5 and s.constraints() == (["no_guessing"], []) and s.mode_for("bugfix") == "deep"


def test_settings_act(spark, index):
    task = lambda s=None, **how: index.plan("fix the login bug", s, **how).first().asDict(recursive=True)
    plain = task()
    assert plain["budget"]["max_tokens"] == 6000 and plain["budget"]["retrieval_depth"] == 2 and "require_tests" in plain["constraints"]
    s = config.Settings(max_tokens=1234, context_depth=3, require_tests=False, no_guessing=True, follow_existing_patterns=False)
    got = task(s, mode_hint="deep")
    assert (got["budget"]["max_tokens"], got["budget"]["retrieval_depth"]) == (1234, 3)
    assert "no_guessing" in got["constraints"] and not {"require_tests", "follow_existing_patterns"} & set(got["constraints"])
    assert task(s, preset="bugfix/deep")["budget"]["retrieval_depth"] == 4 and task(profile="fast")["budget"]["max_tokens"] == 4000
    strict = task(config.Settings(default_profile="strict"))
    assert strict["mode"] == "strict" and strict["budget"]["retrieval_depth"] == 3
    assert task(config.Settings(default_profile="strict"), profile="fast")["mode"] == "fast"


def test_cli(index, repo, tmp_path, spark, capsys):
    assert cli.main(["--index", str(tmp_path / "index"), "--json", "search", "login"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["name"] == "login"
    cli.main(["show", "task", "fix"])
    assert json.loads(capsys.readouterr().out)["mode"] == "surgical"
    cli.main(["--index", str(tmp_path / "index"), "fix", "login is broken", "--root", str(repo), "--no-context"], spark)
    assert "TASK: BUGFIX" in capsys.readouterr().out


def test_tools(index):
    import io

    from strandex import tools

    ask = ['{"id": 1, "tool": "get_symbol", "args": {"name": "login"}}', '{"id": 2, "tool": "nope"}', "", '{"id": 3, "tool": "list_tools"}', '{"id": 4, "tool": "get_stats"}']
    out = io.StringIO()
    tools.serve(index, io.StringIO("\n".join(ask)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert got[0]["result"][0]["file_path"] == "auth.py" and "KeyError" in got[1]["error"] and len(got[2]["result"]) == 12 and got[3]["result"]["files"] == 4
