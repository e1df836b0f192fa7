"""Extractors on small sources of our own."""

from strandex.sources.extract import extract


def names(x):
    return {s[0]: s[1] for s in x.symbols}


def pairs(x, relation):
    return [(r[0], r[3]) for r in x.relations if r[2] == relation]


def calls(x):
    return [(r[0], r[3], r[4]) for r in x.relations if r[2] == "CALLS"]


def test_python():
    x = extract("python", "import os.path as osp, json\nfrom a.b import c as d, e\nfrom z import *\n\n@deco\nclass Store(Base, mod.Other):\n    def put(self, k=f()):\n        self.log(k)\n        osp.join(k)\n        helper(k)\n\nif True:\n    async def run():\n        def inner():\n            deep()\n        go().on()\n")
    assert names(x) == {"Store": "class", "put": "method", "run": "function"}
    assert pairs(x, "DEFINES") == [("put", "Store")]
    assert pairs(x, "INHERITS") == [("Store", "Base")]
    assert pairs(x, "IMPORTS") == [("<module>", "os.path"), ("<module>", "json"), ("<module>", "a.b"), ("<module>", "z")]
    assert x.aliases == [("osp", "os.path", ""), ("json", "json", ""), ("d", "a.b", "c"), ("e", "a.b", "e"), ("*", "z", "*")]
    assert set(calls(x)) == {("put", "log", "self.log"), ("put", "join", "osp.join"), ("put", "helper", "helper"), ("run", "deep", "deep"), ("run", "on", "on"), ("run", "go", "go")}
    assert [s[2:4] for s in x.symbols] == [(6, 10), (7, 10), (13, 16)]


def test_python_edge_cases():
    assert extract("python", "").symbols == []
    assert extract("python", "def broken(:\n").error.startswith("SyntaxError")
    assert extract("cobol", "x").symbols == []


def test_python_keeps_what_parses():
    x = extract("python", "import a\n\ndef good():\n    call()\n\ndef bad(:\n    pass\n\nclass Box:\n    def put(self):\n        x = = 1\n        self.log()\n\n    def get(self):\n        pass\n\n)(\nlast = fine()\n")
    assert x.error.startswith("SyntaxError") and names(x) == {"good": "function", "Box": "class", "put": "method", "get": "method"}
    assert calls(x) == [("good", "call", "call"), ("put", "log", "self.log")] and pairs(x, "IMPORTS") == [("<module>", "a")]
    assert {s[0]: s[2:4] for s in x.symbols}["get"] == (14, 15)


def test_long_files_take_linear_time():
    import time

    t = time.time()
    assert len(extract("go", "func f() { g(1); if a { h() } }\n" * 20_000).symbols) == 20_000
    assert len(extract("javascript", "function f(a) { return new X(g(a)); }\n" * 20_000).symbols) == 20_000
    assert time.time() - t < 20


def test_go():
    x = extract("go", 'package main\n\nimport "fmt"\nimport (\n    g "github.com/x/gin"\n    "os"\n)\n\ntype User struct {\n    name string // func no()\n}\n\ntype (\n    A struct{}\n    B int\n)\n\nfunc (s *User) Name() (string, error) {\n    s.load("}")\n    return fmt.Sprint(s.a.b()), nil\n}\n\nfunc main() {\n    if ok() { helper() }\n}\n')
    assert names(x) == {"User": "class", "A": "class", "B": "class", "Name": "method", "main": "function"}
    assert [t for _, t in pairs(x, "IMPORTS")] == ["fmt", "github.com/x/gin", "os"]
    assert ("g", "github.com/x/gin", "") in x.aliases
    got = {s[0]: s for s in x.symbols}
    assert got["Name"][2:] == (18, 21, "User") and got["main"][2:4] == (23, 25) and got["User"][2:4] == (9, 11)
    assert {c[1:] for c in calls(x)} == {("load", "s.load"), ("Sprint", "fmt.Sprint"), ("b", "b"), ("ok", "ok"), ("helper", "helper")}


def test_javascript():
    x = extract("javascript", "import React, { useState as st, b } from 'react';\nimport * as fs from \"fs\";\nimport './side.css';\n\nexport default function main(a = {}) {\n  console.log('x()');\n  helper(new Thing());\n}\n\nclass Button extends React.Component {\n  onTap = (e) => { this.go(e); tap(); };\n  render() {\n    if (a) { return h(1); }\n  }\n  static async load(x) { return api.get(x); }\n}\n")
    assert names(x) == {"main": "function", "Button": "class", "render": "method", "load": "method"}
    assert [t for _, t in pairs(x, "IMPORTS")] == ["react", "fs", "./side.css"]
    assert x.aliases == [("st", "react", "useState"), ("b", "react", "b"), ("React", "react", "default"), ("fs", "fs", "")]
    assert {c for c in calls(x)} == {("main", "log", "console.log"), ("main", "helper", "helper"), ("Button", "go", "go"), ("Button", "tap", "tap"), ("render", "h", "h"), ("load", "get", "api.get")}
    assert {s[0]: s[4] for s in x.symbols}["render"] == "Button"


def test_typescript():
    x = extract("typescript", "interface IBtn {\n    click(): void;\n}\nclass Svc implements IBtn {\n    private getUser(id: number): User { return null; }\n    click(): { a: number } { ping(); }\n}\ntype P = { l: string };\nfunction Btn<T>(p: P): void { }\n")
    assert names(x) == {"IBtn": "class", "Svc": "class", "getUser": "method", "click": "method", "Btn": "function"}
    assert calls(x) == [("click", "ping", "ping")]
