"""Source extraction: symbols, relations and import aliases of one file.

Python goes through the standard parser (of a file that does not parse as a whole, the statements that do); Go, JavaScript and TypeScript through a small scanner that blanks comments
and strings (lengths and line ends stay) and then reads declarations at their brace level.  A file that does not
parse gives an error instead of failing its task.

A symbol is (name, kind, start_line, end_line, owner); a relation is (from, from_ordinal, relation, to_name,
call_expression), from ``<module>`` with ordinal -1 at file level; an alias is (alias, source_module, source_name).
"""

from __future__ import annotations

import ast
import bisect
import re
from dataclasses import dataclass, field

from ..functions.scalars import LANGUAGES

MODULE = "<module>"


@dataclass
class Extract:
    symbols: list[tuple[str, str, int, int, str]] = field(default_factory=list)
    relations: list[tuple[str, int, str, str, str]] = field(default_factory=list)
    aliases: list[tuple[str, str, str]] = field(default_factory=list)
    error: str | None = None

    def add(self, name: str, kind: str, start: int, end: int, owner: str = "") -> int:
        self.symbols.append((name, kind, start, end, owner))
        return len(self.symbols) - 1

    def relate(self, from_: str, ordinal: int, relation: str, to: str, call: str = "") -> None:
        self.relations.append((from_, ordinal, relation, to, call))

    def imports(self, module: str) -> None:
        self.relate(MODULE, -1, "IMPORTS", module)


def extract(language: str, source: str) -> Extract:
    """Extract by language; unknown languages give nothing."""
    try:
        return {"python": _python, "go": _go, "javascript": _script, "typescript": lambda s: _script(s, True)}.get(language, lambda s: Extract())(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return Extract(error=f"{type(e).__name__}: {e}")


# Python


def _callee(f: ast.expr) -> tuple[str, str] | None:
    if isinstance(f, ast.Name):
        return f.id, f.id
    if isinstance(f, ast.Attribute):
        return f.attr, f"{f.value.id}.{f.attr}" if isinstance(f.value, ast.Name) else f.attr
    return None


def _python(source: str) -> Extract:
    out = Extract()

    def calls(body: list[ast.stmt], name: str, ordinal: int) -> None:
        found = sorted((n for s in body for n in ast.walk(s) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset, -(n.end_lineno or 0), -(n.end_col_offset or 0)))
        for n in found:
            if got := _callee(n.func):
                out.relate(name, ordinal, "CALLS", *got)

    def function(n: ast.FunctionDef | ast.AsyncFunctionDef, owner: str) -> None:
        k = out.add(n.name, "method" if owner else "function", n.lineno, n.end_lineno or n.lineno, owner)
        if owner:
            out.relate(n.name, k, "DEFINES", owner)
        calls(n.body, n.name, k)

    def visit(nodes: list[ast.AST], owner: str) -> None:
        for n in nodes:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                function(n, owner)
            elif isinstance(n, ast.ClassDef):
                k = out.add(n.name, "class", n.lineno, n.end_lineno or n.lineno)
                for base in n.bases:
                    if isinstance(base, ast.Name):
                        out.relate(n.name, k, "INHERITS", base.id)
                visit(n.body, n.name)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    out.imports(a.name)
                    out.aliases.append((a.asname or a.name.split(".")[-1], a.name, ""))
            elif isinstance(n, ast.ImportFrom):
                module = "." * n.level + (n.module or "")
                out.aliases += [(a.asname or a.name, module, a.name) for a in n.names]
                out.imports(module)
            else:
                visit([c for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.expr, ast.arguments))], owner)

    body, out.error = _statements(source)
    visit(body, "")
    return out


#: Lines of one broken statement that are given up before it is left out.
TRIES = 20


def _statements(source: str) -> tuple[list[ast.stmt], str | None]:
    """Top-level statements, and the error of a file that does not parse as a whole.

    Of such a file every top-level block is parsed by itself; in a broken block the line at fault gives way to ``pass``."""
    try:
        return ast.parse(source).body, None
    except (SyntaxError, ValueError) as e:
        error = f"{type(e).__name__}: {e}"
    lines, out = source.replace("\x00", " ").split("\n"), []
    starts = [i for i, x in enumerate(lines) if x[:1].strip() and x[0] not in ")]}#"]
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        block = lines[a:b]
        for _ in range(TRIES):
            try:
                tree = ast.parse("\n".join(block))
            except SyntaxError as e:
                at = (e.lineno or 0) - 1
                if not 0 < at < len(block) or block[at].strip() == "pass":
                    break
                block[at] = block[at][: len(block[at]) - len(block[at].lstrip())] + "pass"
                continue
            ast.increment_lineno(tree, a)
            out += tree.body
            break
    return out, error


# Brace languages

_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_CALL = re.compile(r"(?P<before>[\w$)\].]?)(?P<chain>(?:\b[A-Za-z_$][\w$]*\s*\??\.\s*)*)\b(?P<name>[A-Za-z_$][\w$]*)\s*\(")
_GO_WORDS = {"func", "if", "for", "switch", "return", "go", "defer", "select", "range", "case", "interface", "struct", "map", "chan", "type", "var", "const", "import"}
_JS_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "new", "super", "await", "async", "of", "in", "import", "void", "delete", "do", "else", "yield", "throw", "case"}


def _blanked(source: str) -> str:
    """Comments and string contents as blanks; quotes and line ends stay."""

    def blank(m: re.Match) -> str:
        t = m.group()
        keep = (t[0], t[-1]) if t[0] in "\"'`" else (" ", " ")
        inner = "".join("\n" if c == "\n" else " " for c in t[1:-1])
        return keep[0] + inner + keep[1] if len(t) > 1 else t

    return _BLANK.sub(blank, source)


def _close(text: str, at: int, pair: str = "{}") -> int:
    """Offset after the bracket that closes the one at ``at`` (the end when none does)."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == pair[0]:
            depth += 1
        elif text[i] == pair[1]:
            depth -= 1
            if not depth:
                return i + 1
    return len(text)


class _Lines:
    """Line numbers of offsets, from 1, by binary search."""

    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def at(self, offset: int) -> int:
        return bisect.bisect_left(self.ends, offset) + 1


def _before(text: str, at: int) -> int:
    """Offset after the last character before ``at`` that is not white space."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return at


def _word_before(text: str, at: int, *words: str) -> bool:
    """Whether one of the words ends before ``at``, white space aside."""
    end = _before(text, at)
    return any(text.endswith(w, 0, end) and not (end > len(w) and (text[end - len(w) - 1].isalnum() or text[end - len(w) - 1] == "_")) for w in words)


def _brace_calls(out: Extract, body: str, name: str, ordinal: int, words: set[str]) -> None:
    for m in _CALL.finditer(body):
        callee, parts = m["name"], [p.strip(" ?\t\n") for p in m["chain"].split(".")[:-1]]
        if callee in words or _word_before(body, m.start("chain"), "new", "func", "function"):
            continue
        chained = m["before"] in (")", "]", ".")
        one = len(parts) == 1 and not chained and parts[0] not in ("this", "super")
        out.relate(name, ordinal, "CALLS", callee, f"{parts[0]}.{callee}" if one else callee)


def _body_at(text: str, at: int) -> int:
    """Offset of the body's brace after a signature; braces of struct{} and interface{} types are stepped over."""
    while at < len(text):
        c = text[at]
        if c == "{":
            if not _word_before(text, at, "interface", "struct"):
                return at
            at = _close(text, at)
        elif c in "([":
            at = _close(text, at, "()" if c == "(" else "[]")
        elif c in "\n;" and text[max(0, _before(text, at) - 1)] not in ",(":
            return -1
        else:
            at += 1
    return -1


def _go(source: str) -> Extract:
    out, text, at = Extract(), _blanked(source), 0
    lines, depth, seen = _Lines(text), 0, 0
    head = re.compile(r"\b(func|type|import)\b")
    while m := head.search(text, at):
        at, start = m.end(), m.start()
        depth += text.count("{", seen, start) - text.count("}", seen, start)
        seen = start
        if depth:
            continue
        if m[1] == "import":
            group = re.compile(r"\s*\(").match(text, at)
            end = _close(text, group.end() - 1, "()") if group else (text.find("\n", at) + 1 or len(text))
            for x in re.finditer(r"(?:([\w.]+)[ \t]+)?\"([^\"\n]+)\"", source[at:end]):
                out.imports(x[2])
                out.aliases.append((x[1] or x[2].split("/")[-1], x[2], ""))
            at = end
        elif m[1] == "func":
            f = re.compile(r"\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?\(").match(text, at)
            if not f:
                continue
            after = _close(text, f.end() - 1, "()")
            body = _body_at(text, after)
            end = _close(text, body) if body >= 0 else after
            k = out.add(f[2], "method" if f[1] else "function", lines.at(start), lines.at(end - 1), f[1] or "")
            if body >= 0:
                _brace_calls(out, text[body:end], f[2], k, _GO_WORDS)
            at = end
        else:
            group = re.compile(r"\s*\(").match(text, at)
            end = _close(text, group.end() - 1, "()") if group else at
            pos = group.end() if group else at
            while spec := re.compile(r"\s*(\w+)[ \t]*(?:\[[^\]\n]*\][ \t]*)?(=?)[ \t]*([^\n]*)").match(text, pos):
                if group and spec.end() >= end:
                    break
                brace = text.find("{", spec.start(3), spec.end())
                stop = _close(text, brace) if brace >= 0 else spec.end()
                out.add(spec[1], "class", lines.at(start if not group else spec.start(1)), lines.at(stop - 1))
                pos = stop
                if not group:
                    end = stop
                    break
            at = max(end, at)
    return out


_JS_IMPORT = re.compile(r"\bimport\b(?!\s*\()([^'\"`;]*?)['\"]([^'\"\n]*)['\"]")
_JS_METHOD = re.compile(r"(?:^|(?<=[;{}\n]))\s*(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+)*[*#]?\s*(['\"]?)([A-Za-z_$][\w$]*)\1\s*(?:<[^>{}()]*>\s*)?\(")
_JS_FIELD = re.compile(r"([A-Za-z_$][\w$]*)\s*(?::[^=;{}\n]*)?=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=>{}\n]*)?=>\s*")


def _js_body(text: str, after: int, typed: bool) -> int:
    """Offset of the body after parameters; with types, the return type may have braces of its own."""
    m = re.compile(r"\s*").match(text, after)
    at = m.end()
    if typed and at < len(text) and text[at] == ":":
        at = re.compile(r":\s*").match(text, at).end()
        if at < len(text) and text[at] == "{":
            at = _close(text, at)
        while at < len(text) and text[at] not in "{;\n":
            at = _close(text, at, "<>") if text[at] == "<" else at + 1
    return at if at < len(text) and text[at] == "{" else -1


def _script(source: str, typed: bool = False) -> Extract:
    out, text = Extract(), _blanked(source)
    lines = _Lines(text)
    head = re.compile(r"\b(?:(import)\b(?!\s*[(.])|(?:async\s+)?(function)\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>{}()]*>\s*)?\(|(?:abstract\s+)?(class)\s+([A-Za-z_$][\w$]*)" + (r"|(interface)\s+([A-Za-z_$][\w$]*)" if typed else r"|((?!))((?!))") + ")")
    at = 0
    while m := head.search(text, at):
        at, start = m.end(), m.start()
        if m[1]:
            x = _JS_IMPORT.match(source, m.start())
            if x:
                at = x.end()
                _js_import(out, x[1], x[2])
        elif m[2]:
            after = _close(text, m.end() - 1, "()")
            body = _js_body(text, after, typed)
            end = _close(text, body) if body >= 0 else after
            k = out.add(m[3], "function", lines.at(start), lines.at(end - 1))
            if body >= 0:
                _brace_calls(out, text[body:end], m[3], k, _JS_WORDS)
            at = end
        elif m[4] or m[6]:
            name = m[5] or m[7]
            open_ = text.find("{", at)
            end = _close(text, open_) if open_ >= 0 else len(text)
            out.add(name, "class", lines.at(start), lines.at(end - 1))
            if m[4] and open_ >= 0:
                _class_body(out, text, open_ + 1, end - 1, name, len(out.symbols) - 1, typed, lines)
            at = end
    return out


def _class_body(out: Extract, text: str, at: int, end: int, owner: str, ordinal: int, typed: bool, lines: _Lines) -> None:
    while at < end:
        method, arrow = _JS_METHOD.search(text, at, end), _JS_FIELD.search(text, at, end)
        found = min((x for x in (method, arrow) if x), key=lambda x: x.start(), default=None)
        brace = text.find("{", at, end)
        if found is None:
            return
        if 0 <= brace < found.start():  # a block of something else
            at = _close(text, brace)
            continue
        if found is arrow:
            at = found.end()
            stop = _close(text, at) if text[at : at + 1] == "{" else (text.find("\n", at) + 1 or end)
            _brace_calls(out, text[at:stop], owner, ordinal, _JS_WORDS)
            at = stop
            continue
        after = _close(text, found.end() - 1, "()")
        body = _js_body(text, after, typed)
        if body < 0 or found[2] in _JS_WORDS:
            at = after
            continue
        stop = _close(text, body)
        k = out.add(found[2], "method", lines.at(found.start(2)), lines.at(stop - 1), owner)
        _brace_calls(out, text[body:stop], found[2], k, _JS_WORDS)
        at = stop


def _js_import(out: Extract, clause: str, module: str) -> None:
    out.imports(module)
    clause = re.sub(r"\bfrom\s*$", "", clause.strip()).strip()
    named = re.search(r"\{([^}]*)\}", clause)
    for item in named[1].split(",") if named else []:
        words = [w for w in item.split() if w != "type"]
        if words:
            out.aliases.append((words[-1], module, words[0]))
    rest = re.sub(r"\{[^}]*\}", "", clause)
    for item in rest.split(","):
        words = [w for w in item.split() if w != "type"]
        if words[:2] == ["*", "as"] and len(words) == 3:
            out.aliases.append((words[2], module, ""))
        elif len(words) == 1:
            out.aliases.append((words[0], module, "default"))


def languages() -> dict[str, str]:
    """Extension to language (the parser registry)."""
    return dict(LANGUAGES)
