"""Extraction: source text to symbols, imports and call sites, as one Arrow pass over files.

The scanners skip comments and strings and match braces; Python goes through the standard parser, broken Python
falls back to lines. Only what the store keeps is emitted: top-level items (for Rust also those in modules and
methods of impl blocks).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Parsed:
    #: (name, kind, start_line, end_line, signature, visibility)
    symbols: list[tuple] = field(default_factory=list)
    #: (target, is_relative, names, line)
    imports: list[tuple] = field(default_factory=list)
    #: (callee, line, confidence)
    calls: list[tuple] = field(default_factory=list)


def last_identifier(text: str) -> str | None:
    found = re.findall(r"[A-Za-z0-9_]+", text)
    return found[-1] if found else None


_RUST_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|$)|b?r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n]+?|[^'\\\n])'", re.S)
_JS_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|$)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def _blank(text: str, skip: re.Pattern, keep_strings: bool = False) -> str:
    """Comments (and strings) as blanks of the same length; line breaks stay."""

    def over(m: re.Match) -> str:
        s = m.group(0)
        if keep_strings and not s.startswith(("//", "/*")):
            return s
        return re.sub(r"[^\n]", " ", s)

    return skip.sub(over, text)


def _close(text: str, at: int) -> int:
    """Place after the bracket that closes the one at ``at``."""
    pairs, depth = {"{": "}", "(": ")", "[": "]"}, 0
    a, b = text[at], pairs[text[at]]
    for k in range(at, len(text)):
        depth += (text[k] == a) - (text[k] == b)
        if not depth:
            return k + 1
    return len(text)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


_RUST_ITEM = re.compile(r"(?P<attrs>(?:#\[[^\]]*\]\s*)*)(?P<vis>pub(?:\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const|extern(?:\s+\"[^\"]*\")?)\s+)*(?P<what>mod|struct|enum|trait|fn|impl|use)\b")


def _rust_items(text: str, raw: str, lo: int, hi: int, out: Parsed, owner: str | None = None) -> None:
    at = lo
    while m := _RUST_ITEM.search(text, at, hi):
        what, end = m.group("what"), m.end()
        start = m.start() + len(m.group("attrs"))
        body = re.compile(r"[{;]").search(text, end, hi)
        stop = hi if body is None else body.start()
        close = stop + 1 if body is None or text[stop] == ";" else _close(text, stop)
        vis = (m.group("vis") or "").strip() or None
        if m.start() > lo and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            at = end
            continue
        if what == "use":
            semi = text.find(";", end, hi)
            semi = hi if semi < 0 else semi
            target = re.sub(r"\s+", " ", raw[end:semi]).strip()
            inner = re.search(r"\{(.*)\}", target, re.S)
            names = [x.split(" as ")[0].strip() for x in inner.group(1).split(",")] if inner else [target.rsplit("::", 1)[-1].split(" as ")[0]]
            out.imports.append((target, target.startswith(("self::", "super::", "crate::")), [n for n in names if n and n != "*"], _line(raw, start)))
            at = semi + 1
            continue
        name = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)").match(text, end)
        lines = (_line(raw, start), _line(raw, max(start, min(close, len(raw)) - 1)))
        if what == "impl":
            head = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", raw[end:stop]))
            target = last_identifier(head.split(" for ")[-1].split(" where ")[0]) or ""
            if text[stop : stop + 1] == "{":
                _rust_items(text, raw, stop + 1, close - 1, out, target)
        elif name:
            n = name.group(1)
            if what == "fn":
                test = re.search(r"\btest\b|test_case|rstest", m.group("attrs")) is not None
                sig = re.sub(r"\s+", " ", f"{vis + ' ' if vis else ''}fn {raw[name.start(1) : stop]}").strip()
                if owner:
                    out.symbols.append((f"{owner}::{n}", "method", *lines, sig, vis))
                elif n != "main" or test:
                    out.symbols.append((n, "test" if test else "function", *lines, sig, vis))
            else:
                kind = "module" if what == "mod" else what
                out.symbols.append((n, kind, *lines, f"{vis + ' ' if vis else ''}{what} {n}", vis))
                if what == "mod" and text[stop : stop + 1] == "{":
                    _rust_items(text, raw, stop + 1, close - 1, out)
        at = max(close, end)


_RUST_WORDS = set("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type union unsafe use where while Some Ok Err None".split())


def parse_rust(raw: str) -> Parsed:
    out, text = Parsed(), _blank(raw, _RUST_SKIP)
    _rust_items(text, raw, 0, len(text), out)
    for m in re.finditer(r"(?P<dot>\.\s*)?(?P<name>[A-Za-z_][A-Za-z0-9_]*)(?:::<[^>()]*>)?(?P<bang>!)?\s*[\(\[{]", text):
        n, bracket = m.group("name"), text[m.end() - 1]
        if m.group("bang"):
            out.calls.append((n, _line(text, m.start("name")), 0.7))
        elif bracket == "(" and n not in _RUST_WORDS and not re.search(r"\b(fn|struct|enum|mod|trait|use)\s+$", text[max(0, m.start("name") - 12) : m.start("name")]):
            out.calls.append((n, _line(text, m.start("name")), 0.9 if m.group("dot") else 0.8))
    return out


_JS_WORDS = set("catch class const delete do else export extends finally for function if import in instanceof let new of return super switch throw try typeof var void while with yield await async constructor".split())
_VERBS = {"DELETE", "GET", "PATCH", "POST", "PUT"}


def _js_kind(name: str, arrow: bool) -> str:
    if not arrow and name in _VERBS:
        return "api_handler"
    if arrow and name.startswith("use") and name[3:4].isupper():
        return "hook"
    return "component" if name[:1].isupper() else "function"


def parse_javascript(raw: str, types: bool) -> Parsed:
    """TypeScript with ``types``; JavaScript has only imports, functions and calls."""
    out, text, code = Parsed(), _blank(raw, _JS_SKIP), _blank(raw, _JS_SKIP, keep_strings=True)
    for m in re.finditer(r"(?m)^[ \t]*import\b(?P<what>[^;'\"]*?)(?:\bfrom\b\s*)?(?P<q>['\"])(?P<mod>[^'\"\n]*)(?P=q)", code):
        inner = re.search(r"\{([^}]*)\}", m.group("what"))
        names = [x.split(" as ")[0].replace("type ", "").strip() for x in inner.group(1).split(",")] if inner else []
        rest = re.sub(r"\{[^}]*\}", "", m.group("what")).replace("type ", "")
        names += [x.strip() for x in rest.split(",")]
        out.imports.append((m.group("mod"), m.group("mod").startswith("."), [n for n in names if n], _line(code, m.start())))
    depth, tops = 0, []
    for k, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "\n" and depth == 0 or k == 0:
            tops.append(k)
    item = re.compile(r"\s*(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:(?:abstract|async)\s+)*(?P<what>function\*?|const|class|interface|type)\s+(?P<name>[A-Za-z_$][\w$]*)")
    for at in tops:
        m = item.match(text, at)
        if not m:
            continue
        what, name, exported = m.group("what").rstrip("*"), m.group("name"), bool(m.group("export"))
        if exported and what != "function" or not types and (what != "function"):
            continue
        arrow = what == "const"
        if arrow and not re.compile(r"[^=;]*=\s*(?:async\s*)?(?:\([^=;{]*\)|[\w$]+)\s*(?::[^=;{]*)?=>").match(text, m.end()):
            continue
        brace = text.find("{", m.end())
        semi = text.find(";", m.end())
        start = m.start() + len(m.group(0)) - len(m.group(0).lstrip())
        if what == "function":
            close_args = _close(text, text.find("(", m.end())) if "(" in text[m.end() :] else m.end()
            brace = text.find("{", close_args)
        end = semi if semi >= 0 and (brace < 0 or semi < brace) else _close(text, brace) - 1 if brace >= 0 else len(text) - 1
        kind = {"class": "class", "interface": "interface", "type": "type"}.get(what) or ("function" if exported else _js_kind(name, arrow))
        head = raw[m.start("name") : brace if brace >= 0 else end].strip()
        sig = f"fn {head}" if what == "function" else f"{what} {name}"
        out.symbols.append((name, kind, _line(raw, start), _line(raw, max(start, end)), re.sub(r"\s+", " ", sig), "export" if exported else None))
    for m in re.finditer(r"(?P<new>\bnew\s+)?(?P<name>[A-Za-z_$][\w$]*(?:\s*\??\.\s*[A-Za-z_$][\w$]*)*)\s*(?:<[^<>()]*>)?\(", text):
        n = last_identifier(m.group("name"))
        if n and n not in _JS_WORDS and m.group("name") not in _JS_WORDS and not re.search(r"\bfunction\*?\s*$", text[: m.start("name")][-12:]):
            out.calls.append((n, _line(text, m.start("name")), 0.7 if m.group("new") else 0.8))
    for m in re.finditer(r"<([A-Z][\w$.]*)(?=[\s/>])", text):
        out.calls.append((last_identifier(m.group(1)), _line(text, m.start()), 0.6))
    return out


def parse_python(raw: str) -> Parsed:
    out = Parsed()
    try:
        tree = ast.parse(raw)
    except (SyntaxError, ValueError, RecursionError):
        for k, line in enumerate(raw.split("\n"), 1):
            if m := re.match(r"(?:async\s+)?(def|class)\s+(\w+)", line):
                kind = "class" if m.group(1) == "class" else "test" if m.group(2).startswith("test_") else "function"
                out.symbols.append((m.group(2), kind, k, k, line.strip().rstrip(":"), None))
        return out
    lines = raw.split("\n")
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            text = " ".join(x.strip() for x in lines[node.lineno - 1 : node.end_lineno])
            out.imports.append((text, isinstance(node, ast.ImportFrom) and node.level > 0, [a.name for a in node.names], node.lineno))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "test" if node.name.startswith("test_") else "function"
            out.symbols.append((node.name, kind, node.lineno, node.end_lineno, f"def {node.name}({ast.unparse(node.args)})", None))
        elif isinstance(node, ast.ClassDef):
            out.symbols.append((node.name, "class", node.lineno, node.end_lineno, f"class {node.name}", None))
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and (n := last_identifier(ast.unparse(node.func))):
            out.calls.append((n, node.lineno, 0.8))
        for d in getattr(node, "decorator_list", []):
            if n := last_identifier(ast.unparse(d.func if isinstance(d, ast.Call) else d)):
                out.calls.append((n, d.lineno, 0.6))
    return out


def parse(path: str, language: str, text: str) -> Parsed:
    if language == "rust":
        return parse_rust(text)
    if language in ("typescript", "javascript"):
        return parse_javascript(text, language == "typescript")
    return parse_python(text) if language == "python" else Parsed()


def enclosing(symbols: list[tuple], line: int) -> str | None:
    """Name of the smallest symbol that holds the line, the first of equals."""
    held = [(e - s, k, n) for k, (n, _, s, e, _, _) in enumerate(symbols) if s <= line <= e]
    return min(held)[2] if held else None


_ROW = pa.struct([("kind", pa.string()), ("name", pa.string()), ("what", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("visibility", pa.string()), ("names", pa.list_(pa.string())), ("flag", pa.bool_()), ("confidence", pa.float64())])
_SCHEMA = "path string, kind string, name string, what string, start_line int, end_line int, signature string, visibility string, names array<string>, flag boolean, confidence double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "text"))):
            p = parse(path, language, text or "")
            out += [(path, "symbol", n, k, s, e, sig, v, None, None, None) for n, k, s, e, sig, v in p.symbols]
            out += [(path, "import", t, None, line, line, None, None, names, rel, None) for t, rel, names, line in p.imports]
            seen = {}
            for callee, line, confidence in p.calls:
                seen.setdefault((line, enclosing(p.symbols, line) or path, callee), confidence)
            out += [(path, "call", callee, caller, line, line, None, None, None, None, c) for (line, caller, callee), c in seen.items()]
        types = [pa.string(), *(f.type for f in _ROW)]
        cols = list(zip(*out)) or [[]] * 11
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["path", *(f.name for f in _ROW)])


def extract(files: DataFrame) -> DataFrame:
    """One row for each symbol, import and call site of files (path, language, text); see ``symbols`` and so on."""
    return files.select("path", "language", "text").mapInArrow(_rows, _SCHEMA)


def symbols(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'symbol'").selectExpr("path", "name", "what as kind", "start_line", "end_line", "signature", "visibility")


def imports(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'import'").selectExpr("path", "name as target", "flag as is_relative", "names as imported_names", "start_line as line")


def call_sites(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'call'").selectExpr("path", "what as caller", "name as callee", "start_line as line", "confidence")
