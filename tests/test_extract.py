from graphloom.operators import extract as ex

RUST = '''use crate::graph::{Node, Edge as E};
/// fn fake() {}
pub struct Cache<T> { x: T }
impl<T> Cache<T> {
    pub fn open(&self) -> u32 { helper("fn no() {") }
}
enum Kind { A, B }
fn helper() {}
fn top() { helper(); self.x.run(); println!("x"); }
fn main() { top(); }
mod tests {
    #[test]
    fn test_parse() { top(); }
}
'''
TS = '''import React, { useMemo as m } from "./lib/theme";
import * as fs from 'fs';
export function top() { return helper(1); }
function helper(x) { return new Thing(x); }
export default function Page() { return <Card a={1} />; }
async function GET() {}
const useThing = () => { top(); };
const Box = (p) => <div/>;
const plain = 3;
class Store { run() { this.go.now(); } }
interface Shape { a: number }
type Id = string;
// function no() {}
'''


def kinds(p):
    return {n: k for n, k, *_ in p.symbols}


def test_rust():
    p = ex.parse_rust(RUST)
    assert kinds(p) == {"Cache": "struct", "Cache::open": "method", "Kind": "enum", "helper": "function", "top": "function", "tests": "module", "test_parse": "test"}
    assert p.imports == [("crate::graph::{Node, Edge as E}", True, ["Node", "Edge"], 1)]
    calls = {(c, line): conf for c, line, conf in p.calls}
    assert calls[("helper", 9)] == 0.8 and calls[("run", 9)] == 0.9 and calls[("println", 9)] == 0.7 and ("no", 5) not in calls
    assert next(s for s in p.symbols if s[0] == "Cache::open")[4:] == ("pub fn open(&self) -> u32", "pub")
    assert ex.enclosing(p.symbols, 13) == "test_parse" and ex.enclosing(p.symbols, 10) is None


def test_typescript_and_javascript():
    p = ex.parse_javascript(TS, True)
    assert kinds(p) == {"top": "function", "helper": "function", "Page": "function", "GET": "api_handler", "useThing": "hook", "Box": "component", "Store": "class", "Shape": "interface", "Id": "type"}
    assert p.imports[0] == ("./lib/theme", True, ["useMemo", "React"], 1) and p.imports[1][:2] == ("fs", False)
    calls = {(c, line): conf for c, line, conf in p.calls}
    assert calls[("helper", 3)] == 0.8 and calls[("Thing", 4)] == 0.7 and calls[("Card", 5)] == 0.6 and calls[("now", 10)] == 0.8
    assert kinds(ex.parse_javascript(TS, False)).keys() == {"top", "helper", "Page", "GET"}


def test_python():
    p = ex.parse_python("from .a import b\nimport os\n@deco(1)\ndef test_x(a, *b):\n    return os.path.join(a)\nclass C:\n    def m(self): pass\n")
    assert kinds(p) == {"test_x": "test", "C": "class"}
    assert p.imports == [("from .a import b", True, ["b"], 1), ("import os", False, ["os"], 2)]
    assert sorted(p.calls) == [("deco", 3, 0.6), ("deco", 3, 0.8), ("join", 5, 0.8)]
    assert kinds(ex.parse_python("def broken(:\nclass K(")) == {"broken": "function", "K": "class"}


def test_tables(spark):
    rows = [("a.rs", "rust", "fn helper() {}\nfn top() { helper(); helper(); }"), ("b.ts", "typescript", "function helper() {}\nexport function top() { helper(); }"), ("c.md", "markdown", "# x"), ("d.py", "python", None)]
    out = ex.extract(spark.createDataFrame(rows, "path string, language string, text string"))
    assert sorted(map(tuple, ex.call_sites(out).collect())) == [("a.rs", "top", "helper", 2, 0.8), ("b.ts", "top", "helper", 2, 0.8)]
    assert ex.symbols(out).count() == 4 and ex.imports(out).count() == 0


def test_junk_never_fails():
    for junk in ("{", "}", "fn", "fn (", "impl {", "\"", "'", "/*", "use", "class {", "import", "const x =", "`", "\x00"):
        ex.parse_rust(junk)
        ex.parse_javascript(junk, True)
        ex.parse_python(junk)
