"""Assembly, the index driver, the query language, composite questions, the store and the stored search index."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import outputs
from graphloom.operators import ask, assemble, lookup, postings, resolve, search
from graphloom.sources.store import Store

LIB = "pub mod store;\nuse crate::store::Db;\npub fn run() {\n    open();\n    helper();\n}\nfn helper() {}\n"
STORE = "pub struct Db;\npub fn open() {\n    close();\n}\nfn close() {}\n"
MAIN = "use crate::lib::run;\nfn start() {\n    run();\n}\n"
TEST = "use crate::store::open;\n#[test]\nfn opens() {\n    open();\n}\n"
FILES = [("src/lib.rs", LIB), ("src/store.rs", STORE), ("src/main.rs", MAIN), ("src/store_test.rs", TEST)]
SCHEMA = "path string, language string, hash string, size_bytes long, loc long, text string"


def scan(spark, files):
    return spark.createDataFrame([(p, "rust", str(hash(t)), len(t), t.count("\n"), t) for p, t in files], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark):
    return assemble.index(scan(spark, FILES))


@pytest.fixture(scope="module")
def graph(tables):
    return assemble.graph(tables)


def test_index_resolves_imports_and_calls(tables):
    files = {(r.src_path, r.dst_path) for r in tables["import_edges"].collect()}
    assert files == {("src/lib.rs", "src/store.rs"), ("src/main.rs", "src/lib.rs"), ("src/store_test.rs", "src/store.rs")}
    names = {r.symbol_id: r.name for r in tables["symbols"].collect()}
    calls = {(names[r.src], names[r.dst], r.strategy) for r in tables["call_edges"].collect()}
    assert calls == {("run", "helper", "same_file"), ("run", "open", "unique_global"), ("open", "close", "same_file"), ("start", "run", "unique_global"), ("opens", "open", "unique_global")}
    assert {(r.src_path, r.dst_path) for r in tables["file_calls"].collect()} == files


def test_graph_leaves_dangling_edges_out(spark, tables, graph):
    kinds = {r.kind: r["count"] for r in graph.edges.groupBy("kind").count().collect()}
    assert kinds == {"contains": tables["symbols"].count(), "imports": 3, "calls": 5 + 3}
    lost = tables["import_edges"].union(spark.createDataFrame([(1, "src/lib.rs", "nowhere.rs")], tables["import_edges"].schema))
    g = assemble.build(tables["files"], tables["symbols"], lost)
    assert g.of_kinds("imports").count() == 3 and g.of_kinds("calls").count() == 0


def test_reindex_equals_a_fresh_index(spark, tables):
    after = [FILES[0], ("src/store.rs", STORE.replace("close", "shut")), ("src/extra.rs", "use crate::store::Db;\nfn more() { open(); }\n"), FILES[2]]
    store = {k: tables[k] for k in ("files", "symbols", "imports", "calls")}
    now, report = assemble.reindex(scan(spark, after), store)
    assert {k: sorted(r.path for r in v.collect()) for k, v in report.items()} == {"added": ["src/extra.rs"], "changed": ["src/store.rs"], "removed": ["src/store_test.rs"]}
    fresh = assemble.index(scan(spark, after))
    for k, df in fresh.items():
        cols = [c for c in df.columns if c not in ("loc",)]
        rows = lambda t: sorted(map(str, t.select(*cols).collect()))
        assert rows(now[k]) == rows(df), k
    same, report = assemble.reindex(scan(spark, after), now)
    assert all(v.isEmpty() for v in report.values())


def test_query_language(graph):
    ids = {r.name: r.node for r in graph.nodes.collect()}
    edges = lambda q: {(r.src, r.dst) for r in ask.run(graph, q).collect()}
    assert edges("callers_of open") == {(ids["run"], ids["open"]), (ids["opens"], ids["open"])}
    assert edges("deps_of src/lib.rs") >= {(ids["src/lib.rs"], ids["src/store.rs"]), (ids["run"], ids["open"])}
    assert edges("imported_by src/store.rs") >= {("file:src/lib.rs", "file:src/store.rs")}
    assert {r.src for r in ask.run(graph, "symbols_in src/store.rs").collect()} == {ids["Db"], ids["open"], ids["close"]}
    assert [r.path for r in ask.run(graph, "tests_for src/store.rs").collect()] == ["src/store_test.rs"]
    assert ask.run(graph, "helper").first().src == ids["helper"]
    assert ask.call(graph, "query_graph", query="helper").count() == 1
    with pytest.raises(KeyError, match="known"):
        ask.call(graph, "nothing")


def test_impact_flows_and_risk(spark, graph):
    got = {r.path: (r.depth, r.reason) for r in ask.impact_radius(graph, "src/store.rs").collect()}
    assert got["src/store.rs"][0] == 0 and got["src/lib.rs"] == (1, "reverse_import_dependency") and got["src/main.rs"][0] == 2
    changes = spark.createDataFrame([("src/store.rs", 300, 100)], "path string, lines_added long, lines_deleted long")
    parts = ask.detect_changes(graph, changes)
    flow = {r.entry: r for r in parts["flows"].collect()}["file:src/main.rs"]
    assert flow.kind == "rust_binary" and flow.path[0] == "file:src/main.rs" and flow.risk == "high"
    assert [r.path for r in parts["tests"].collect()] == ["src/store_test.rs"]
    row = parts["risk"].first()
    assert (row.changes, row.lines, row.impacted) == (1, 400, 3) and row.score == min(5, 25) + 10 + 6 + 8 * row.flows + 5 * row.reasons and row.level in ("low", "medium", "high")


def test_rules_report_and_validate(spark):
    files = spark.createDataFrame([("a.rs", 10, 1), ("b.rs", 10, 1), ("c.rs", 40_000, 1)], "path string, size_bytes long, loc long")
    imports = spark.createDataFrame([("a.rs", "b.rs"), ("b.rs", "a.rs"), ("a.rs", "c.rs")], "src_path string, dst_path string")
    bad = {(r.rule, r.path, r.target) for r in ask.broken_rules(files, imports).collect()}
    assert bad == {("no-cycles", "a.rs", "a.rs"), ("no-cycles", "b.rs", "a.rs"), ("no-large-files", "c.rs", None)}
    owners = spark.createDataFrame([("b.rs", "ann")], "path string, owner string")
    rows = {(r.section, r.item, r.n) for r in ask.report(spark.createDataFrame([("b.rs",)], "path string"), files, imports, owners).collect()}
    assert rows >= {("changed", "b.rs", None), ("impacted", "a.rs", None), ("risk", "low", 1), ("reviewer", "ann", None), ("violation", "no-cycles: a.rs", None)}
    found = ask.report(spark.createDataFrame([("b.rs",)], "path string"), files, imports, owners)
    assert ("warning", "Source files changed but no test files modified.") in {tuple(r) for r in ask.validate(found).collect()}


def test_overview_and_context(graph, tables):
    rows = {(r.section, r.name): r.n for r in ask.overview(graph, tables["files"]).collect()}
    assert rows["nodes", "file"] == 4 and rows["language", "rust"] == 4 and rows["fan_in", "src/store.rs"] == 2 and not any(s == "cycle" for s, _ in rows)
    pack = {r.path: r for r in ask.review_context(graph, "change how the store opens").collect()}
    assert "src/store.rs" in pack and any("open" in s for s in pack["src/store.rs"].symbols) and "src/lib.rs" in pack["src/store.rs"].importers
    best = tables["files"].filter("path = 'src/store.rs'").select("path")
    assert [tuple(r) for r in ask.pack_tests(best, tables["symbols"]).collect()] == [("src/store_test.rs", 0)]
    table = tables["files"].sparkSession.createDataFrame([("store", "Keep it stable."), ("gui", "No.")], "needle string, rule string")
    assert [r.rule for r in ask.path_rules(best, table).collect()] == ["Keep it stable."]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.index(scan(spark, FILES)) == {"added": 4, "changed": 0, "removed": 0}
    assert store.index(scan(spark, FILES[1:])) == {"added": 0, "changed": 0, "removed": 1}
    assert store.get_config("graph") == "current" and store.get_config("none", "x") == "x"
    assert store.graph().of_kinds("imports").count() == 1
    store.write("edges", store.graph().edges)
    store.append("edges", spark.createDataFrame([("x", "y", "calls", 1.0)], store.read("edges").schema))
    assert store.delete_edges("edges", "calls", spark.createDataFrame([("x",)], "src string")).filter("src = 'x'").isEmpty()
    assert store.delete_edges("edges", "calls").filter("kind = 'calls'").isEmpty()
    assert "t_symbols" in store.views("t_") and spark.sql("select count(*) as n from t_files").first().n == 3


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Open the store, open it"), ("b", "store of things"), ("c", None), ("d", "nothing here")], "node string, content string")
    index = postings.Index(spark, str(tmp_path / "i")).build(docs)
    assert [r.key for r in index.bm25("open store", 5).collect()] == ["a"]
    assert [r.key for r in index.bm25("STORE", 5).collect()] == ["b", "a"]  # the shorter text first
    assert index.bm25("absent", 5).count() == 0 and index.bm25("?!", 5).count() == 0
    plan = index.of(["store"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters")[1][:80]
    index.clear()
    assert index.bm25("store", 5).count() == 0


def test_stored_index_counts_within_documents(spark, tmp_path):
    rows = [("a", "Open the store, open it"), ("b", "store caf\u00e9s \u0130x \u212a"), ("b", "store of 2 things"), (None, "STORE"), (None, "store"), ("c", None), ("d", ""), ("e", "?!")]
    docs = spark.createDataFrame(rows, "node string, content string")
    plan = postings.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # a document's counts need no shuffle
    index = postings.Index(spark, str(tmp_path / "i")).build(docs)
    got = {r.term: (r.docs, r.uses) for r in index.terms().collect()}
    assert got["store"] == (3, 5) and got["open"] == (1, 2)  # keys, of which b and null have two documents each
    assert {"caf", "s", "i", "x", "k", "2"} < set(got) and len(got) == 12
    for query in ("store", "open store", "store x", "none"):
        want = [(r.node, round(r.score, 12)) for r in search.bm25(docs, query, 9).collect()]
        assert [(r.key, round(r.score, 12)) for r in index.bm25(query, 9).collect()] == want


def test_stored_index_is_shuffled_once_in_runs(spark, tmp_path):
    words = [f"w{k * 7919 % 5000}" for k in range(5000)]
    docs = spark.createDataFrame([(k, " ".join(words[k::40] + ["the"] * (k + 1))) for k in range(40)], "node long, content string").repartition(3)
    index = postings.Index(spark, str(tmp_path / "i")).build(docs)
    assert {r.term: (r.docs, r.uses) for r in index.terms().collect()} == {w: (1, 1) for w in words} | {"the": (40, 820)}
    for part in sorted((tmp_path / "i" / "postings").glob("bucket=*/*.parquet")):
        terms = [r.term for r in spark.read.parquet(str(part)).collect()]
        assert terms == sorted(terms)


def test_hot_names_meet_a_site_once(spark):
    symbols = spark.createDataFrame([(k, f"f{k}.rs", "new", 1) for k in range(500)] + [(900, "only.rs", "A::solo", 3)], "symbol_id long, path string, name string, start_line int")
    sites = spark.createDataFrame([(1, "f7.rs", "new"), (2, "x.rs", "new"), (3, "x.rs", "solo"), (4, "y.rs", "new")], "site long, path string, callee string")
    visible = spark.createDataFrame([("x.rs", "f9.rs", []), ("y.rs", "f1.rs", ["new"]), ("y.rs", "f2.rs", [])], "path string, dst_path string, names array<string>")
    got = {(r.site, r.symbol_id, r.strategy) for r in resolve.callees(sites, symbols, visible).collect()}
    assert got == {(1, 7, "same_file"), (2, 9, "import_resolved"), (3, 900, "unique_global")}


def test_lookups_and_outputs(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c.alias("x")).first().x
    assert [one(lookup.node_kind(F.col("k")), k=k) for k in ("api_handler", "type", "hook", "odd")] == ["api_endpoint", "interface", "hook", "symbol"]
    assert one(outputs.step(F.col("t"), [(1.0, "cargo test -p x"), (0.5, "cargo test")]), t="Run Cargo TEST now") == 0.5
    assert one(outputs.summed(F.col("t"), [(0.35, "plan"), (0.9, "files")]), t="PLAN of files") == 1.0
    rows = spark.createDataFrame([("mine", 4.0, 2.0, 1, 0, 0), ("rival_a", 5.0, 3.0, 0, 0, 0)], "mode string, final double, per_1k double, duplicate_paths int, encoding_errors int, irrelevant_rules int")
    assert {r.failure for r in outputs.gates(rows, "mine", "rival_").collect()} == {"final < 4.5", "per_1k <= best rival", "duplicate_paths != 0"}
