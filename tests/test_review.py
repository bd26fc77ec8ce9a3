import time

from pyspark.sql import functions as F

from graphloom.functions import paths, scoring
from graphloom.operators import review, search


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expr.alias("x")).first().x


def test_ignore_forms(spark):
    cases = [("bench/open/src/main.ts", "bench/", True), ("src/benchmarks/mod.rs", "bench/", False), ("Cargo.lock", "Cargo.lock", True), ("lib/app.min.js", "*.min.js", True), ("target-x/debug/a.pdb", "target-*/", True), ("x", "# c", False), ("a/b", "a", True)]
    for path, pattern, want in cases:
        assert one(spark, paths.ignore_match(F.col("p"), pattern), p=path) is want
    assert one(spark, paths.ignored(F.col("p"), preset="python"), p="venv/x.py") is True


def test_path_classes(spark):
    want = {"a/B.TSX": "typescript", "x.h": "c", "noext": "unknown", "y.psm1": "powershell"}
    assert {p: one(spark, paths.language(F.col("p")), p=p) for p in want} == want
    assert one(spark, paths.module(F.col("p")), p="crates/x/src/a.rs") == "crates/x" and one(spark, paths.module(F.col("p")), p="src/a") == "src"
    flows = {"x/middleware.ts": "nextjs_middleware", "middleware.ts": None, "a/pages/api/x.go": "nextjs_api_route", "src/main.rs": "rust_binary", "celery/x.rs": "python_task", "a/queue.go": "worker_or_consumer", "tests/a.go": "test_flow", "a.go": None}
    assert {p: one(spark, paths.entrypoint(F.col("p")), p=p) for p in flows} == flows
    assert one(spark, paths.normalize(F.col("p")), p=".\\a\\b") == "a/b"
    assert one(spark, paths.test_command(F.col("p"), F.lit(None).cast("string")), p="tests/a_spec.rs") == "cargo test a_spec"


def test_globs():
    import re

    hit = lambda g, p: bool(re.search(paths.glob_regex(g), p))
    assert hit("src/components/**", "src/components/a/b.tsx") and not hit("src/components/**", "src/other/a.tsx")
    assert hit("**/x.rs", "a/b/x.rs") and hit("**/x.rs", "x.rs") and hit("*.{ts,js}", "a/b.js") and hit("a?[!b]", "axc")
    assert paths.glob_regex("a[") is None and paths.glob_regex("{a") is None


def test_terms_and_keywords(spark):
    assert scoring.keywords("Fix the CacheDb open bug in the cache") == ["cache", "cachedb", "fix", "open"]
    assert one(spark, scoring.terms(F.col("p")), p="src/Foo_bar.rs, ab") == ["src", "foo", "bar"]
    assert one(spark, scoring.risk_level(scoring.risk_score(F.lit(6), F.lit(4000), F.lit(20), F.lit(3), F.lit(9))), p=1) == "critical"
    assert one(spark, scoring.ascii_fold(F.col("p")), p="a → “b”…") == 'a -> "b"...'
    assert one(spark, scoring.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), p=1) == 0.0


FILES, SYMS, EDGES = "node string, path string", "node string, name string, kind string, path string, visibility string", "src string, dst string, kind string"


def test_suggested_tests(spark):
    files = spark.createDataFrame([("f1", "src/orders.rs"), ("f2", "tests/orders_spec.rs"), ("f3", "tests/other.rs")], FILES)
    goal = spark.createDataFrame([("src/orders.rs",)], "path string")
    none = spark.createDataFrame([], SYMS)
    got = review.suggested_tests(files, none, spark.createDataFrame([("f2", "f1", "imports")], EDGES), goal).collect()
    assert [(r.path, r.score, r.confidence, r.command) for r in got] == [("tests/orders_spec.rs", 6.5, "medium", "cargo test orders_spec")]
    syms = spark.createDataFrame([("s1", "rebuild_graph", "function", "src/orders.rs", None), ("s2", "test_rebuild_graph", "test", "tests/other.rs", None)], SYMS)
    got = review.suggested_tests(files, syms, spark.createDataFrame([("s2", "s1", "calls")], EDGES), goal).collect()
    assert got[0].path == "tests/other.rs" and got[0].score == 7.0 and got[0].tests == ["test_rebuild_graph"]


def test_dead_code_buckets(spark):
    syms = [("s1", "used", "function", "a.rs", None), ("s2", "pubfn", "function", "a.rs", "pub"), ("s3", "lone", "function", "b.rs", None), ("s4", "mid", "method", "a.rs", None), ("s5", "low", "struct", "a.rs", None), ("s6", "t", "test", "a.rs", None), ("s7", "c", "function", "x.toml", None)]
    files = spark.createDataFrame([("fa", "a.rs"), ("fb", "b.rs")], FILES)
    edges = spark.createDataFrame([("s4", "s1", "calls"), ("fb", "fa", "imports")], EDGES)
    got = {r.name: r.bucket for r in review.dead_code(spark.createDataFrame(syms, SYMS), files, edges).collect()}
    assert got == {"pubfn": "public_api_risk", "lone": "high", "mid": "medium", "low": "low"}


def test_rules(spark):
    files = spark.createDataFrame([("target/x", 1, 1), ("big.rs", 40 * 801, 5)], "path string, size_bytes long, loc long")
    imports = spark.createDataFrame([("src/components/a.tsx", "src/server/db/x.ts"), ("src/a", "src/b")], "src_path string, dst_path string")
    got = sorted((r.rule, r.path, r.target) for r in review.rule_violations(files, imports).collect())
    assert got == [("no-build-artifacts", "target/x", None), ("no-large-files", "big.rs", None), ("no-ui-to-db", "src/components/a.tsx", "src/server/db/x.ts")]
    assert review.rule_violations(files, imports, by_loc=True).count() == 2


def test_flow(spark):
    nodes = spark.createDataFrame([("f", "src/main.rs"), ("m", "src/main.rs"), ("p", "src/orders.rs")], "node string, path string")
    traced = spark.createDataFrame([("f", ["f", "m", "p"])], "entry string, path array<string>")
    changed = spark.createDataFrame([("src/orders.rs",)], "path string")
    (r,) = review.flows(nodes, traced, changed, spark.createDataFrame([("m", "p")], "src string, dst string")).collect()
    assert (r.kind, r.path, r.confidence, r.risk) == ("rust_binary", ["f", "m", "p"], "medium", "high")


def test_context_pack(spark):
    files = spark.createDataFrame([("src/cache.rs",), ("src/other.rs",), ("docs/x",)], "path string")
    syms = spark.createDataFrame([("src/cache.rs", "CacheDb", "struct", None, 1, 9), ("src/cache.rs", "zed", "function", "fn zed()", 10, 11)], "path string, name string, kind string, signature string, start_line int, end_line int")
    imports = spark.createDataFrame([("src/cache.rs", "src/b.rs"), ("src/main.rs", "src/cache.rs")], "src_path string, dst_path string")
    (r,) = review.context_pack(files, syms, imports, "open the cache", per_file=1).collect()
    assert (r.path, r.score, r.symbols, r.omitted, r.dependency_chain, r.importers) == ("src/cache.rs", 1.5, ["CacheDb L1-9"], 1, "src/cache.rs -> src/b.rs", ["src/main.rs"])


def test_search_fallback_and_hybrid(spark):
    docs = spark.createDataFrame([("a", "file", "alpha beta"), ("b", "file", "beta gamma")], "node string, kind string, content string")
    nodes = spark.createDataFrame([("a", "alphabet", "x/a", None, "file"), ("b", "bee", "x/b", None, "file")], "node string, name string, path string, signature string, kind string")
    assert [(r.node, r.reason) for r in search.search(docs, nodes, "alpha", None, 5).collect()] == [("a", "fts5")]
    assert [(r.node, r.reason) for r in search.search(docs, nodes, "alphab", None, 5).collect()] == [("a", "substring")]
    vec = spark.createDataFrame([("a", "alphabet", "function", [1.0, 0.0])], "node string, name string, kind string, vector array<double>")
    none = spark.createDataFrame([], "node string, score double")
    (r,) = search.hybrid(vec, none, none, [1.0, 0.0], 5).collect()
    assert r.reason == "semantic_vector_graph" and abs(r.score - 0.5) < 1e-9
    v = search.hash_embedding(docs, "node", "content").first().vector
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9


def test_words_meet_no_pairs_of_paths(spark):
    """30,000 words and 100,000 paths of like beginnings: met by two letters, more than a thousand million pairs."""
    began = time.monotonic()
    files = spark.range(100_000).selectExpr("'f' || id as node", "'tests/c' || (100000 + id) || '.rs' as path")
    symbols = spark.range(30_000).selectExpr("'s' || id as node", "'order_' || (100000 + id * 3) as name", "'function' as kind", "'tests/c100000.rs' as path")
    edges = spark.createDataFrame([], "src string, dst string, kind string")
    got = review.suggested_tests(files, symbols, edges, spark.createDataFrame([("tests/c100000.rs",)], "path string"), 3).collect()
    # tests, c100000 and 100000, then tests and the number of each third path
    assert [(r.path, r.score) for r in got] == [("tests/c100000.rs", 6.0), ("tests/c100003.rs", 4.5), ("tests/c100006.rs", 4.5)]
    assert time.monotonic() - began < 45
