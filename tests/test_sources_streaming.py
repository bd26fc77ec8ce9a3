import pytest

from graphloom.sources import repo, sinks
from graphloom.streaming import watch


def test_scan(spark, tmp_path):
    for name, text in {"src/a.rs": "fn a() {}\n", "node_modules/x.js": "x", "b.py": "1", "empty.py": "", ".hidden/c.py": "1", "d.bin": "0", "big.ts": "x" * (1 << 20) + "y", "gen/e.py": "1", "skip.py": "1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("gen/\n")
    (tmp_path / ".graphloomignore").write_text("# x\n\nskip.py\n")
    got = {r.path: (r.language, r.size_bytes, r.loc) for r in repo.scan(spark, str(tmp_path)).collect()}
    assert got == {"src/a.rs": ("rust", 10, 1), "b.py": ("python", 1, 1)}


def test_git_relations(spark):
    got = {tuple(r) for r in repo.diff(spark, ["M\ta.rs", "A\tpic.png", "R100\told.rs\tnew.rs"], ["3\t1\ta.rs", "-\t-\tpic.png", "5\t0\told.rs => new.rs"]).collect()}
    assert got == {("a.rs", "M", 3, 1), ("pic.png", "A", 0, 0), ("old.rs", "R100", 0, 0)}
    assert repo.log(spark, ["h|me|2020|fix a|b", "bad"]).first().message == "fix a|b"
    h = "a" * 40
    assert [tuple(r) for r in repo.blame(spark, [f"{h} 1 1 1", "author Ann", "\tx = 1", f"{h} 2 2", "\ty"]).collect()] == [(1, h, "Ann", "x = 1"), (2, h, "Ann", "y")]
    assert {tuple(r) for r in repo.churn(repo.name_status(spark, ["M\ta", "A\ta", "D\ta", "M\tb"])).collect()} == {("a", 2), ("b", 1)}
    assert repo.owners(spark.createDataFrame([("a", "z"), ("a", "b")], "path string, author string")).first().owner == "b"
    assert {r.path for r in repo.changed_paths(spark, ["R  a.rs -> b.rs", " M target/x"], ["./c.rs"], skip=True).collect()} == {"b.rs", "c.rs"}
    assert repo.tsconfig_aliases(spark, '{"compilerOptions": {"paths": {"@/*": ["src/*", "x"]}}}').first() == ("@", "src")
    assert repo.rules_from_json('{"rules": [{"name": "r", "max_lines": 5}]}') == [("r", "error", None, None, None, 5)]


def test_merges_and_exports(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "path string, n int")
    assert {tuple(r) for r in sinks.upsert(old, new, ["path"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    touched = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {tuple(r) for r in sinks.replace_by(old, new.limit(0), "path", touched).collect()} == set()
    gone = spark.createDataFrame([(1,)], "id long")
    left = sinks.cascade_delete(gone, {"edges": (spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "a long, b long"), ["a", "b"])})
    assert [tuple(r) for r in left["edges"].collect()] == [(2, 3)]
    files = spark.createDataFrame([("file:1", "a<b", "rust")], "node string, path string, language string")
    edges = spark.createDataFrame([("file:1", "file:1", "imports", 1.0), ("file:1", "file:9", "imports", 1.0)], "src string, dst string, kind string, confidence double")
    nodes, kept = sinks.export_graph(files, None, edges)
    assert kept.count() == 1
    xml = "".join(r.value for r in sinks.graphml(nodes, kept).orderBy("part", "value").collect())
    assert "a&lt;b" in xml and xml.startswith("<graphml") and xml.endswith("</graphml>")
    assert sinks.json_document(files=files.select("node")).first().value == '{"files":[{"node":"file:1"}]}'
    assert sinks.html_rows(nodes).count() == 1 and sinks.markdown("T", {"A": ["x"], "B": []}) == "# T\n\n## A\n\n- x\n"


def test_watch_is_idempotent(spark, tmp_path):
    schema = "path string, hash string, ts long"
    src, events = str(tmp_path / "in"), []
    table = watch.Table(spark, str(tmp_path / "t"), schema, "path", ["ts", "hash"])
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    write([("a", "1", 1), ("b", "1", 1), ("target/x", "1", 1)])
    for _ in range(2):
        watch.watch(spark, src, schema, table, str(tmp_path / "c"), lambda n, k: events.append((n, k)), keep=watch.not_skipped).awaitTermination()
    write([("a", "2", 2)])
    watch.watch(spark, src, schema, table, str(tmp_path / "c"), lambda n, k: events.append((n, k)), keep=watch.not_skipped).awaitTermination()
    table.merge(spark.createDataFrame([("a", "2", 2)], schema), 1)
    assert {tuple(r) for r in table.read().collect()} == {("a", "2", 2), ("b", "1", 1)}
    assert events == [(0, 2), (1, 1)]
    # a third change of one path leaves two copies of its bucket, and touches no other
    table.merge(spark.createDataFrame([("a", "3", 3)], schema), 2)
    assert all(len(c) <= 2 for c in table._copies().values()) and len(table.read().collect()) == 2


def test_long_paths_and_equal_sets(spark):
    long = "d/" * 4000 + "x.rs"
    assert repo.changed_paths(spark, [f" M {long}"], []).first().path == long
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    assert watch.same_set(now, now) and not watch.same_set(now, now.limit(1)) and not watch.same_set(now.limit(1), now)


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2020-01-01 00:00:01", "a"), ("2020-01-01 00:00:59", "a"), ("2020-01-01 00:01:01", "a")], "t string, k string").selectExpr("timestamp(t) as t", "k")
    assert sorted(r.n for r in watch.windowed_counts(df, "t", "1 minute", "5 minutes", "k").collect()) == [1, 2]
    with pytest.raises(Exception):
        watch.windowed_counts(df, "k", "1 minute", "5 minutes").collect()
