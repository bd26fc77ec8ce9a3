from pyspark.sql import functions as F

from graphloom.operators import refactor

SYMS = "node string, name string, kind string, path string, visibility string"


def test_split_file(spark):
    syms = [("1", "process_a", "function", "big.rs", "pub"), ("2", "process_b", "function", "big.rs", None), ("3", "process_c", "function", "big.rs", None), ("4", "build_x", "function", "big.rs", None), ("5", "build_y", "function", "big.rs", None), ("6", "test_it", "test", "t.rs", None)]
    calls = [("1", "2"), ("2", "3"), ("4", "5"), ("6", "1"), ("6", "4")]
    got = refactor.split_modules(spark.createDataFrame(syms, SYMS), spark.createDataFrame(calls, "src string, dst string"), "big.rs").collect()
    assert [(r.module, r.symbol_count, r.confidence, r.internal_edges, r.external_callers) for r in got] == [("process", 3, "high", 2, 1), ("build", 2, "medium", 1, 1)]


def test_rename_and_public_api(spark):
    syms = spark.createDataFrame([("1", "run", "function", "a.rs", "pub"), ("2", "test_run", "test", "t.rs", None), ("3", "go", "function", "a.rs", None)], SYMS)
    calls = spark.createDataFrame([("2", "1", "calls"), ("1", "3", "calls")], "src string, dst string, kind string")
    (r,) = refactor.rename_references(syms, calls, "run").collect()
    assert (r.callers, r.callees, r.tests) == (["t.rs::test_run"], ["a.rs::go"], 1)
    (r,) = refactor.public_api_changes(syms, calls, spark.createDataFrame([("a.rs",)], "path string")).collect()
    assert (r.name, r.references, r.tests) == ("run", 1, 1)


def test_scores(spark):
    row = spark.createDataFrame([(["A/b.rs", "c"], "see a\\b.rs", ["x", "X", "y"])], "e array<string>, t string, v array<string>")
    r = row.select(refactor.recall(F.col("e"), F.col("t")).alias("r"), refactor.duplicates(F.col("v")).alias("d")).first()
    assert (r.r, r.d) == (0.5, 1)
    assert abs(row.select(refactor.task_score(F.lit(1.0), F.lit(0.5), F.lit(1.0), F.lit(10)).alias("s")).first().s - 2.75) < 1e-9
