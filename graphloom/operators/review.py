"""Change review over a code graph: dead code, suggested tests, rules, risk, context packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, scoring
from ..runtime import written
from . import lookup

#: (name, severity, from glob, to glob, path glob, most lines)
DEFAULT_RULES = [
    ("no-api-to-ui", "error", "src/app/api/**", "src/components/**", None, None),
    ("no-build-artifacts", "error", None, None, "target/**", None),
    ("no-cycles", "error", None, None, None, None),
    ("no-large-files", "warning", None, None, None, 800),
    ("no-ui-to-db", "error", "src/components/**", "src/server/db/**", None, None),
]


def dead_code(symbols: DataFrame, files: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """Symbols that nothing calls, in four buckets of at most ``most`` each.

    symbols: node, name, kind, path, visibility; edges: src, dst, kind ("calls" between symbols, "imports" between
    files, whose node is found in files: node, path)."""
    fan_in = edges.filter("kind = 'imports'").groupBy(F.col("dst").alias("node")).count().join(files, "node").select("path", F.col("count").alias("fan_in"))
    called = edges.filter("kind = 'calls'").select(F.col("dst").alias("node")).distinct()
    rows = symbols.filter(~F.col("kind").isin("file", "test", "module") & ~F.coalesce(paths.is_config_or_doc(F.col("path")), F.lit(False)) & paths.entrypoint(F.col("path")).isNull())
    rows = rows.join(called, "node", "left_anti").join(fan_in, "path", "left")
    bucket = F.when(paths.is_public(F.col("visibility")), "public_api_risk").when(F.coalesce("fan_in", F.lit(0)) == 0, "high").when(F.col("kind").isin("function", "method"), "medium").otherwise("low")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("path", "name", "node"))
    return rows.withColumn("bucket", bucket).withColumn("place", place).filter(F.col("place") <= most).select("bucket", "place", "node", "name", "path")


def suggested_tests(files: DataFrame, symbols: DataFrame, edges: DataFrame, targets: DataFrame, limit: int = 20) -> DataFrame:
    """Test files by how likely they cover the target files (column path).

    files: node, path; symbols: node, name, kind, path; edges: src, dst, kind."""
    goal = targets.select("path").distinct().join(files, "path").select("path", "node")
    syms = symbols.join(goal.select("path"), "path", "left_semi")
    goal_syms = syms.filter("kind != 'test'")
    tests = symbols.filter("kind = 'test'")
    has = tests.select("path").distinct().withColumn("has", F.lit(True))
    cand = files.join(has, "path", "left").filter(paths.is_test(F.col("path")) | F.coalesce("has", F.lit(False))).select("node", "path")
    direct = edges.filter("kind = 'imports'").select("src", "dst").distinct().join(goal.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("imports"))
    calls = edges.filter("kind = 'calls'").join(goal_syms.select(F.col("node").alias("dst")), "dst", "left_semi").join(tests.select(F.col("node").alias("src"), "name", "path"), "src").groupBy("path").agg(F.count("*").alias("calls"), F.array_sort(F.collect_set("name")).alias("names"))
    words = goal.select(F.explode(scoring.terms(F.col("path"))).alias("w")).union(goal_syms.select(F.explode(scoring.terms(F.col("name"))))).distinct()
    words = written(words, "words")
    # a word has letters and digits only, so a path holds it within a run of such, as one of the run's parts of its length:
    # runs are cut up once, however many paths have them, and meet the words by equality
    runs = cand.select("path").distinct().select("path", F.explode(F.array_distinct(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"))).alias("run"))
    sizes = words.agg(F.collect_set(F.length("w")).alias("sizes"))
    cut = runs.select("run").distinct().crossJoin(F.broadcast(sizes)).select("run", F.explode(F.filter("sizes", lambda n: n <= F.length("run"))).alias("n"))
    cut = cut.select("run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("n") + 1), lambda k: F.substring("run", k, F.col("n"))))).alias("w"))
    over = runs.join(cut.join(words, "w"), "run").select("path", "w").distinct().groupBy("path").agg(F.count("*").alias("overlap"))
    mods = goal.select(paths.module(F.col("path")).alias("module")).distinct().withColumn("same", F.lit(1.5))
    rows = cand.join(direct, "node", "left").join(calls, "path", "left").join(over, "path", "left").withColumn("module", paths.module(F.col("path"))).join(mods, "module", "left")
    zero = F.lit(0)
    score = F.when(F.col("imports") > 0, F.col("imports") + 4.0).otherwise(0.0) + F.when(F.col("calls") > 0, 6.0 + F.least("calls", F.lit(3))).otherwise(0.0) + 1.5 * F.coalesce("overlap", zero) + F.coalesce("same", F.lit(0.0))
    first = tests.groupBy("path").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 2).alias("some"))
    rows = rows.withColumn("score", score).filter("score > 0").join(first, "path", "left").withColumn("tests", F.coalesce(F.slice("names", 1, 3), "some"))
    command = paths.test_command(F.col("path"), F.get("tests", F.lit(0)))
    return rows.select("path", "score", scoring.test_confidence(F.col("score")).alias("confidence"), "tests", command.alias("command")).orderBy(F.desc("score"), "path").limit(limit)


def rule_violations(files: DataFrame, imports: DataFrame, rules=DEFAULT_RULES, by_loc: bool = False) -> DataFrame:
    """(rule, severity, path, target) of broken rules. files: path, size_bytes, loc; imports: src_path, dst_path.

    A rule is a pair of regular expressions folded into one pass over the edges, so there is no join with the rules."""
    lines = F.col("loc") if by_loc else F.floor(F.col("size_bytes") / 40)
    by_file, by_edge = [], []
    for name, severity, source, target, path, most in rules:
        tag = lambda: F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))  # noqa: E731, B023
        if source and target and (a := paths.glob_regex(source)) and (b := paths.glob_regex(target)):
            by_edge.append(F.when(F.col("src_path").rlike(a) & F.col("dst_path").rlike(b), tag()))
        if most is not None:
            by_file.append(F.when(lines > most, tag()))
        if path and (a := paths.glob_regex(path)):
            by_file.append(F.when(F.col("path").rlike(a), tag()))
    pick = lambda found: F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("r")
    none = F.lit(None).cast("string")
    out = files.select("path", none.alias("target"), pick(by_file)) if by_file else files.select("path", none.alias("target"), F.lit(None).cast("struct<rule:string,severity:string>").alias("r")).limit(0)
    if by_edge:
        out = out.unionByName(imports.select(F.col("src_path").alias("path"), F.col("dst_path").alias("target"), pick(by_edge)))
    return out.select("r.rule", "r.severity", "path", "target")


def risk_reasons(changes: DataFrame, fan_in: DataFrame, impacted: int, flows: int, tests: int) -> DataFrame:
    """Distinct reasons (column reason). changes: path; fan_in: path, fan_in."""
    spark = changes.sparkSession
    fixed = [f"Wide blast radius: {impacted} indexed files are affected."] * (impacted > 20) + [f"{flows} entrypoint-like flow(s) are affected."] * (flows > 0)
    out = spark.createDataFrame([(r,) for r in fixed], "reason string")
    if not tests:
        out = out.union(changes.filter(~paths.is_test(F.col("path"))).limit(1).select(F.lit("Source files changed but no indexed test candidates were found.")))
    high = changes.join(fan_in, "path").filter("fan_in > 5").select(F.format_string("%s has high fan-in: %d dependents.", "path", "fan_in"))
    risky = changes.filter(paths.is_risky(F.col("path"))).select(F.format_string("%s touches a high-risk path or concern.", "path"))
    return out.union(high).union(risky).distinct()


def flows(nodes: DataFrame, traced: DataFrame, changed: DataFrame, calls: DataFrame) -> DataFrame:
    """Reasons, risk and confidence of traced flows (entry, path of nodes): nodes: node, path; changed: path."""
    entry = nodes.select(F.col("node").cast("string").alias("entry"), paths.entrypoint(F.col("path")).alias("kind"))
    steps = traced.select("entry", "path", F.posexplode("path").alias("k", "node"))
    hit = steps.join(nodes.select(F.col("node").cast("string").alias("node"), F.col("path").alias("file")), "node").join(changed.select(F.col("path").alias("file")).distinct().withColumn("hit", F.lit(1)), "file", "left")
    touched = hit.groupBy("entry").agg(F.count("hit").alias("changed_steps"), F.max(F.when(F.col("hit") == 1, F.col("k"))).alias("last"))
    pair = traced.select("entry", F.explode(F.arrays_zip(F.slice("path", 1, 1_000_000).alias("a"), F.expr("slice(path, 2, 1000000)").alias("b"))).alias("p")).select("entry", "p.a", "p.b")
    linked = pair.join(calls.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b")).distinct(), ["a", "b"], "left_semi").select("entry").distinct().withColumn("by_call", F.lit(True))
    rows = traced.join(entry, "entry").join(touched, "entry").join(linked, "entry", "left")
    confidence = F.when(F.coalesce("by_call", F.lit(False)) & (F.size("path") <= 2), "high").when(F.coalesce("by_call", F.lit(False)), "medium").otherwise("low")
    risk = F.when(F.col("changed_steps") > 0, "high").otherwise("medium")
    return rows.select("entry", "kind", "path", confidence.alias("confidence"), risk.alias("risk")).orderBy(F.desc(F.size("path")), "entry")


def context_pack(files: DataFrame, symbols: DataFrame, imports: DataFrame, task: str, budget: int = 4000, max_files: int = 30, per_file: int = 8, backend: bool = False) -> DataFrame:
    """Files worth reading for a task, with their best symbols, dependencies and importers, within the budget."""
    words = scoring.keywords(task)
    count = min(max(budget // 750, 4), max_files)
    best = files.select("path", scoring.file_relevance(F.col("path"), words, backend).alias("score")).filter("score > 0").orderBy(F.desc("score"), "path").limit(count)
    near = symbols.join(F.broadcast(best.select("path")), "path")
    value = scoring.symbol_relevance(F.col("name"), F.col("signature"), F.col("kind"), words)
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("value"), "name"))
    label = F.concat(F.col("name"), F.lit(" L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.coalesce(F.concat(F.lit(" - "), "signature"), F.lit("")))
    syms = near.withColumn("value", value).withColumn("place", place).groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("place") <= per_file, F.struct("place", label.alias("label"))))).alias("s"), F.greatest(F.count("*") - per_file, F.lit(0)).alias("omitted"))
    chains = lookup.chains(imports.join(F.broadcast(best.select(F.col("path").alias("src_path"))), "src_path", "left_semi"))
    rdeps = imports.groupBy(F.col("dst_path").alias("path")).agg(F.array_sort(F.collect_set("src_path")).alias("importers"))
    rows = best.join(syms, "path", "left").join(chains, "path", "left").join(rdeps, "path", "left")
    return rows.select("path", "score", F.transform("s", lambda x: x["label"]).alias("symbols"), F.coalesce("omitted", F.lit(0)).alias("omitted"), "dependency_chain", "importers").orderBy(F.desc("score"), "path")


def confidence(found: int) -> str:
    return "low" if not found else "medium" if found < 3 else "high"
