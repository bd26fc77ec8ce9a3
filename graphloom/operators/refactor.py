"""Refactoring reports: modules of a large file, references of a name, public symbols that a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import graph

_PLAIN = ("get", "main", "new", "set", "test")


def prefix(name: Column) -> Column:
    """First run of letters and digits, lower-cased; null for the words that say nothing."""
    first = F.lower(F.regexp_extract(name, "[A-Za-z0-9]+", 0))
    return F.when(first.isin(*_PLAIN) | (first == ""), F.lit(None)).otherwise(first)


def split_modules(symbols: DataFrame, calls: DataFrame, path: str) -> DataFrame:
    """Parts that a file could be split into: its symbols, connected by calls between them and by a common prefix.

    symbols: node, name, kind, path, visibility; calls: src, dst. A part is named after the prefix that most of
    its symbols (two at least, the last of equals) share, else after its first symbol."""
    own = symbols.filter((F.col("path") == path) & ~F.col("kind").isin("file", "module", "test")).withColumn("prefix", prefix(F.col("name")))
    ids = own.select("node")
    inner = calls.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    head = own.filter("prefix is not null").groupBy("prefix").agg(F.min("node").alias("src"))
    star = own.join(head, "prefix").select("src", F.col("node").alias("dst"))
    part = graph.components(inner.union(star).union(ids.select("node", "node")))
    rows = own.join(part, "node")
    size = rows.groupBy("component").agg(F.count("*").alias("symbol_count"), F.count_if(paths.is_public(F.col("visibility"))).alias("exports"), F.array_sort(F.collect_list("name")).alias("names"), F.min(F.struct("node", "name")).alias("first"))
    named = rows.filter("prefix is not null").groupBy("component", "prefix").count().filter("count > 1").groupBy("component").agg(F.max_by("prefix", F.struct("count", "prefix")).alias("name"))
    at = part.select(F.col("node").alias("n"), "component")
    inside = inner.join(at, inner["src"] == at["n"]).groupBy("component").agg(F.count("*").alias("internal_edges"))
    callers = calls.join(ids.select(F.col("node").alias("src")), "src", "left_anti").join(at, F.col("dst") == at["n"]).groupBy("component").agg(F.count_distinct("src").alias("external_callers"))
    callees = calls.join(ids.select(F.col("node").alias("dst")), "dst", "left_anti").join(at, F.col("src") == at["n"]).groupBy("component").agg(F.count_distinct("dst").alias("external_callees"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = size.join(named, "component", "left").join(inside, "component", "left").join(callers, "component", "left").join(callees, "component", "left")
    out = out.select(F.coalesce("name", F.lower("first.name")).alias("module"), "symbol_count", "exports", "names", zero("internal_edges"), zero("external_callers"), zero("external_callees"))
    outside = F.col("external_callers") + F.col("external_callees")
    level = F.when((F.col("symbol_count") >= 3) & (F.col("internal_edges") >= outside), "high").when((F.col("symbol_count") >= 2) | (outside == 0), "medium").otherwise("low")
    order = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return out.withColumn("confidence", level).orderBy(order, F.desc("symbol_count"), "module")


def rename_references(nodes: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """For each symbol of the name: its callers, callees and the tests among its callers. nodes: node, name, kind, path."""
    match = nodes.filter((F.col("name") == name) & (F.col("kind") != "file"))
    label = nodes.select("node", F.concat_ws("::", "path", "name").alias("label"), F.col("kind").alias("k"))
    names = lambda df, side, other: df.join(label, df[other] == label["node"]).groupBy(df[side].alias("id")).agg(F.array_sort(F.collect_set("label")).alias("l"), F.count_if(F.col("k") == "test").alias("tests"))
    into, out = names(calls, "dst", "src"), names(calls, "src", "dst")
    none = F.array().cast("array<string>")
    rows = match.join(into.select(F.col("id").alias("node"), F.col("l").alias("callers"), "tests"), "node", "left").join(out.select(F.col("id").alias("node"), F.col("l").alias("callees")), "node", "left")
    return rows.select("node", "path", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"), F.coalesce("tests", F.lit(0)).alias("tests"))


def public_api_changes(symbols: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Public symbols of the changed files (column path) with how often they are referred to and by how many tests."""
    rows = symbols.join(changed.select("path").distinct(), "path", "left_semi").filter(paths.is_public(F.col("visibility")))
    tests = symbols.filter("kind = 'test'").select(F.col("node").alias("src"), F.lit(1).alias("t"))
    refs = edges.filter("kind in ('calls', 'imports', 'references', 'tests')").join(tests, "src", "left").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("r"), F.count("t").alias("n"))
    zero = F.lit(0).cast("long")
    return rows.join(refs, "node", "left").select("node", "name", "path", F.coalesce("r", zero).alias("references"), F.coalesce("n", zero).alias("tests")).orderBy("path", "name", "node")


def recall(expected: Column, text: Column) -> Column:
    """Share of the expected strings that the text holds, without regard to case and slashes; 1 for none expected."""
    plain = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    found = F.size(F.filter(expected, lambda x: plain(text).contains(plain(x))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(found / F.size(expected))


def duplicates(values: Column) -> Column:
    """How many values repeat an earlier one, without regard to case and slashes."""
    plain = F.transform(values, lambda x: F.lower(F.replace(x, F.lit("\\"), F.lit("/"))))
    return F.size(plain) - F.size(F.array_distinct(plain))


def task_score(files: Column, terms: Column, compact: Column, repeats: Column) -> Column:
    """2 file recall + 2 term recall + half the compactness - at most 0.75 for repeats."""
    return files * 2 + terms * 2 + compact * 0.5 - F.least(F.lit(0.75), repeats * 0.15)
