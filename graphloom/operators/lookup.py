"""Lookups and counts over the tables of a code graph: files, symbols, imports, call sites, nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

#: Kinds of symbols that have another name as kinds of nodes; what isn't named at all is a "symbol".
NODE_KINDS = {"api_handler": "api_endpoint", "type": "interface"}
_SAME = "function method struct enum trait class interface component test hook module".split()


def node_kind(kind: Column) -> Column:
    """Kind of the node that stands for a symbol of that kind."""
    named = reduce(lambda w, kv: w.when(kind == kv[0], kv[1]), NODE_KINDS.items(), F.when(kind.isin(*_SAME), kind))
    return named.otherwise("symbol")


def summary(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", "kind", "name", "path", "start_line", "end_line")


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = [t.agg(F.count("*").alias(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def language_stats(files: DataFrame) -> DataFrame:
    return files.filter("language <> ''").groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language")


def modules(files: DataFrame) -> DataFrame:
    return files.groupBy(paths.module(F.col("path")).alias("module")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).orderBy(F.desc("files"), "module")


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def of_file(rows: DataFrame, path: str, *order: str) -> DataFrame:
    """Symbols (by start_line, name), imports (line, target) or call sites (line, callee) of one file."""
    rows = rows.filter(F.col("path") == path)
    return rows.orderBy(*order) if order else rows


def by_kind(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.filter(F.col("kind").isin(*kinds)).orderBy("kind", "src", "dst")


def vectors_of(vectors: DataFrame, backend: str, kind: str | None = None) -> DataFrame:
    rows = vectors.filter(F.col("backend") == backend)
    return rows.filter(F.col("kind") == kind) if kind else rows


def list_files(files: DataFrame, language: str | None = None, prefix: str | None = None, limit: int = 200) -> DataFrame:
    rows = files.filter(F.col("language") == language) if language else files
    rows = rows.filter(F.col("path").startswith(prefix)) if prefix else rows
    return rows.orderBy("path").limit(limit)


def list_symbols(symbols: DataFrame, path: str | None = None, kind: str | None = None, limit: int = 300) -> DataFrame:
    rows = symbols.filter(F.col("path") == path) if path else symbols
    rows = rows.filter(F.col("kind") == kind) if kind else rows
    return rows.orderBy("path", "start_line", "name").limit(limit)


def select_nodes(nodes: DataFrame, selector: str) -> DataFrame:
    """Nodes whose name or path contains the selector, without regard to case."""
    low = selector.lower()
    return nodes.filter(F.lower("name").contains(low) | F.lower("path").contains(low))


def nodes_by_name(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.filter(F.col("name").contains(part))


def file_node(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter((F.col("kind") == "file") & (F.col("path") == path))


def fan_in(edges: DataFrame, distinct: str | None = None) -> DataFrame:
    """Edges into each node; with ``distinct`` also how many values of that column they have."""
    more = [F.count_distinct(distinct).alias(f"{distinct}s")] if distinct else []
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"), *more)


def fan_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))


def top_degrees(degrees: DataFrame, limit: int = 10) -> DataFrame:
    """The nodes of the largest degree, then by node."""
    name = next(c for c in degrees.columns if c.startswith("fan_"))
    return degrees.filter(F.col(name) > 0).orderBy(F.desc(name), "node").limit(limit)


def references(nodes: DataFrame, edges: DataFrame, flag: str) -> DataFrame:
    """Of each node the edges into it, and those of them whose column ``flag`` is true."""
    refs = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.count_if(F.col(flag)).alias("f"))
    zero = F.lit(0).cast("long")
    return nodes.select("node").join(refs, "node", "left").select("node", F.coalesce("i", zero).alias("incoming"), F.coalesce("f", zero).alias(flag))


def dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct targets of the edges that leave the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select("dst").distinct()


def dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct sources of the edges that reach the nodes."""
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src").distinct()


def diff_impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes with an edge to a changed node (column node) that aren't changed themselves."""
    return dependents(edges, changed).select(F.col("src").alias("node")).join(changed.select("node"), "node", "left_anti")


def neighborhood(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each node the distinct targets and sources, ordered; an edge to itself counts as outgoing only."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    into = edges.filter("src != dst").groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("importers"))
    none = lambda c, like: F.coalesce(F.col(c), F.array().cast(like.schema[c].dataType)).alias(c)
    return nodes.select("node").join(out, "node", "left").join(into, "node", "left").select("node", none("imports", out), none("importers", into))


def explain_file(path: str, files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(section, place, value) of one file: its facts, its symbols, what it imports and what imports it, edge by edge."""
    facts = file_by_path(files, path).select(F.lit("file").alias("section"), F.lit(0).alias("place"), F.concat_ws(" ", "path", "language", F.col("size_bytes").cast("string"), F.col("loc").cast("string")).alias("value"))
    own = of_file(symbols, path).select(F.lit("symbol").alias("section"), F.col("start_line").alias("place"), F.concat_ws(" ", "kind", "name").alias("value"))
    deps = imports.filter(F.col("src_path") == path).select(F.lit("imports").alias("section"), F.lit(0).alias("place"), F.col("dst_path").alias("value"))
    rdeps = imports.filter(F.col("dst_path") == path).select(F.lit("imported_by").alias("section"), F.lit(0).alias("place"), F.col("src_path").alias("value"))
    return facts.unionByName(own).unionByName(deps).unionByName(rdeps)


def unique_names(symbols: DataFrame) -> DataFrame:
    """(name, symbol_id) of the names that a single symbol has."""
    rows = symbols.groupBy("name").agg(F.min("symbol_id").alias("symbol_id"), F.max("symbol_id").alias("last"))
    return rows.filter("symbol_id = last").select("name", "symbol_id")


def names_of(text: Column) -> Column:
    """A list of names kept as JSON; an empty list where it is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def first_wins(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """(key, first, copies): of rows of one key the least ``order``."""
    return rows.groupBy(key.alias("key")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def top_per(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key by a total order, numbered by place."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def chains(imports: DataFrame) -> DataFrame:
    """(path, dependency_chain): each file and its distinct direct dependencies in order, as one text."""
    deps = imports.groupBy(F.col("src_path").alias("path")).agg(F.array_sort(F.collect_set("dst_path")).alias("deps"))
    return deps.select("path", F.concat_ws(" -> ", F.array(F.col("path")), "deps").alias("dependency_chain"))
