"""From files to a code graph: parsing, resolution, nodes and edges, and the steps of incremental indexing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from . import extract, lookup, resolve


@dataclass
class Graph:
    """nodes: node, kind, name, path, language, start_line, end_line, signature, visibility; edges: src, dst, kind, confidence.

    A file's node is "file:<path>", a symbol's "symbol:<symbol_id>". Edges: contains (file to symbol), imports (file to
    file, one for each import), calls (symbol to symbol, one for each site, and file to file, distinct)."""

    nodes: DataFrame
    edges: DataFrame

    def of_kinds(self, *kinds: str) -> DataFrame:
        return self.edges.filter(F.col("kind").isin(*kinds))


def file_key(path) -> F.Column:
    return F.concat(F.lit("file:"), path)


def symbol_key(symbol) -> F.Column:
    return F.concat(F.lit("symbol:"), symbol.cast("string"))


def build(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame | None = None, file_calls: DataFrame | None = None) -> Graph:
    """Nodes and edges of the tables; edges with an end that is no node are left out.

    files: path, language; symbols: symbol_id, path, name, kind, start_line, end_line, signature, visibility (those of
    other files are left out); imports: src_path, dst_path; calls: src, dst (symbol ids), confidence; file_calls: src_path, dst_path."""
    none = F.lit(None)
    own = files.select(file_key(F.col("path")).alias("node"), F.lit("file").alias("kind"), F.col("path").alias("name"), "path", "language", none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), none.cast("string").alias("signature"), none.cast("string").alias("visibility"))
    held = symbols.join(files.select("path"), "path", "left_semi")
    parts = held.select(symbol_key(F.col("symbol_id")).alias("node"), lookup.node_kind(F.col("kind")).alias("kind"), "name", "path", none.cast("string").alias("language"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "signature", "visibility")
    nodes = own.unionByName(parts)
    edge = lambda a, b, kind, confidence=F.lit(1.0): [a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence")]
    # by key before the keys are made text: the ends are looked up once for each kind
    paths = files.select("path")
    ids = held.select("symbol_id")
    both = lambda df, ends, key: df.join(ends.withColumnRenamed(key, df.columns[0]), df.columns[0], "left_semi").join(ends.withColumnRenamed(key, df.columns[1]), df.columns[1], "left_semi")
    edges = held.select(*edge(file_key(F.col("path")), symbol_key(F.col("symbol_id")), "contains"))
    edges = edges.unionByName(both(imports.select("src_path", "dst_path"), paths, "path").select(*edge(file_key(F.col("src_path")), file_key(F.col("dst_path")), "imports")))
    if calls is not None:
        edges = edges.unionByName(both(calls.select("src", "dst", "confidence"), ids, "symbol_id").select(*edge(symbol_key(F.col("src")), symbol_key(F.col("dst")), "calls", F.col("confidence"))))
    if file_calls is not None:
        edges = edges.unionByName(both(file_calls.select("src_path", "dst_path"), paths, "path").select(*edge(file_key(F.col("src_path")), file_key(F.col("dst_path")), "calls")))
    return Graph(nodes, edges)


def symbol_ids(symbols: DataFrame) -> DataFrame:
    """A stable id for each symbol, from what tells it apart."""
    return symbols.withColumn("symbol_id", F.xxhash64("path", "name", "kind", "start_line", "end_line"))


def resolved(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Import and call edges of the tables files, symbols, imports and calls.

    All imports are resolved again, since a file that comes or goes can change what others mean."""
    imports = tables["imports"].withColumn("import_id", F.xxhash64("path", "target", "line"))
    edges = written(resolve.import_edges(imports.select("import_id", "path", "target").distinct(), tables["files"].select("path")), "import_edges")
    names = imports.select("import_id", F.coalesce("imported_names", F.array().cast("array<string>")).alias("names"))
    visible = edges.join(names, "import_id").select(F.col("src_path").alias("path"), "dst_path", "names").distinct()
    sites = tables["calls"].withColumn("site", F.xxhash64("path", "caller", "callee", "line"))
    calls, file_calls = resolve.call_edges(sites, tables["symbols"], visible)
    return {"import_edges": edges, "call_edges": calls.select("site", "src", "dst", "line", "confidence", "strategy"), "file_calls": file_calls}


def index(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of a set of files (path, language, hash, size_bytes, loc, text): each file is parsed once."""
    rows = written(extract.extract(files), "parsed")
    tables = {"files": files.drop("text"), "symbols": symbol_ids(extract.symbols(rows)), "imports": extract.imports(rows), "calls": extract.call_sites(rows)}
    return tables | resolved(tables)


def reindex(files: DataFrame, store: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables, report): the tables after the changed files were parsed and the vanished ones taken out; the report has
    the paths that were added, changed and removed. Only changed files are parsed, once."""
    seen = store["files"].select("path", F.col("hash").alias("was"))
    both = files.join(seen, "path", "left")
    new = written(both.filter(~F.col("hash").eqNullSafe(F.col("was"))), "changed")
    removed = seen.select("path").join(files.select("path"), "path", "left_anti")
    touched = removed.union(new.select("path"))
    rows = written(extract.extract(new), "parsed")
    fresh = {"files": new.select(*store["files"].columns), "symbols": symbol_ids(extract.symbols(rows)), "imports": extract.imports(rows), "calls": extract.call_sites(rows)}
    tables = {k: store[k].join(touched, "path", "left_anti").unionByName(fresh[k]) for k in fresh}
    report = {"added": new.filter("was is null").select("path"), "changed": new.filter("was is not null").select("path"), "removed": removed}
    return tables | resolved(tables), report


def graph(tables: dict[str, DataFrame]) -> Graph:
    return build(tables["files"], tables["symbols"], tables["import_edges"], tables["call_edges"], tables["file_calls"])


def flow_edges(g: Graph) -> DataFrame:
    """(src, dst, ord) along which flows are traced: from a file to its symbols, then to the files that it imports; from
    a symbol to those that it calls, then to the files that its own file imports."""
    into = g.of_kinds("contains").select("src", "dst", F.lit(0).alias("ord"))
    files = g.of_kinds("imports").select("src", "dst", F.lit(1).alias("ord"))
    calls = g.of_kinds("calls").filter(F.col("src").startswith("symbol:")).select("src", "dst", F.lit(0).alias("ord"))
    out = g.of_kinds("contains").select(F.col("src").alias("file"), F.col("dst").alias("symbol")).join(files.select(F.col("src").alias("file"), "dst").distinct(), "file").select(F.col("symbol").alias("src"), "dst", F.lit(1).alias("ord"))
    return into.unionByName(files).unionByName(calls).unionByName(out).distinct()
