"""Sinks: keyed merges of the graph's tables and exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import escape_xml


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace_by(old: DataFrame, new: DataFrame, key: str, touched: DataFrame) -> DataFrame:
    """All rows of the touched keys go, the new ones come, also where a key has none any more."""
    return new.unionByName(old.join(touched.select(key).distinct(), key, "left_anti"))


def cascade_delete(gone: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Rows without any reference (by the named columns) to the gone ids (column id)."""
    out = {}
    for name, (df, columns) in tables.items():
        for c in columns:
            df = df.join(gone.select(F.col("id").alias(c)), c, "left_anti").select(*df.columns)
        out[name] = df
    return out


def prune(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors whose node is still indexed."""
    return vectors.join(docs.select("node"), "node", "left_semi")


def missing_vectors(docs: DataFrame, vectors: DataFrame, backend: str) -> DataFrame:
    """Documents without a vector of their content: keyed by node and content hash, so changed texts are embedded again."""
    have = vectors.filter(F.col("backend") == backend).select("node", "hash")
    return docs.join(have, ["node", "hash"], "left_anti")


def export_graph(files: DataFrame, symbols: DataFrame | None, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) whose both ends are nodes. files: node, path, language; symbols: node, name, kind, path."""
    none = F.lit(None).cast("string")
    nodes = files.select("node", F.col("path").alias("label"), F.lit("file").alias("kind"), "path", "language")
    if symbols is not None:
        nodes = nodes.unionByName(symbols.select("node", F.col("name").alias("label"), "kind", "path", none.alias("language")))
    keep = nodes.select("node")
    kept = edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, kept.select("src", "dst", "kind", "confidence")


def first_files(files: DataFrame, edges: DataFrame, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The first files by path and the edges between them."""
    few = files.orderBy("path").limit(limit)
    return few, edges.join(few.select(F.col("node").alias("src")), "src", "left_semi").join(few.select(F.col("node").alias("dst")), "dst", "left_semi")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML document (column value, order by part and value)."""
    e = lambda c: escape_xml(F.col(c))
    n = nodes.select(F.lit(1).alias("part"), F.format_string('<node id="%s"><data key="label">%s</data><data key="kind">%s</data></node>', e("node"), e("label"), e("kind")).alias("value"))
    m = edges.select(F.lit(2).alias("part"), F.format_string('<edge source="%s" target="%s"><data key="kind">%s</data></edge>', e("src"), e("dst"), e("kind")).alias("value"))
    head, tail = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">', "</graph></graphml>"
    ends = nodes.sparkSession.createDataFrame([(0, head), (3, tail)], "part int, value string")
    return n.union(m).union(ends)


def html_rows(nodes: DataFrame, limit: int = 1000) -> DataFrame:
    row = F.format_string("<tr><td>%s</td><td>%s</td><td>%s</td></tr>", escape_xml(F.col("node")), escape_xml(F.col("kind")), escape_xml(F.col("label")))
    return nodes.orderBy("node").limit(limit).select(row.alias("value"))


def json_document(**parts: DataFrame) -> DataFrame:
    """One row (column value) with an array for each part; for reports, whose parts are bounded."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias(name))
        out = row if out is None else out.crossJoin(row)
    fields = [F.concat(F.lit(json.dumps(name) + ":"), F.col(name)) for name in parts]
    return out.select(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("value"))


def markdown(title: str, sections: dict[str, list[str]]) -> str:
    """A report with a heading and a list for each section that has entries."""
    body = [f"## {name}\n\n" + "\n".join(f"- {x}" for x in rows) for name, rows in sections.items() if rows]
    return f"# {title}\n\n" + "\n\n".join(body) + "\n"


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("__k = 1").drop("__k")


def without(edges: DataFrame, kind: str, sources: DataFrame | None = None) -> DataFrame:
    """Edges but those of a kind, or those of it that leave the sources (column src)."""
    if sources is None:
        return edges.filter(F.col("kind") != kind)
    gone = sources.select("src", F.lit(kind).alias("kind")).distinct()
    return edges.join(gone, ["src", "kind"], "left_anti").select(*edges.columns)
