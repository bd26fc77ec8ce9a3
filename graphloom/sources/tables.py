"""Code-graph tables read from the benchmark tables, so that every operator has input to run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path source/lang/doc_<id>."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("path"),
        F.col("lang").alias("language"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size_bytes"),
        F.size(F.split("text", "\n")).cast("long").alias("loc"), "source", "text",
    )


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the parts of neighbouring lines of an order, one for each pair of lines.

    Line numbers repeat, so the lines have a total order over five columns."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lines.withColumn("dst", F.lead("l_partkey").over(order)).filter("dst is not null").select(F.col("l_partkey").alias("src"), "dst")


#: The same edges in SQL.
PART_EDGES = """select src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey
  order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as dst from lineitem) where dst is not null"""
FILES = """select doc_id as file_id, source || '/' || lang || '/doc_' || doc_id as path, lang as language, sha256(text) as hash,
  cast(strlen(text) as bigint) as size_bytes, cast(len(string_split(text, chr(10))) as bigint) as loc, source, text from documents"""


_PATH = """case c_custkey % 10 when 0 then 'tests/c' || c_custkey || '_spec.rs' when 1 then 'src/bin/c' || c_custkey || '.rs'
  else 'crates/m' || (c_custkey % 7) || '/c' || c_custkey || '.rs' end"""
_KIND = "case substr(o_orderpriority, 1, 1) when '1' then 'function' when '2' then 'test' when '3' then 'method' when '4' then 'struct' else 'type' end"
#: The code base that the tables make: customers are files, their orders the symbols, neighbouring parts of an order an
#: import of one customer's file by another's, lines calls of the order that has the part's number.
CODE = f"""with files as materialized (select c_custkey as id, {_PATH} as path, c_mktsegment as language, cast(c_custkey % 900 as bigint) as loc, cast(c_custkey % 900 * 40 as bigint) as size_bytes from customer),
  symbols as materialized (select o_orderkey as symbol_id, f.path, 'order_' || o_orderkey as name, {_KIND} as kind, o_orderkey % 50 * 10 as start_line, o_orderkey % 50 * 10 + 9 as end_line,
    'fn order_' || o_orderkey as signature, case o_orderstatus when 'O' then 'pub' when 'F' then 'private' end as visibility from orders join files f on f.id = o_custkey),
  imports as materialized (select a.path as src_path, b.path as dst_path from ({PART_EDGES}) e join files a on a.id = e.src join files b on b.id = e.dst),
  calls as materialized (select l_orderkey as src, l_partkey as dst, 1 - l_discount as confidence from lineitem join symbols a on a.symbol_id = l_orderkey join symbols b on b.symbol_id = l_partkey),
  nodes as materialized (select 'file:' || path as node, 'file' as kind, path as name, path from files union all
    select 'symbol:' || symbol_id, case kind when 'type' then 'interface' else kind end, name, path from symbols),
  edges as materialized (select 'file:' || path as src, 'symbol:' || symbol_id as dst, 'contains' as kind, 1.0::double as confidence from symbols
    union all select 'file:' || src_path, 'file:' || dst_path, 'imports', 1.0::double from imports
    union all select 'symbol:' || src, 'symbol:' || dst, 'calls', cast(confidence as double) from calls)"""


def code(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """files, symbols, imports and calls of that code base."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    files_ = c.select(F.col("c_custkey").alias("id"), F.expr(_PATH).alias("path"), F.col("c_mktsegment").alias("language"), (F.col("c_custkey") % 900).cast("long").alias("loc"), (F.col("c_custkey") % 900 * 40).cast("long").alias("size_bytes"))
    at = files_.select("id", "path")
    name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    line = F.col("o_orderkey") % 50 * 10
    symbols = o.join(at, o["o_custkey"] == at["id"]).select(
        F.col("o_orderkey").alias("symbol_id"), "path", name.alias("name"), F.expr(_KIND).alias("kind"), line.cast("int").alias("start_line"), (line + 9).cast("int").alias("end_line"),
        F.concat(F.lit("fn "), name).alias("signature"), F.expr("case o_orderstatus when 'O' then 'pub' when 'F' then 'private' end").alias("visibility"),
    )
    e = part_edges(spark, sf_dir)
    imports = e.join(at.select(F.col("id").alias("src"), F.col("path").alias("src_path")), "src").join(at.select(F.col("id").alias("dst"), F.col("path").alias("dst_path")), "dst").select("src_path", "dst_path")
    calls = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (1 - F.col("l_discount")).alias("confidence"))
    return {"files": files_, "symbols": symbols, "imports": imports, "calls": calls}
