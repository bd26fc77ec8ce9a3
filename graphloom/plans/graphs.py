"""Graph, resolution, search and review queries over graphs read from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from ..operators import graph, lookup, resolve, review, search
from ..sources import sinks
from ..sources.tables import FILES, PART_EDGES, files, part_edges, read
from .code import stored_index

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _seeds(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "node long")


EDGES = PART_EDGES


def _bfs_sql(a: str, b: str, depth: int, seeds: str) -> str:
    """Levels one by one, each distinct, so that paths don't multiply."""
    parts = [f"with e as materialized (select distinct {a} as a, {b} as b from ({EDGES})), l0 as (select node from (values {seeds}) t(node))"]
    for k in range(1, depth + 1):
        parts.append(f"l{k} as materialized (select distinct b as node from e join l{k - 1} on a = node)")
    union = " union all ".join(f"select node, {k} as depth from l{k}" for k in range(depth + 1))
    return ", ".join(parts) + f" select cast(node as bigint) as node, cast(min(depth) as integer) as depth from ({union}) group by 1"


@query(_bfs_sql("dst", "src", 2, "(1), (7), (100)"))
def reverse_bfs(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs(part_edges(spark, d), _seeds(spark, [1, 7, 100]), 2, reverse=True)


@query(_bfs_sql("src", "dst", 3, "(1), (42)"))
def reachable_forward(spark, d):
    return graph.bfs(part_edges(spark, d), _seeds(spark, [1, 42]), 3)


@query("select o_orderkey as node, min(o_orderkey) over (partition by o_custkey) as component from orders")
def components(spark, d):
    """Orders of one customer, each linked to the next by date: a component for each customer."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, d, "orders").select("o_orderkey", F.coalesce(F.lead("o_orderkey").over(order), "o_orderkey").alias("dst"))
    return graph.components(o.withColumnRenamed("o_orderkey", "src"))


@query("select node, component from (select o_orderkey as node, min(o_orderkey) over (partition by o_custkey) as component, count(*) over (partition by o_custkey) as n from orders) where n > 1")
def scc_cycles(spark, d):
    """Each customer's first order and the others point at each other, and all orders at their parts, which point at
    nothing: a cycle for each customer of two orders or more."""
    o = read(spark, d, "orders").select("o_orderkey", F.min("o_orderkey").over(Window.partitionBy("o_custkey")).alias("head")).filter("o_orderkey != head")
    parts = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"))
    return graph.cycles(o.select(F.col("head").alias("src"), F.col("o_orderkey").alias("dst")).union(o.select("o_orderkey", "head")).union(parts))


_CHAIN = """select 'r' || r_regionkey as src, 'n' || n_nationkey as dst from region join nation on n_regionkey = r_regionkey
  union all select 'n' || n_nationkey, 'c' || c_custkey from nation join customer on c_nationkey = n_nationkey"""


@query(f"""with e as ({_CHAIN}) select a.src as entry, array_to_string([a.src, a.dst, min(b.dst)], '>') as path from
  (select src, min(dst) as dst from (select distinct x.src, x.dst from e x join e y on x.dst = y.src where y.dst in (select 'c' || c_custkey from customer where c_acctbal > 9000)) group by 1) a
  join e b on a.dst = b.src where b.dst in (select 'c' || c_custkey from customer where c_acctbal > 9000) group by a.src, a.dst""")
def shortest_trace(spark, d):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c = read(spark, d, "nation"), read(spark, d, "customer")
    e = n.select(k("r", "n_regionkey").alias("src"), k("n", "n_nationkey").alias("dst")).union(c.select(k("n", "c_nationkey"), k("c", "c_custkey")))
    goal = c.filter("c_acctbal > 9000").select(k("c", "c_custkey").alias("node"))
    entries = read(spark, d, "region").select(k("r", "r_regionkey").alias("node"))
    return graph.traces(e, entries, goal, 4).select("entry", F.array_join("path", ">").alias("path"))


def _rank_sql(rounds: int) -> str:
    parts = [f"""with e as materialized (select src, dst, count(*) / sum(count(*)) over (partition by src) as share from ({EDGES}) group by 1, 2),
      v as materialized (select p_partkey as node from part), r0 as (select node, 1.0::double / (select count(*) from v) as s from v)"""]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        parts.append(f"""r{k} as materialized (select v.node, (0.15::double + 0.85::double * (select sum(s) from {p})) / (select count(*) from v) + 0.85::double * coalesce(g.got, 0) as s
          from v left join (select dst, sum({p}.s * e.share) as got from e join {p} on e.src = {p}.node group by 1) g on g.dst = v.node)""")
    return ", ".join(parts) + f" select node, round(s / (select max(s) from r{rounds}), 4) as score from r{rounds}"


@query(_rank_sql(20))
def rank20(spark, d):
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("node"))
    r = graph.rank(nodes, part_edges(spark, d))
    return r.crossJoin(r.agg(F.max("score").alias("top"))).select("node", F.round(F.col("score") / F.col("top"), 4).alias("score"))


def _nodes(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"))


def _edge_sql(incoming: bool) -> str:
    side = "dst" if incoming else "src"
    return f"""select src, dst, 'imports' as kind, cast(count(*) as bigint) as n from ({EDGES}) where {side} in
      (select p_partkey from part where contains(lower(p_name), 'red widget') or contains(lower(p_brand), 'red widget')) group by 1, 2"""


def _edge_query(spark, d, incoming):
    e = part_edges(spark, d).withColumn("kind", F.lit("imports"))
    return graph.edge_query(_nodes(spark, d), e, "red widget", incoming).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


@query(_edge_sql(True))
def edge_query_in(spark, d):
    return _edge_query(spark, d, True)


@query(_edge_sql(False))
def edge_query_out(spark, d):
    return _edge_query(spark, d, False)


@query(f"""with e as materialized ({EDGES}) select p_partkey as node, coalesce(o.imports, '') as imports, coalesce(i.importers, '') as importers from part
  left join (select src, array_to_string(list_sort(list(distinct dst)), ',') as imports from e group by 1) o on p_partkey = o.src
  left join (select dst, array_to_string(list_sort(list(distinct src)), ',') as importers from e where src <> dst group by 1) i on p_partkey = i.dst""")
def neighborhood(spark, d):
    rows = lookup.neighborhood(_nodes(spark, d), part_edges(spark, d))
    return rows.select("node", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("imports", "importers")])


@query(f"""select distinct src as node from ({EDGES}) where dst in (select p_partkey from part where p_size = 1) and src not in (select p_partkey from part where p_size = 1)""")
def diff_impact(spark, d):
    changed = read(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("node"))
    return lookup.diff_impact(part_edges(spark, d), changed)


@query(f"""with e as materialized ({EDGES}), f as (select dst, count(*) n from e group by 1) select bucket, cast(place as integer) as place, node from (
  select *, row_number() over (partition by bucket order by path, name, node) as place from (select o_orderkey as node, 'order ' || o_orderkey as name, 'part/' || o_custkey as path,
  case when o_orderstatus = 'O' then 'public_api_risk' when f.n is null then 'high' when o_orderpriority = '1-URGENT' then 'medium' else 'low' end as bucket
  from orders left join f on f.dst = o_custkey where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R'))) where place <= 40""")
def dead_code(spark, d):
    o = read(spark, d, "orders")
    path = F.concat(F.lit("part/"), F.col("o_custkey").cast("string"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "function").otherwise("struct")
    symbols = o.select(F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("node"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), kind.alias("kind"), path.alias("path"), F.when(F.col("o_orderstatus") == "O", "pub").alias("visibility"), "o_orderkey")
    owners = read(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("node"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"))
    imports = part_edges(spark, d).select(F.lit("x").alias("src"), F.concat(F.lit("f"), F.col("dst").cast("string")).alias("dst"), F.lit("imports").alias("kind"))
    calls = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.lit("x").alias("src"), F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("dst"), F.lit("calls").alias("kind"))
    return review.dead_code(symbols, owners, imports.union(calls)).select("bucket", "place", F.substring("node", 2, 30).cast("long").alias("node"))


@query("""select site, symbol from (select l.o_orderkey as site, c.c_custkey as symbol, row_number() over (partition by l.o_orderkey order by c.size, c.c_custkey) as r
  from orders l join (select c_custkey, c_nationkey, c_custkey % 50 as a, c_custkey % 50 + c_custkey % 37 as b, c_custkey % 37 as size from customer) c
  on l.o_custkey % 25 = c.c_nationkey and l.o_orderkey % 80 between c.a and c.b) where r = 1""")
def span_containment_min(spark, d):
    lines = read(spark, d, "orders").select((F.col("o_custkey") % 25).cast("int").alias("file"), F.col("o_orderkey").alias("site"), (F.col("o_orderkey") % 80).alias("line"))
    c = F.col("c_custkey")
    spans = read(spark, d, "customer").select(F.col("c_nationkey").alias("file"), c.alias("symbol"), (c % 50).alias("start_line"), (c % 50 + c % 37).alias("end_line"), c.alias("ord"))
    return resolve.enclosing(lines, spans, "site", "line")


_SITES = "select o_orderkey as site, o_custkey % 25 as path, 'n' || (o_orderkey % 97) as callee from orders"
_SYMS = "select s_suppkey as id, s_nationkey as path, 'n' || (s_suppkey % 97) as name from supplier"


@query(f"""with m as (select t.site, t.path, s.id, s.path as sp from ({_SITES}) t join ({_SYMS}) s on t.callee = s.name),
  own as (select site, min(id) as s from m where path = sp group by 1), far as (select * from m where site not in (select site from own)),
  uni as (select site, min(id) as s from far group by 1 having count(distinct id) = 1),
  imp as (select site, min(id) as s from far where site not in (select site from uni) and sp in (path + 1, path + 2) group by 1 having count(distinct id) = 1)
  select site, s as symbol_id, 'same_file' as strategy from own union all select site, s, 'unique_global' from uni union all select site, s, 'import_resolved' from imp""")
def callee_cascade(spark, d):
    name = lambda c: F.concat(F.lit("n"), (F.col(c) % 97).cast("string"))
    sites = read(spark, d, "orders").select(F.col("o_orderkey").alias("site"), (F.col("o_custkey") % 25).cast("int").alias("path"), name("o_orderkey").alias("callee"))
    syms = read(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol_id"), F.col("s_nationkey").alias("path"), name("s_suppkey").alias("name"), F.lit(1).alias("start_line"))
    see = read(spark, d, "nation").select(F.col("n_nationkey").alias("path"), F.explode(F.array(F.col("n_nationkey") + 1, F.col("n_nationkey") + 2)).alias("dst_path"), F.array().cast("array<string>").alias("names"))
    return resolve.callees(sites, syms, see)


@query("""select name, min(id) as symbol_id from (select p_partkey as id, p_name as name from part union all select s_suppkey, s_name from supplier) group by 1 having count(distinct id) = 1""")
def unique_global(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"))
    return lookup.unique_names(p.union(read(spark, d, "supplier").select("s_suppkey", "s_name")))


@query("""select o_orderkey as import_id, 'pkg' || (o_orderkey % 50) as src_path, case when (o_orderkey % 40) % 2 = 0 then 'src/m' || (o_orderkey % 40) || '.ts' else 'src/m' || (o_orderkey % 40) || '/index.ts' end as dst_path from orders""")
def candidate_path_rank(spark, d):
    m = F.col("o_orderkey") % 40
    imports = read(spark, d, "orders").select(F.col("o_orderkey").alias("import_id"), F.concat(F.lit("pkg"), (F.col("o_orderkey") % 50).cast("string")).alias("path"), F.concat(F.lit("@/m"), m.cast("string")).alias("target"))
    own = spark.range(40).select(F.when(F.col("id") % 2 == 0, F.format_string("src/m%d.ts", "id")).otherwise(F.format_string("src/m%d/index.ts", "id")).alias("path"))
    return resolve.import_edges(imports, own.union(own.select(F.regexp_replace("path", "ts$", "yml")).filter("path like '%index%'")))


_TOK = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
BM25_QUERY = "the thing is"


def _bm25_sql(limit: int) -> str:
    words = BM25_QUERY.split()
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as tf{k}" for k, w in enumerate(words))
    n = ", ".join(f"count(*) filter (where tf{k} > 0) as n{k}" for k in range(len(words)))
    part = " + ".join(f"greatest(ln((n - n{k} + 0.5::double) / (n{k} + 0.5::double)), 1e-6::double) * tf{k} * 2.2::double / (tf{k} + 1.2::double * (0.25::double + 0.75::double * len / mean))" for k in range(len(words)))
    return f"""with c as materialized (select doc_id, len(t) as len, {tf} from (select doc_id, {_TOK} as t from documents)), s as (select count(*) as n, avg(len) as mean, {n} from c)
      select doc_id, round({part}, 4) as score from c, s where {" and ".join(f"tf{k} > 0" for k in range(len(words)))} order by {part} desc, doc_id limit {limit}"""


@query(_bm25_sql(20))
def bm25_topk(spark, d):
    found = stored_index(spark, d).bm25(BM25_QUERY, 20)
    return found.select(F.col("key").alias("doc_id"), F.round("score", 4).alias("score"))


@query("""select p_partkey as node, cast(s as double) as score from (select p_partkey, case when contains(lower(p_name || ' ' || p_brand || ' ' || p_type || ' part'), 'brand part') then 5.0 else 0.0 end
  + case when contains(lower(p_name), 'brand') then 3.0 else 0.0 end + case when contains(lower(p_name), 'part') then 3.0 else 0.0 end
  + case when contains(lower(p_brand), 'brand') then 2.0 else 0.0 end + case when contains(lower(p_brand), 'part') then 2.0 else 0.0 end
  + case when contains(lower(p_type), 'brand') then 1.0 else 0.0 end + case when contains(lower(p_type), 'part') then 1.0 else 0.0 end as s from part) where s > 0 order by s desc, node limit 50""")
def substring_score(spark, d):
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_type").alias("signature"), F.lit("part").alias("kind"))
    return search.substring(nodes, "brand part", None, 50).select("node", "score")


_QUERY_VECTOR = [((k * 37) % 19 - 9) / 10 for k in range(64)]
_V = "[" + ", ".join(f"{x}" for x in _QUERY_VECTOR) + "]::double[]"


@query(f"""select vec_id as node, round(s, 4) as score from (select vec_id, list_dot_product(embedding::double[], {_V}) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product({_V}, {_V}))) as s from embeddings) order by s desc, vec_id limit 20""")
def cosine_topk(spark, d):
    return search.nearest(read(spark, d, "embeddings"), _QUERY_VECTOR, 20, "vec_id", "embedding").select(F.col("vec_id").alias("node"), F.round("score", 4).alias("score"))


_HASHED = """select item_id, b, sum(w) as w from (select item_id, tok, ('0x' || substr(sha256(tok), 1, 2))::integer % 64 as b,
  case when ('0x' || substr(sha256(tok), 3, 2))::integer % 2 = 0 then 1.0::double else -1.0::double end * (1 + ('0x' || substr(sha256(tok), 5, 2))::integer / 255.0::double) as w
  from (select item_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) as tok from benchmark)) group by 1, 2"""


@query(f"""with h as materialized ({_HASHED}), n as (select item_id, sqrt(sum(w * w)) as size from h group by 1)
  select item_id, cast(b as integer) as bucket, round(w / size, 4) as value from h join n using (item_id) where abs(w) > 1e-9""")
def hash_embedding(spark, d):
    v = search.hash_embedding(read(spark, d, "benchmark"), "item_id", "text")
    return v.select("item_id", F.posexplode("vector").alias("bucket", "value")).filter("abs(value) > 1e-11").select("item_id", "bucket", F.round("value", 4).alias("value"))


@query(f"""with lex as (select vec_id as node, cast(1 + vec_id % 7 as double) as s from embeddings where label = 0), rnk as (select vec_id as node, vec_id / 1000.0::double as s from embeddings),
  x as (select e.vec_id as node, 0.45::double * coalesce(lex.s, 0) / greatest((select max(s) from lex), 1) + 0.45::double * greatest(0, list_dot_product(embedding::double[], {_V}) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product({_V}, {_V}))))
  + 0.10::double * rnk.s / greatest((select max(s) from rnk), 1) + case label % 3 when 0 then 0.05::double when 1 then 0.0::double else 0.02::double end as s
  from embeddings e left join lex on e.vec_id = lex.node left join rnk on e.vec_id = rnk.node) select node, round(s, 4) as score from x order by s desc, 'v' || node limit 20""")
def hybrid_topk(spark, d):
    e = read(spark, d, "embeddings")
    kind = F.when(F.col("label") % 3 == 0, "function").when(F.col("label") % 3 == 1, "file").otherwise("struct")
    vec = e.select(F.col("vec_id").alias("node"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), kind.alias("kind"), F.col("embedding").alias("vector"))
    lex = e.filter("label = 0").select(F.col("vec_id").alias("node"), (1.0 + F.col("vec_id") % 7).alias("score"))
    ranks = e.select(F.col("vec_id").alias("node"), (F.col("vec_id") / 1000.0).alias("score"))
    return search.hybrid(vec, lex, ranks, _QUERY_VECTOR, 20).select("node", F.round("score", 4).alias("score"))


@query("""with f as (select p_partkey as node, case when p_partkey % 10 = 0 then 'test_' else 'mod' end || (p_partkey % 7) || '/x' || p_partkey as path from part),
  goal as (select * from f where node in (11, 12, 13)), c as (select * from f where contains(path, 'test')),
  im as (select src as node, count(*) n from (select distinct src, dst from (""" + EDGES + """)) where dst in (11, 12, 13) group by 1),
  w as (select distinct unnest(list_filter(string_split_regex(path, '[^a-z0-9]+'), lambda x: strlen(x) > 2)) as w from goal),
  o as (select c.path, count(*) n from c join w on contains(c.path, w.w) group by 1)
  select c.path, cast(case when im.n > 0 then 4 + im.n else 0 end + 1.5 * coalesce(o.n, 0) as double) as score from c left join im using (node) left join o using (path)
  where case when im.n > 0 then 4 + im.n else 0 end + 1.5 * coalesce(o.n, 0) > 0 order by score desc, path limit 20""")
def suggested_tests_score(spark, d):
    k = F.col("p_partkey")
    fs = read(spark, d, "part").select(k.alias("node"), F.concat(F.when(k % 10 == 0, "test_").otherwise("mod"), (k % 7).cast("string"), F.lit("/x"), k.cast("string")).alias("path"))
    none = spark.createDataFrame([], "node long, name string, kind string, path string")
    goal = fs.filter(F.col("node").isin(11, 12, 13)).select("path")
    return review.suggested_tests(fs, none, part_edges(spark, d).withColumn("kind", F.lit("imports")), goal).select("path", "score")


_RULES = [("no-10-to-2", "error", "Brand#1*", "Brand#2*", None, None), ("no-s", "warning", "*#[35]?", "*1", None, None)]


@query(f"""with x as (select a.p_brand as path, b.p_brand as target from ({EDGES}) e join part a on e.src = a.p_partkey join part b on e.dst = b.p_partkey)
  select rule, severity, path, target, cast(count(*) as bigint) as n from (select 'no-10-to-2' as rule, 'error' as severity, path, target from x where path like 'Brand#1%' and target like 'Brand#2%'
  union all select 'no-s', 'warning', path, target from x where regexp_full_match(path, '.*#[35].') and target like '%1') group by all""")
def rule_glob_violations(spark, d):
    n = _nodes(spark, d)
    e = part_edges(spark, d).join(n.select(F.col("node").alias("src"), F.col("path").alias("src_path")), "src").join(n.select(F.col("node").alias("dst"), F.col("path").alias("dst_path")), "dst")
    none = spark.createDataFrame([], "path string, size_bytes long, loc long")
    return review.rule_violations(none, e, _RULES).groupBy("rule", "severity", "path", "target").agg(F.count("*").alias("n"))


@query(f"""select 'no-large-files' as rule, 'warning' as severity, path from ({FILES}) where size_bytes // 40 > 800""")
def max_lines_rule(spark, d):
    none = spark.createDataFrame([], "src_path string, dst_path string")
    return review.rule_violations(files(spark, d), none).select("rule", "severity", "path")


@query("""select 'part ' || p_partkey || ' touches a high-risk path or concern.' as reason from (select * from part where contains(lower(p_name), 'api') or p_partkey < 0)
  union select reason from (select p_partkey || ' has high fan-in: ' || count(*) || ' dependents.' as reason from part join lineitem on l_partkey = p_partkey where p_size = 1 group by p_partkey having count(*) > 5)
  union select '3 entrypoint-like flow(s) are affected.' union select 'Wide blast radius: 21 indexed files are affected.' union select 'Source files changed but no indexed test candidates were found.'""")
def risk_reasons(spark, d):
    changed = read(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").cast("string").alias("path"))
    fan = read(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("path")).agg(F.count("*").alias("fan_in"))
    return review.risk_reasons(changed, fan, 21, 3, 0)


@query(f"""select path, cast(s as double) as score from (select path, case when contains(path, 'src3') then 1.5 else 0 end + case when contains(path, 'doc') then 1.5 else 0 end as s from ({FILES})) where s > 0 order by s desc, path limit 5""")
def context_budget(spark, d):
    none = spark.createDataFrame([], "path string, name string, kind string, signature string, start_line int, end_line int")
    imports = spark.createDataFrame([], "src_path string, dst_path string")
    return review.context_pack(files(spark, d).select("path"), none, imports, "change src3 doc", budget=4000).select("path", "score")


@query("""select 'file:' || c_custkey as id, 'symbol:' || o_orderkey as target, 'contains' as kind, cast(1.0 as double) as confidence from customer join orders on o_custkey = c_custkey
  union all select 'symbol:' || l_orderkey, 'file:' || l_partkey, 'calls', 1 - l_discount from lineitem join customer on l_partkey = c_custkey""")
def export_nodes_edges(spark, d):
    key = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    c, o, li = read(spark, d, "customer"), read(spark, d, "orders"), read(spark, d, "lineitem")
    own = c.select(key("file", "c_custkey").alias("node"), F.col("c_name").alias("path"), F.lit("x").alias("language"))
    symbols = o.select(key("symbol", "o_orderkey").alias("node"), F.lit("s").alias("name"), F.lit("function").alias("kind"), F.lit("p").alias("path"))
    held = o.select(key("file", "o_custkey").alias("src"), key("symbol", "o_orderkey").alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    calls = li.select(key("symbol", "l_orderkey"), key("file", "l_partkey"), F.lit("calls"), 1 - F.col("l_discount"))
    _, edges = sinks.export_graph(own, symbols, held.union(calls))
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("target"), "kind", "confidence")
