"""Relational queries: filters, counts, roll-ups, top k, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, scoring
from ..operators import extract, lookup
from ..sources import repo, sinks
from ..sources.tables import FILES, files, read
from ..streaming import watch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query(f"select language, cast(count(*) as bigint) as files from ({FILES}) where language <> '' group by 1")
def file_language_stats(spark: SparkSession, d: str) -> DataFrame:
    return lookup.language_stats(files(spark, d))


@query(f"select source as module, cast(count(*) as bigint) as files, cast(sum(loc) as bigint) as loc from ({FILES}) group by 1")
def module_rollup(spark, d):
    return lookup.modules(files(spark, d))


@query("""select (select count(*) from documents) as files, (select count(*) from orders) as symbols, (select count(*) from lineitem) as call_sites,
  (select count(*) from nation) as edges""")
def graph_counts(spark, d):
    n = lambda t: read(spark, d, t)
    return lookup.counts(files=n("documents"), symbols=n("orders"), call_sites=n("lineitem"), edges=n("nation"))


@query(f"select path, language, size_bytes from ({FILES}) where language = 'en' and starts_with(path, 'src1') order by path limit 200")
def list_files_filtered(spark, d):
    return lookup.list_files(files(spark, d), "en", "src1").select("path", "language", "size_bytes")


@query("""select c_name as path, o_orderkey as symbol_id, o_orderpriority as kind from orders join customer on o_custkey = c_custkey
  where o_orderpriority = '1-URGENT' order by c_name, o_orderkey limit 300""")
def list_symbols_filtered(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    symbols = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_name").alias("path"), F.col("o_orderkey").alias("symbol_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("start_line"), F.lit("").alias("name"))
    return lookup.list_symbols(symbols, kind="1-URGENT").select("path", "symbol_id", "kind")


@query("select p_partkey as node, p_name as name, p_brand as path from part where contains(lower(p_name), '1') or contains(lower(p_brand), '1')")
def selector_substring(spark, d):
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"))
    return lookup.select_nodes(nodes, "1")


@query("select o_orderkey as node, case o_orderstatus when 'O' then 'pub' when 'F' then 'export' else 'private' end as visibility from orders where o_orderstatus in ('O', 'F')")
def public_api_filter(spark, d):
    vis = F.when(F.col("o_orderstatus") == "O", "pub").when(F.col("o_orderstatus") == "F", "export").otherwise("private")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("node"), vis.alias("visibility")).filter(paths.is_public(F.col("visibility")))


@query("""select page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) as path,
  contains(lower(url), 'test') or contains(lower(url), 'spec') as is_test,
  regexp_matches(lower(url), '(\\.(json|md|toml|ya?ml)$)|config') as is_config,
  regexp_matches(lower(url), 'api|auth|billing|config|database|db|env|migration|payment|permission|route|schema|security|session|stripe') as is_risky from pages""")
def path_classifier(spark, d):
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", F.regexp_extract(url, "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"), paths.is_test(url).alias("is_test"), paths.is_config_or_doc(url).alias("is_config"), paths.is_risky(url).alias("is_risky"))


_KINDS = [("middleware.ts", "nextjs_middleware"), ("route.tsx", "nextjs_api_route"), ("layout.jsx", "nextjs_layout"), ("page.ts", "nextjs_page"), ("action_x.js", "server_action"), ("src/main.rs", "rust_binary"), ("routes/a.rs", "rust_route_module"), ("views.py", "python_route"), ("task_x.py", "python_task"), ("worker.go", "worker_or_consumer"), ("spec_x.rb", "test_flow"), ("plain.c", None)]


@query("select doc_id, kind from (select doc_id, case doc_id % 12 " + " ".join(f"when {k} then " + (f"'{v}'" if v else "null") for k, (_, v) in enumerate(_KINDS)) + " end as kind from documents)")
def entrypoint_kind(spark, d):
    name = F.get(F.array(*[F.lit(n) for n, _ in _KINDS]), (F.col("doc_id") % 12).cast("int"))
    return read(spark, d, "documents").select("doc_id", paths.entrypoint(F.concat(F.lit("x/"), name)).alias("kind"))


@query(f"select file_id, path from ({FILES}) where not (starts_with(path, 'src1/') or path = 'src1' or starts_with(path, 'src2') or ends_with(path, '7'))")
def ignore_filter(spark, d):
    keep = ~paths.ignored(F.col("path"), ["src1/", "src2*/", "*7"])
    return files(spark, d).filter(keep).select("file_id", "path")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines as edges from their orders to their parts."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


@query("""select l_partkey as node, cast(count(*) as bigint) as fan_in from lineitem group by 1 order by fan_in desc, node limit 10""")
def fan_in_top10(spark, d):
    return lookup.top_degrees(lookup.fan_in(_lines(spark, d)))


@query("select l_orderkey as node, cast(count(*) as bigint) as fan_out from lineitem group by 1 order by fan_out desc, node limit 10")
def fan_out_top10(spark, d):
    return lookup.top_degrees(lookup.fan_out(_lines(spark, d)))


@query("""select l_suppkey as node, cast(count(*) as bigint) as fan_in, cast(count(distinct l_partkey) as bigint) as parts from lineitem group by 1 having count(*) > 5""")
def degree_having(spark, d):
    edges = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("dst"), F.col("l_partkey").alias("part"))
    return lookup.fan_in(edges, "part").filter("fan_in > 5")


@query("""select p_partkey as node, cast(count(l_partkey) as bigint) as incoming, cast(count(l_partkey) filter (where l_returnflag = 'R') as bigint) as returned
  from part left join lineitem on p_partkey = l_partkey group by 1""")
def reference_count(spark, d):
    edges = read(spark, d, "lineitem").select(F.col("l_partkey").alias("dst"), (F.col("l_returnflag") == "R").alias("returned"))
    return lookup.references(read(spark, d, "part").select(F.col("p_partkey").alias("node")), edges, "returned")


@query("""select distinct l_partkey as dst from lineitem join orders on l_orderkey = o_orderkey where o_custkey = 7""")
def deps_distinct(spark, d):
    nodes = read(spark, d, "orders").filter("o_custkey = 7").select(F.col("o_orderkey").alias("node"))
    return lookup.dependencies(_lines(spark, d), nodes)


@query("select distinct o_custkey as src from orders join lineitem on l_orderkey = o_orderkey where l_partkey = 11")
def rdeps_distinct(spark, d):
    edges = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))
    return lookup.dependents(edges, spark.createDataFrame([(11,)], "node long"))


@query("select l.doc_id, d.source from labels l join documents d on l.doc_id = d.doc_id where l.toxic = 1 and d.lang = 'en'")
def semi_changed(spark, d):
    docs, lab = read(spark, d, "documents"), read(spark, d, "labels").filter("toxic = 1")
    return lab.join(docs.filter("lang = 'en'").select("doc_id", "source"), "doc_id").select("doc_id", "source")


@query("select vec_id as node, label as kind from embeddings where vec_id in (select doc_id from documents where doc_id % 3 <> 0)")
def prune_orphans(spark, d):
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("kind"))
    return sinks.prune(vectors, read(spark, d, "documents").filter("doc_id % 3 != 0").select(F.col("doc_id").alias("node")))


@query("select doc_id from documents except select doc_id from labels")
def stale_except(spark, d):
    path = lambda t: read(spark, d, t).select(F.col("doc_id").alias("path"))
    return watch.vanished(path("labels"), path("documents")).select(F.col("path").alias("doc_id"))


@query("select doc_id from labels where toxic = 1 union select doc_id from labels where quality = 0")
def change_union(spark, d):
    lab = read(spark, d, "labels").withColumn("path", F.concat(F.lit("./d"), F.col("doc_id").cast("string")))
    both = repo.union_of(lab.filter("toxic = 1"), lab.filter("quality = 0"))
    return both.select(F.expr("cast(substring(path, 2) as bigint)").alias("doc_id"))


@query("select doc_id from labels where toxic = 1 intersect select doc_id from documents where source = 'src0'")
def change_intersect(spark, d):
    return read(spark, d, "labels").filter("toxic = 1").select("doc_id").intersect(read(spark, d, "documents").filter("source = 'src0'").select("doc_id"))


@query("""select o_orderkey as path, cast(coalesce(added, 0) as bigint) as lines_added, cast(coalesce(deleted, 0) as bigint) as lines_deleted from orders left join
  (select l_orderkey, count(*) filter (where l_returnflag = 'N') as added, count(*) filter (where l_returnflag = 'R') as deleted from lineitem group by 1) on o_orderkey = l_orderkey""")
def numstat_left_join(spark, d):
    stat = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.count_if(F.col("l_returnflag") == "N").alias("lines_added"), F.count_if(F.col("l_returnflag") == "R").alias("lines_deleted"))
    return repo.with_sizes(read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.lit("M").alias("status")), stat).drop("status")


@query("""select doc_id as file_id, n_chars as size, 'new' as version from documents where doc_id in (select doc_id from labels)
  union all select doc_id, n_chars + 1, 'old' from documents where doc_id not in (select doc_id from labels)""")
def upsert_merge(spark, d):
    row = lambda df, size, version: df.select(F.col("doc_id").alias("file_id"), size.alias("size"), F.lit(version).alias("version"))
    docs = read(spark, d, "documents")
    new = row(docs.join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), F.col("n_chars"), "new")
    return sinks.upsert(row(docs, F.col("n_chars") + 1, "old"), new, ["file_id"])


@query("""select l_partkey as path, l_suppkey as owner, cast(n as bigint) as commits from (select l_partkey, l_suppkey, count(*) n,
  row_number() over (partition by l_partkey order by count(*) desc, l_suppkey) r from lineitem group by 1, 2) where r = 1""")
def owner_top1(spark, d):
    commits = read(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author"))
    return repo.owners(commits)


@query("select user_id as path, cast(count(*) as bigint) as churn from events where event_type in ('purchase', 'signup') group by 1")
def churn_count(spark, d):
    status = F.when(F.col("event_type") == "purchase", "A").when(F.col("event_type") == "signup", "M").otherwise("D")
    return repo.churn(read(spark, d, "events").select(F.col("user_id").alias("path"), status.alias("status")))


@query("select event_id, list_sort(list_transform(json_keys(props), lambda k: k))[1] as first_key, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_list_decode(spark, d):
    keys = F.array_sort(F.json_object_keys("props"))
    return read(spark, d, "events").select("event_id", F.get(keys, F.lit(0)).alias("first_key"), F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))


@query("""select page_id, link, cast(count(*) as bigint) as n from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages) group by 1, 2""")
def html_links(spark, d):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return read(spark, d, "pages").select("page_id", links.alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("""select page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as url from pages""")
def escape_xml(spark, d):
    return read(spark, d, "pages").select("page_id", scoring.escape_xml(F.col("url")).alias("url"))


@query("""select doc_id::varchar as path, 'f' || doc_id as caller, 'g' || doc_id % 7 as callee, cast(2 as integer) as line, 0.8::double as confidence from documents
  union all select doc_id::varchar, 'f' || doc_id, 'k' || doc_id % 5, 3, case when doc_id % 3 = 1 then 0.9 else 0.8 end::double from documents""")
def extract_calls(spark, d):
    k = F.col("doc_id").cast("string")
    of = lambda m: (F.col("doc_id") % m).cast("string")
    python = F.concat(F.lit("def f"), k, F.lit("():\n    g"), of(7), F.lit("()\n    h.k"), of(5), F.lit("(1)\n"))
    rust = F.concat(F.lit("pub fn f"), k, F.lit("() {\n    g"), of(7), F.lit("();\n    h.k"), of(5), F.lit("(1);\n}\n"))
    script = F.concat(F.lit("function f"), k, F.lit("() {\n    g"), of(7), F.lit("();\n    h.k"), of(5), F.lit("(1);\n}\n"))
    which = F.col("doc_id") % 3
    sources = read(spark, d, "documents").select(k.alias("path"), F.when(which == 0, "python").when(which == 1, "rust").otherwise("typescript").alias("language"), F.when(which == 0, python).when(which == 1, rust).otherwise(script).alias("text"))
    return extract.call_sites(extract.extract(sources))


@query("""select source, doc_id, n_chars, cast(r as integer) as place from (select *, row_number() over (partition by source order by n_chars desc, doc_id) r from documents) where r <= 40""")
def bucket_top40(spark, d):
    rows = read(spark, d, "documents").select("source", "doc_id", "n_chars")
    return lookup.top_per(rows, ["source"], [F.desc("n_chars"), F.col("doc_id")], 40)


@query("select text_hash, min(doc_id) as doc_id, cast(count(*) as bigint) as copies from (select sha256(text) as text_hash, doc_id from documents) group by 1")
def first_wins_dedup(spark, d):
    return lookup.first_wins(read(spark, d, "documents"), F.sha2("text", 256), "doc_id").toDF("text_hash", "doc_id", "copies")


@query("""select c_custkey as path, cast(r as integer) as place, o_orderkey as symbol, score from (select c_custkey, o_orderkey, score,
  row_number() over (partition by c_custkey order by score desc, o_orderkey) r from (select c_custkey, o_orderkey,
  cast(case when contains(lower(o_orderpriority), 'urgent') then 2.0 else 0.0 end + case when contains(lower(o_orderpriority), 'high') then 1.0 else 0.0 end as double) as score
  from orders join customer on o_custkey = c_custkey)) where r <= 8""")
def symbols_ranked_per_file(spark, d):
    o = read(spark, d, "orders")
    score = scoring.hits(F.col("o_orderpriority"), ["urgent"], 2.0) + scoring.hits(F.col("o_orderpriority"), ["high"], 1.0)
    rows = o.join(read(spark, d, "customer").select("c_custkey"), o["o_custkey"] == F.col("c_custkey")).select(F.col("c_custkey").alias("path"), F.col("o_orderkey").alias("symbol"), score.alias("score"))
    return lookup.top_per(rows, ["path"], [F.desc("score"), F.col("symbol")], 8)


@query("""select key, cast(score as bigint) as score, case when score <= 24 then 'low' when score <= 59 then 'medium' when score <= 84 then 'high' else 'critical' end as level from
  (select o_orderkey as key, least(100, least(5 * c, 25) + least(q // 40, 20) + least(2 * p, 25) + least(8 * r, 20) + least(5 * s, 20)) as score from
  (select l_orderkey as o_orderkey, count(*) c, cast(sum(l_quantity) as bigint) q, count(distinct l_partkey) p, count(*) filter (where l_returnflag = 'R') r, count(distinct l_suppkey) s from lineitem group by 1))""")
def risk_score(spark, d):
    n = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("c"), F.sum("l_quantity").cast("long").alias("q"), F.count_distinct("l_partkey").alias("p"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_distinct("l_suppkey").alias("s"))
    score = scoring.risk_score(*[F.col(c) for c in "cqprs"])
    return n.select("key", score.alias("score"), scoring.risk_level(score).alias("level"))


@query("""select l_suppkey as node, round(0.30 * count(*) + 0.15 * count(distinct l_partkey) + 0.25 * count(distinct l_orderkey) + 0.20 * avg(l_quantity)
  + case when count(distinct l_partkey) > 10 then 0.10 else 0 end, 6) as risk from lineitem group by 1""")
def metrics_risk(spark, d):
    n = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("a"), F.count_distinct("l_partkey").alias("b"), F.count_distinct("l_orderkey").alias("c"), F.avg("l_quantity").alias("e"))
    return n.select("node", F.round(scoring.metrics_risk(F.col("a"), F.col("b"), F.col("c"), F.col("e"), F.col("b")), 6).alias("risk"))


@query(f"""select path, cast(1 as double) * case when contains(lower(path), 'src1') then 1.5 else 0 end + case when contains(lower(path), 'doc') then 1.5 else 0 end as score
  from ({FILES}) where contains(lower(path), 'src1') or contains(lower(path), 'doc') order by score desc, path limit 30""")
def keyword_relevance(spark, d):
    score = scoring.relevance(F.col("path"), F.col("path"), scoring.keywords("fix src1 in the doc"))
    return files(spark, d).select("path", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "path").limit(30)


@query("""select doc_id, cast(greatest(1, length(text) // 4) as bigint) as tokens from documents""")
def token_estimate(spark, d):
    return read(spark, d, "documents").select("doc_id", scoring.token_estimate(F.col("text")).alias("tokens"))


@query("""select source, lang, cast(count(*) as bigint) as n, cast(grouping_id(source, lang) as bigint) as level from documents group by cube(source, lang)""")
def language_cube(spark, d):
    return read(spark, d, "documents").cube("source", "lang").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
