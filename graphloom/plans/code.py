"""Questions over the code base that the benchmark tables make (see sources.tables.CODE), answered by the engine's operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import outputs
from ..operators import ask, assemble, lookup, postings, refactor, resolve, review
from ..runtime import shared_dir
from ..sources import sinks
from ..sources.store import Store
from ..sources.tables import CODE, code, files, read
from ..streaming import watch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _graph(spark: SparkSession, d: str) -> assemble.Graph:
    t = code(spark, d)
    return assemble.build(t["files"], t["symbols"], t["imports"], t["calls"])


@query(f"{CODE} select src, dst, kind, round(confidence, 4) as confidence from edges")
def graph_assembly(spark, d):
    return _graph(spark, d).edges.select("src", "dst", "kind", F.round("confidence", 4).alias("confidence"))


@query(f"{CODE} select node, kind, name, path from nodes")
def graph_nodes(spark, d):
    return _graph(spark, d).nodes.select("node", "kind", "name", "path")


_SITES = """select o_orderkey as site, o_custkey % 25 as path, 'f' || (o_orderkey % 9) as caller, 'n' || (o_orderkey % 97) as callee, o_orderkey % 120 as line from orders"""
_OWN = "select s_suppkey as id, s_nationkey as path, case when s_suppkey % 3 = 0 then 'f' || (s_suppkey % 9) else 'n' || (s_suppkey % 97) end as name, s_suppkey % 60 as a, s_suppkey % 60 + s_suppkey % 41 as b from supplier"


@query(f"""with t as materialized ({_SITES}), s as materialized ({_OWN}),
  src as (select site, id as src from (select t.site, s.id, row_number() over (partition by t.site order by case when s.name = t.caller then 0 else 1 end, case when s.name = t.caller then 0 else s.b - s.a end, s.a, s.name, s.id) as r
    from t join s on t.path = s.path and t.line between s.a and s.b) where r = 1),
  m as (select t.site, t.path, s.id, s.path as sp, s.a, s.name from t join s on t.callee = s.name),
  own as (select site, arg_min(id, (a, name, id)) as dst from m where path = sp group by 1), far as (select * from m where site not in (select site from own)),
  uni as (select site, min(id) as dst from far group by 1 having count(distinct id) = 1),
  imp as (select site, min(id) as dst from far where site not in (select site from uni) and sp in (path + 1, path + 2) group by 1 having count(distinct id) = 1),
  dst as (select site, dst, 'same_file' as strategy from own union all select site, dst, 'unique_global' from uni union all select site, dst, 'import_resolved' from imp)
  select site, src, dst, strategy from src join dst using (site)""")
def call_edges(spark, d):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    n = lambda p, c, m: F.concat(F.lit(p), (c % m).cast("string"))
    sites = read(spark, d, "orders").select(k.alias("site"), (F.col("o_custkey") % 25).cast("int").alias("path"), n("f", k, 9).alias("caller"), n("n", k, 97).alias("callee"), (k % 120).alias("line"), F.lit(0.8).alias("confidence"))
    symbols = read(spark, d, "supplier").select(s.alias("symbol_id"), F.col("s_nationkey").cast("int").alias("path"), F.when(s % 3 == 0, n("f", s, 9)).otherwise(n("n", s, 97)).alias("name"), (s % 60).alias("start_line"), (s % 60 + s % 41).alias("end_line"))
    see = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("path"), F.explode(F.array((F.col("n_nationkey") + 1).cast("int"), (F.col("n_nationkey") + 2).cast("int"))).alias("dst_path"), F.array().cast("array<string>").alias("names"))
    return resolve.call_edges(sites, symbols, see)[0].select("site", "src", "dst", "strategy")


_QUERIES = ["callers_of order_12", "imports_of /c17.rs", "callees_of order_7", "symbols_in crates/m3/c17.rs", "tests_for /c17.rs", "order_123"]


def _edges_of(verb: str, selector: str, side: str) -> str:
    return f"""select '{verb}' as mode, src, dst, kind, null as path, null::double as score from edges where kind in ('imports', 'calls') and {side} in
      (select node from nodes where contains(lower(name), '{selector}') or contains(lower(path), '{selector}'))"""


def _tests(where: str, limit: int) -> str:
    """Suggested tests for the files of a condition: the operator's scores, over the tables of CODE."""
    words = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: strlen(x) > 2)"
    return f"""(with goal as materialized (select path from files where {where}), gs as (select * from symbols where path in (select path from goal) and kind <> 'test'),
      ts as materialized (select * from symbols where kind = 'test'), cand as (select path from files where regexp_matches(lower(path), 'test|spec') or path in (select path from ts)),
      im as (select src_path as path, count(*) as n from (select distinct src_path, dst_path from imports) where dst_path in (select path from goal) group by 1),
      ca as (select ts.path, count(*) as n from calls join ts on calls.src = ts.symbol_id where calls.dst in (select symbol_id from gs) group by 1),
      w as materialized (select distinct w from (select unnest({words.format('path')}) as w from goal union all select unnest({words.format('name')}) from gs)),
      ov as (select cand.path, count(*) as n from cand join w on contains(lower(cand.path), w.w) group by 1),
      mo as (select distinct {_MODULE} as module from goal),
      sc as (select cand.path, cast(case when im.n > 0 then im.n + 4.0 else 0 end + case when ca.n > 0 then 6.0 + least(ca.n, 3) else 0 end + 1.5 * coalesce(ov.n, 0)
        + case when {_MODULE.replace('path', 'cand.path')} in (select module from mo) then 1.5 else 0 end as double) as score from cand left join im using (path) left join ca using (path) left join ov using (path))
      select path, score from sc where score > 0 order by score desc, path limit {limit})"""


_MODULE = "case when starts_with(path, 'crates/') then 'crates/' || split_part(path, '/', 2) else split_part(path, '/', 1) end"


@query(f"""{CODE} {_edges_of("callers_of", "order_12", "dst")} union all {_edges_of("imports_of", "/c17.rs", "src")} union all {_edges_of("callees_of", "order_7", "src")}
  union all select 'symbols_in', node, null, kind, path, null from nodes where path = 'crates/m3/c17.rs' and kind <> 'file'
  union all select 'tests_for', null, null, 'test', path, score from {_tests("contains(lower(path), '/c17.rs')", 50)}
  union all select * from (select 'search', node, null, kind, path, cast(5.0 as double) + case when contains(lower(name), 'order') then 3 else 0 end + case when contains(lower(name), '123') then 3 else 0 end
    + case when contains(path, '123') then 2 else 0 end + case when kind = 'file' then 0 else 2 end as score from nodes where contains(lower(name), 'order_123')
    order by score desc, node limit 50)""")
def query_language(spark, d):
    """One query of each kind."""
    g, out = _graph(spark, d), None
    for q in _QUERIES[:5]:
        rows = ask.run(g, q)
        out = rows if out is None else out.unionByName(rows)
    found = ask.run(assemble.Graph(g.nodes.filter(F.contains(F.lower("name"), F.lit("order_123"))), g.edges), _QUERIES[5])
    return out.unionByName(found)


@query(f"""{CODE} select * from (select 'symbols_in' as part, name as item, cast(start_line as bigint) as n from symbols where path = 'crates/m3/c17.rs'
  union all select 'file', language, size_bytes from files where path = 'crates/m3/c17.rs'
  union all select 'node', node, null from nodes where path = 'crates/m3/c17.rs' and kind = 'file'
  union all select 'named', node, null from nodes where contains(name, 'c17') union all select 'missing', null, null where false)""")
def lookups(spark, d):
    t, path = code(spark, d), "crates/m3/c17.rs"
    nodes = _graph(spark, d).nodes
    row = lambda df, part, item, n: df.select(F.lit(part).alias("part"), item.alias("item"), n.cast("long").alias("n"))
    none = F.lit(None)
    out = row(lookup.of_file(t["symbols"], path, "start_line", "name"), "symbols_in", F.col("name"), F.col("start_line"))
    out = out.union(row(lookup.file_by_path(t["files"], path), "file", F.col("language"), F.col("size_bytes")))
    return out.union(row(lookup.file_node(nodes, path), "node", F.col("node"), none)).union(row(lookup.nodes_by_name(nodes, "c17"), "named", F.col("node"), none))


@query(f"""{CODE} select section, value, cast(n as bigint) as n from (
  select 'file' as section, path || ' ' || language || ' ' || size_bytes || ' ' || loc as value, 1 as n from files where path = 'crates/m3/c17.rs'
  union all select 'symbol', kind || ' ' || name, 1 from symbols where path = 'crates/m3/c17.rs'
  union all select 'imports', dst_path, count(*) from imports where src_path = 'crates/m3/c17.rs' group by 2
  union all select 'imported_by', src_path, count(*) from imports where dst_path = 'crates/m3/c17.rs' group by 2)""")
def explain_file(spark, d):
    t = code(spark, d)
    return lookup.explain_file("crates/m3/c17.rs", t["files"], t["symbols"], t["imports"]).groupBy("section", "value").agg(F.count("*").alias("n"))


def _levels(depth: int) -> str:
    out = ["l0 as materialized (select path from files where contains(path, '/c17.rs'))"]
    out += [f"l{k} as materialized (select distinct src_path as path from imports join l{k - 1} on dst_path = l{k - 1}.path)" for k in range(1, depth + 1)]
    return ", ".join(out)


@query(f"""{CODE}, {_levels(2)} select path, cast(min(d) as integer) as depth, case when min(d) = 0 then 'changed_or_target_file' else 'reverse_import_dependency' end as reason
  from (select path, 0 as d from l0 union all select path, 1 from l1 union all select path, 2 from l2) group by 1""")
def impact_radius(spark, d):
    return ask.impact_radius(_graph(spark, d), "/c17.rs", 2)


@query(f"""{CODE}, fi as (select dst_path as path, count(*) as n from imports group by 1), fo as (select src_path as path, count(*) as n from imports group by 1)
  select section, name, cast(n as bigint) as n from (
  select 'nodes' as section, kind as name, count(*) as n from nodes group by 2 union all select 'edges', kind, count(*) from edges group by 2
  union all select 'language', language, count(*) from files group by 2 union all select 'module', {_MODULE}, count(*) from files group by 2
  union all select * from (select 'fan_in', path, n from fi order by n desc, path limit 10) union all select * from (select 'fan_out', path, n from fo order by n desc, path limit 10))""")
def architecture_overview(spark, d):
    """All sections but the cycles, which are tested by scc_cycles and broken_rules."""
    t = code(spark, d)
    return ask.overview(_graph(spark, d), t["files"]).filter("section != 'cycle'")


_RULES = [("no-bin-to-m3", "error", "src/bin/**", "crates/m3/**", None, None), ("no-long", "warning", None, None, None, 880), ("no-tests", "info", None, None, "tests/c1?0_*", None), ("no-cycles", "error", None, None, None, None)]


@query(f"""{CODE}, pairs as (select distinct src_path as a, dst_path as b from imports where src_path < dst_path and starts_with(src_path, 'crates/m1/') and starts_with(dst_path, 'crates/m1/'))
  select rule, path, cast(count(*) as bigint) as n from (
  select 'no-bin-to-m3' as rule, src_path as path from imports where starts_with(src_path, 'src/bin/') and starts_with(dst_path, 'crates/m3/')
  union all select 'no-long', path from files where size_bytes // 40 > 880 union all select 'no-tests', path from files where path like 'tests/c1_0!_%' escape '!'
  union all select 'no-cycles', path from (select a as path from pairs union select b from pairs)) group by 1, 2""")
def broken_rules(spark, d):
    """The rules over all imports but those inside one module, and the cycles that the links inside it make both ways."""
    t = code(spark, d)
    inner = F.col("src_path").startswith("crates/m1/") & F.col("dst_path").startswith("crates/m1/")
    found = ask.broken_rules(t["files"], t["imports"], _RULES[:3])
    up = t["imports"].filter(inner & F.expr("src_path < dst_path")).distinct()
    both = up.union(up.select("dst_path", "src_path"))
    return found.unionByName(ask.broken_rules(t["files"].limit(0), both, _RULES[3:])).groupBy("rule", "path").agg(F.count("*").alias("n"))


_CHANGED = "files.id % 40 = 17"


def _report(spark, d):
    t = code(spark, d)
    owners = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("owner")).join(t["files"].select("id", "path"), "id").select("path", "owner")
    return ask.report(t["files"].filter("id % 40 = 17").select("path"), t["files"], t["imports"], owners, _RULES[:3])


_REPORT = f"""{CODE}, ch as materialized (select id, path from files where {_CHANGED}), im as materialized (select distinct src_path as path from imports where dst_path in (select path from ch) and src_path not in (select path from ch)),
  rep as (select 'changed' as section, path as item, null::bigint as n from ch union all select 'impacted', path, null from im
  union all select 'risk', case when count(*) > 20 then 'high' when count(*) > 5 then 'medium' else 'low' end, count(*) from im
  union all select 'high_risk', dst_path, count(*) from imports where dst_path in (select path from ch) group by 2 having count(*) > 5
  union all select 'violation', 'no-bin-to-m3: ' || src_path, null from imports where starts_with(src_path, 'src/bin/') and starts_with(dst_path, 'crates/m3/')
  union all select 'violation', 'no-long: ' || path, null from files where size_bytes // 40 > 880
  union all select 'violation', 'no-tests: ' || path, null from files where path like 'tests/c1_0!_%' escape '!'
  union all select distinct 'reviewer', cast(c_nationkey as varchar), null::bigint from customer where c_custkey in (select id from ch))"""


@query(f"{_REPORT} select section, item, n from rep")
def review_report(spark, d):
    return _report(spark, d)


@query(f"""{_REPORT} select 'error' as level, item as message from rep where section = 'violation'
  union all select 'warning', item || ' changed: high fan-in (' || n || ' dependents)' from rep where section = 'high_risk'
  union all select 'warning', 'Source files changed but no test files modified.' from (select bool_or(contains(item, 'test')) as t, bool_or(not contains(item, 'test')) as s from rep where section = 'changed') where s and not t""")
def validate(spark, d):
    return ask.validate(_report(spark, d))


@query(f"{CODE} select path, score from {_tests('files.id % 200 = 17', 40)}")
def suggested_tests(spark, d):
    """With symbols and calls; see suggested_tests_score for files alone."""
    g = _graph(spark, d)
    targets = code(spark, d)["files"].filter("id % 200 = 17").select("path")
    return ask.tests_for(g, targets, 40).select("path", "score")


@query(f"""{CODE}, best as materialized (select path, 1.5::double as score from files where contains(path, 'spec') order by path limit 8),
  sy as (select path, array_to_string(list(name || ' L' || start_line || '-' || end_line || ' - ' || signature order by v desc, name)[1:8], '; ') as symbols, greatest(count(*) - 8, 0) as omitted from
    (select s.*, case when kind in ('struct', 'enum', 'trait', 'class', 'interface') then 2.5 else 0 end as v from symbols s where path in (select path from best)) group by 1),
  dp as (select src_path as path, array_to_string(list_sort(list(distinct dst_path)), ' -> ') as deps from imports group by 1), rd as (select dst_path as path, array_to_string(list_sort(list(distinct src_path)), ',') as importers from imports group by 1)
  select path, score, coalesce(symbols, '') as symbols, cast(coalesce(omitted, 0) as bigint) as omitted, case when deps is not null then path || ' -> ' || deps end as dependency_chain, coalesce(importers, '') as importers
  from best left join sy using (path) left join dp using (path) left join rd using (path)""")
def context_pack(spark, d):
    """With symbols, dependency chains and importers."""
    t = code(spark, d)
    found = review.context_pack(t["files"].select("path"), t["symbols"], t["imports"], "change spec", budget=6000)
    text = lambda c, sep: F.coalesce(F.array_join(c, sep), F.lit(""))
    return found.select("path", "score", text("symbols", "; ").alias("symbols"), F.col("omitted").cast("long").alias("omitted"), "dependency_chain", text("importers", ",").alias("importers"))


@query(f"""{CODE} select node, warning from (select dst_path as node, 'high fan-in (' || count(*) || ' dependents)' as warning from imports group by 1 having count(*) > 5
  union all select src_path, 'high fan-out (' || count(*) || ' dependencies)' from imports group by 1 having count(*) > 10)""")
def fan_warnings(spark, d):
    return ask.fan_warnings(code(spark, d)["imports"].select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")))


@query(f"""{CODE}, t as materialized (select s.symbol_id, s.name, s.path from symbols s where visibility = 'pub' and path in (select path from files where {_CHANGED}))
  select node, name, path, cast(coalesce(r, 0) as bigint) as refs, cast(coalesce(n, 0) as bigint) as tests from (select 'symbol:' || symbol_id as node, name, path, symbol_id from t)
  left join (select dst, count(*) as r, count(*) filter (where src in (select symbol_id from symbols where kind = 'test')) as n from calls group by 1) on dst = symbol_id""")
def public_api_changes(spark, d):
    g = _graph(spark, d)
    changed = code(spark, d)["files"].filter("id % 40 = 17").select("path")
    return refactor.public_api_changes(g.nodes, g.edges, changed).withColumnRenamed("references", "refs")


@query(f"""{CODE}, m as (select symbol_id from symbols where name = 'order_7'), lab as (select symbol_id as id, path || '::' || name as label, kind from symbols)
  select 'symbol:' || symbol_id as node, coalesce((select array_to_string(list_sort(list(distinct label)), ',') from calls join lab on lab.id = src where dst = symbol_id), '') as callers,
  coalesce((select array_to_string(list_sort(list(distinct label)), ',') from calls join lab on lab.id = dst where src = symbol_id), '') as callees,
  cast((select count(*) from calls join lab on lab.id = src where dst = symbol_id and kind = 'test') as bigint) as tests from m""")
def rename_references(spark, d):
    g = _graph(spark, d)
    found = refactor.rename_references(g.nodes, g.of_kinds("calls"), "order_7")
    return found.select("node", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"), F.col("tests").cast("long").alias("tests"))


_OUT = """select doc_id as id, cast(n_chars % 4000 as bigint) as tokens, n_chars % 20000 as size, (doc_id % 6) / 5.0::double as r, doc_id % 8 as duplicate_paths, doc_id % 9 as duplicate_symbols, doc_id % 2 as duplicate_dep_paths,
  doc_id % 3 as duplicate_reverse_deps, doc_id % 4 as duplicate_warnings, doc_id % 13 as encoding_errors, doc_id % 5 as irrelevant_rules, doc_id % 6 as irrelevant_tests from documents"""


@query(f"""with x as (select *, case when tokens <= 3000 then 1.0 else 0.9 end::double as c from ({_OUT})),
  y as (select *, (1.25 + 1.25 + 0.75 + 0.75 + 0.75) * r + 0.25 * c as q,
  least(duplicate_paths * 0.15::double, 0.75) + least(duplicate_symbols * 0.05::double, 0.5) + least(duplicate_dep_paths * 0.1::double, 0.5) + least(duplicate_reverse_deps * 0.1::double, 0.5) + least(duplicate_warnings * 0.1::double, 0.5)
  + least(encoding_errors * 0.1::double, 1.0) + least(irrelevant_rules * 0.25::double, 0.75) + least(irrelevant_tests * 0.25::double, 0.75) as p from x)
  select id, round(q, 3) as quality, round(p, 3) as noise, round(greatest(0, least(5, q - p)), 3) as final,
  case when size <= 3000 then 1.0 when size <= 4000 then 0.9 when size <= 8000 then 0.75 when size <= 16000 then 0.45 else 0.25 end::double as tier from y""")
def output_scores(spark, d):
    k = F.col("doc_id")
    rows = read(spark, d, "documents").select(
        k.alias("id"), (F.col("n_chars") % 4000).cast("long").alias("tokens"), outputs.compactness(F.col("n_chars") % 20_000).alias("tier"), *[((k % 6) / 5.0).alias(c) for c, _ in outputs.QUALITY if c != "compactness"],
        *[(k % m).alias(c) for (c, _, _), m in zip(outputs.NOISE, (8, 9, 2, 3, 4, 13, 5, 6))],
    )
    rows = rows.withColumn("compactness", outputs.compactness(F.col("tokens")))
    return outputs.scored(rows).select("id", "quality", "noise", "final", "tier")


@query(f"""{CODE} select src_path as path, src_path || ' -> ' || array_to_string(list_sort(list(distinct dst_path)), ' -> ') as dependency_chain from imports group by 1""")
def dependency_chains(spark, d):
    return lookup.chains(code(spark, d)["imports"])


@query("""select doc_id, case when doc_id % 5 = 0 then '' else source || '+' || lang end as names from documents""")
def json_names(spark, d):
    good = F.to_json(F.array("source", "lang"))
    text = F.when(F.col("doc_id") % 5 == 0, "{oops").otherwise(good)
    return read(spark, d, "documents").select("doc_id", F.array_join(lookup.names_of(text), "+").alias("names"))


@query("""select path, event_type, event_id from (select 'u' || user_id as path, event_type, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1""")
def incremental_batches(spark, d):
    """Three batches of events merged by key, the second of them twice, as after a failure."""
    rows = read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    table = watch.Table(spark, f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}", "path string, event_type string, ts timestamp_ntz, event_id long", "path", ["ts", "event_id"])
    for number in (0, 1, 1, 2):
        table.merge(rows.filter(F.col("event_id") % 3 == number), number)
    return table.read().select("path", "event_type", "event_id")


@query("""select lang as mode, cast(count(*) as bigint) as tasks, round(avg(n_chars % 6), 4) as score, round(avg(n_chars), 4) as tokens, round(avg(doc_id % 9), 4) as files, cast(sum(doc_id % 100) as bigint) as elapsed_ms, round(avg(case when n_chars > 500 then 1 else 0 end), 4) as ok_share from documents group by 1""")
def mode_averages(spark, d):
    k, n = F.col("doc_id"), F.col("n_chars")
    rows = read(spark, d, "documents").select(F.col("lang").alias("mode"), (n % 6).alias("score"), n.alias("tokens"), (k % 9).alias("files"), (k % 100).alias("elapsed_ms"), (n > 500).alias("ok"))
    out = outputs.averages(rows)
    return out.select("mode", "tasks", *[F.round(c, 4).alias(c) for c in ("score", "tokens", "files")], "elapsed_ms", F.round("ok_share", 4).alias("ok_share"))


_TOK = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
_BUILT: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, d: str) -> postings.Index:
    """The index of ``documents``, built once for an application and a folder of tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/index-{abs(hash(key))}"
        postings.Index(spark, path).build(read(spark, d, "documents"), "doc_id", "text")
        _BUILT[key] = path
    return postings.Index(spark, _BUILT[key])


@query(f"""select term, cast(count(*) as bigint) as docs, cast(sum(tf) as bigint) as uses from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TOK}) as term from documents) group by 1, 2) group by 1""")
def search_index(spark, d):
    """The stored index's terms."""
    return stored_index(spark, d).terms()


@query("""select path, size, version, cast(0 as bigint) as missing from (select 'd' || doc_id as path, n_chars as size, case when doc_id % 3 = 0 then 'new' else 'old' end as version from documents where doc_id % 7 <> 0)""")
def incremental_store(spark, d):
    """A store that gets a table, an upsert of every third row, and a replacement that takes every seventh away."""
    rows = read(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"))
    store = Store(spark, f"{shared_dir(spark)}/store-{abs(hash((spark.sparkContext.applicationId, d)))}")
    own = lambda df, v: df.select("path", "size", F.lit(v).alias("version"))
    store.write("files", own(rows, "old"))
    store.upsert("files", own(rows.filter("doc_id % 3 = 0"), "new"), ["path"])
    gone = rows.filter("doc_id % 7 = 0").select("path")
    left = store.replace_by("files", own(rows.limit(0), "new"), "path", gone)
    return left.withColumn("missing", F.lit(0).cast("long"))


@query(f"""{CODE} select src, dst, kind from edges where not (kind = 'calls' and src in (select 'symbol:' || symbol_id from symbols where kind = 'test'))""")
def delete_edges(spark, d):
    g = _graph(spark, d)
    tests = g.nodes.filter("kind = 'test'").select(F.col("node").alias("src"))
    return sinks.without(g.edges, "calls", tests).select("src", "dst", "kind")


@query(f"""{CODE} select 'module ' || module || ' has ' || n || ' files' as line from (select {_MODULE} as module, count(*) as n from files group by 1)""")
def sql_views(spark, d):
    """The tables as views, asked in SQL."""
    for name, df in code(spark, d).items():
        df.createOrReplaceTempView(f"code_{name}")
    return spark.sql("""select concat('module ', module, ' has ', count(*), ' files') as line from
      (select case when path like 'crates/%' then concat('crates/', split_part(path, '/', 2)) else split_part(path, '/', 1) end as module from code_files) group by module""")


def _lines(spark, d):
    return files(spark, d).select("path", "language", "hash", "size_bytes", "loc", "text")


def index_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source files of a language without symbols: the index driver's report."""
    store = Store(spark, f"{shared_dir(spark)}/docs-{abs(hash((spark.sparkContext.applicationId, d, 1)))}")
    rows = _lines(spark, d)
    first = store.index(rows)
    again = store.index(rows)
    return spark.createDataFrame([(k, int(first[k]), int(again[k])) for k in first], "what string, first long, again long")


QUERIES["index_documents"] = index_documents
SQL["index_documents"] = """select * from (select 'added' as what, count(*) as "first", cast(0 as bigint) as again from documents union all select 'changed', 0, 0 union all select 'removed', 0, 0)"""
