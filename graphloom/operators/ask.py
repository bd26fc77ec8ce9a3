"""Questions over a whole code graph: the query language, impact, flows, change risk, overview, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, scoring
from ..runtime import written
from . import graph as algorithms
from . import lookup, refactor, review, search
from .assemble import Graph, flow_edges

OUTGOING, INCOMING = ("imports_of", "deps_of", "callees_of"), ("imported_by", "rdeps_of", "callers_of")


def run(g: Graph, query: str, limit: int = 50) -> DataFrame:
    """(mode, src, dst, kind, path, score) of a query: "<verb> <selector>", or words to search for.

    imports_of, deps_of and callees_of give the edges out of the selected nodes, imported_by, rdeps_of and callers_of
    those into them, symbols_in the symbols of a file, tests_for the tests that cover the selected nodes' files; all
    else is a search by substrings."""
    verb, _, rest = query.strip().partition(" ")
    rest = rest.strip()
    text = lambda: F.lit(None).cast("string")
    score = F.lit(None).cast("double").alias("score")
    if rest and verb in OUTGOING + INCOMING:
        rows = algorithms.edge_query(g.nodes, g.edges, rest, verb in INCOMING)
        return rows.select(F.lit(verb).alias("mode"), "src", "dst", "kind", text().alias("path"), score)
    if rest and verb == "symbols_in":
        rows = g.nodes.filter((F.col("path") == rest) & (F.col("kind") != "file"))
        return rows.select(F.lit(verb).alias("mode"), F.col("node").alias("src"), text().alias("dst"), "kind", "path", score)
    if rest and verb == "tests_for":
        found = tests_for(g, lookup.select_nodes(g.nodes, rest).select("path").distinct(), limit)
        return found.select(F.lit(verb).alias("mode"), text().alias("src"), text().alias("dst"), F.lit("test").alias("kind"), "path", "score")
    found = search.substring(g.nodes, query.strip(), None, limit)
    return found.select(F.lit("search").alias("mode"), F.col("node").alias("src"), text().alias("dst"), "kind", "path", "score")


def _files(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'file'").select("node", "path")


def tests_for(g: Graph, targets: DataFrame, limit: int = 20) -> DataFrame:
    """Suggested tests for target files (column path)."""
    symbols = g.nodes.filter("kind != 'file'").select("node", "name", "kind", "path")
    return review.suggested_tests(_files(g), symbols, g.of_kinds("imports", "calls"), targets, limit)


def impacted(g: Graph, targets: DataFrame, depth: int = 3) -> DataFrame:
    """(path, depth, reason) of the target files (column path) and of what imports them, directly or not."""
    files = _files(g)
    seeds = files.join(targets.select("path").distinct(), "path", "left_semi").select("node")
    found = algorithms.bfs(g.of_kinds("imports"), seeds, depth, reverse=True)
    reason = F.when(F.col("depth") == 0, "changed_or_target_file").otherwise("reverse_import_dependency")
    return found.join(files, "node").select("path", "depth", reason.alias("reason"))


def impact_radius(g: Graph, target: str, depth: int = 3) -> DataFrame:
    return impacted(g, lookup.select_nodes(g.nodes, target).select("path"), depth)


def affected_flows(g: Graph, changed: DataFrame, depth: int = 12) -> DataFrame:
    """(entry, kind, path, confidence, risk): from each file that is an entry point the shortest trace to a changed file
    (column path) or a symbol of it."""
    files = _files(g)
    entries = files.filter(paths.entrypoint(F.col("path")).isNotNull()).select("node")
    goal = g.nodes.join(changed.select("path").distinct(), "path", "left_semi").select("node")
    traced = written(algorithms.traces(flow_edges(g), entries, goal, depth), "traced")
    return review.flows(g.nodes, traced, changed, g.of_kinds("calls"))


def detect_changes(g: Graph, changes: DataFrame, depth: int = 3, tests: int = 20) -> dict[str, DataFrame]:
    """Parts of a change report: impacted, tests, flows, reasons, and risk (one row: score, level and what they are
    from). changes: path, lines_added, lines_deleted."""
    changed = changes.select("path").distinct()
    hit = written(impacted(g, changed, depth), "impacted")
    suggested = written(tests_for(g, changed, tests), "tests")
    flows = written(affected_flows(g, changed), "flows")
    fan = g.of_kinds("imports").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in")).join(_files(g), "node").select("path", "fan_in")
    others = hit.filter("depth > 0")
    reasons = written(review.risk_reasons(changed, fan, others.count(), flows.count(), suggested.count()), "reasons")
    sizes = changes.agg(F.count("*").alias("changes"), F.coalesce(F.sum(F.col("lines_added") + F.col("lines_deleted")), F.lit(0)).alias("lines"))
    row = sizes.crossJoin(lookup.counts(impacted=others, flows=flows, reasons=reasons, tests=suggested))
    score = scoring.risk_score(*[F.col(c) for c in ("changes", "lines", "impacted", "flows", "reasons")])
    risk = row.withColumn("score", score).withColumn("level", scoring.risk_level(F.col("score")))
    return {"impacted": hit, "tests": suggested, "flows": flows, "reasons": reasons, "risk": risk}


def overview(g: Graph, files: DataFrame, top: int = 10) -> DataFrame:
    """(section, name, n): counts of nodes and edges by kind, languages, modules, largest fan-in and fan-out, cycles."""
    row = lambda df, section, name, n: df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(n).cast("long").alias("n"))
    count = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n"))
    # imports join files, whose keys are "file:" and the path (see Graph), so the paths are looked up nowhere
    path = lambda end: F.substring(end, len("file:") + 1, 2**31 - 1).alias(end)
    imports = written(g.of_kinds("imports").select(path("src"), path("dst")), "imports")
    rings = algorithms.cycles(imports).groupBy("component").agg(F.count("*").alias("n"))
    out = row(count(g.nodes, "kind"), "nodes", "kind", "n").unionByName(row(count(g.edges, "kind"), "edges", "kind", "n"))
    out = out.unionByName(row(lookup.language_stats(files), "language", "language", "files")).unionByName(row(lookup.modules(files), "module", "module", "files"))
    out = out.unionByName(row(lookup.top_degrees(lookup.fan_in(imports), top), "fan_in", "node", "fan_in")).unionByName(row(lookup.top_degrees(lookup.fan_out(imports), top), "fan_out", "node", "fan_out"))
    return out.unionByName(row(rings, "cycle", "component", "n"))


def broken_rules(files: DataFrame, imports: DataFrame, rules=review.DEFAULT_RULES, by_loc: bool = False) -> DataFrame:
    """Violations of all rules: globs and lengths (see review), and "no-cycles", one row for each file on a cycle of
    imports, whose target is the cycle's first file. imports: src_path, dst_path."""
    out = review.rule_violations(files, imports, rules, by_loc)
    for name, severity, *_ in rules:
        if name == "no-cycles":
            rings = algorithms.cycles(imports.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")))
            out = out.unionByName(rings.select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col("node").alias("path"), F.col("component").alias("target")))
    return out


def report(changes: DataFrame, files: DataFrame, imports: DataFrame, owners: DataFrame, rules=review.DEFAULT_RULES) -> DataFrame:
    """(section, item, n) of a review: changed, impacted (one import away), risk, high_risk, violation, reviewer.

    changes: path; imports: src_path, dst_path, one row for each; owners: path, owner."""
    changed = written(changes.select("path").distinct(), "changed")
    edges = imports.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))
    item = lambda df, section, name, n=None: df.select(F.lit(section).alias("section"), F.col(name).alias("item"), (F.col(n) if n else F.lit(None)).cast("long").alias("n"))
    hit = lookup.diff_impact(edges, changed.select(F.col("path").alias("node")))
    total = hit.agg(F.count("*").alias("n"))
    level = F.when(F.col("n") > 20, "high").when(F.col("n") > 5, "medium").otherwise("low")
    fan = lookup.fan_in(edges).join(changed.select(F.col("path").alias("node")), "node", "left_semi").filter("fan_in > 5")
    bad = broken_rules(files, imports, rules).select(F.concat_ws(": ", "rule", "path").alias("item"))
    who = owners.join(changed, "path", "left_semi").select("owner").distinct()
    out = item(changed, "changed", "path").unionByName(item(hit, "impacted", "node")).unionByName(item(total.withColumn("level", level), "risk", "level", "n"))
    return out.unionByName(item(fan, "high_risk", "node", "fan_in")).unionByName(item(bad, "violation", "item")).unionByName(item(who, "reviewer", "owner"))


def validate(found: DataFrame) -> DataFrame:
    """(level, message) of a report: cycles and violations are errors, changes of much-used files and sources that
    changed without a test are warnings."""
    bad = found.filter("section = 'violation'").select(F.lit("error").alias("level"), F.col("item").alias("message"))
    risky = found.filter("section = 'high_risk'").select(F.lit("warning").alias("level"), F.format_string("%s changed: high fan-in (%d dependents)", "item", "n").alias("message"))
    test = F.lower("item").contains("test")
    sides = found.filter("section = 'changed'").agg(F.bool_or(test).alias("tests"), F.bool_or(~test).alias("sources"))
    untested = sides.filter("sources and not tests").select(F.lit("warning").alias("level"), F.lit("Source files changed but no test files modified.").alias("message"))
    return bad.unionByName(risky).unionByName(untested)


def review_context(g: Graph, task: str, budget: int = 20_000, max_files: int = 30, per_file: int = 8) -> DataFrame:
    """The context pack of a task over the graph: see review.context_pack."""
    symbols = g.nodes.filter("kind != 'file'").select("path", "name", "kind", "signature", "start_line", "end_line")
    label = _files(g)
    imports = g.of_kinds("imports").join(label.select(F.col("node").alias("src"), F.col("path").alias("src_path")), "src").join(label.select(F.col("node").alias("dst"), F.col("path").alias("dst_path")), "dst").select("src_path", "dst_path")
    return review.context_pack(label.select("path"), symbols, imports, task, budget, max_files, per_file)


def fan_warnings(edges: DataFrame, into: int = 5, out: int = 10) -> DataFrame:
    """(node, warning) of the nodes with many edges into or out of them."""
    many_in = lookup.fan_in(edges).filter(F.col("fan_in") > into).select("node", F.format_string("high fan-in (%d dependents)", "fan_in").alias("warning"))
    many_out = lookup.fan_out(edges).filter(F.col("fan_out") > out).select("node", F.format_string("high fan-out (%d dependencies)", "fan_out").alias("warning"))
    return many_in.unionByName(many_out)


def pack_tests(best: DataFrame, symbols: DataFrame, limit: int = 8) -> DataFrame:
    """(path, priority) of test files for a pack's files (column path): those of the same module first, then others, those of
    fixtures and benchmarks last; where the first exist, no others."""
    own = best.select(paths.module(F.col("path")).alias("module")).distinct().withColumn("same", F.lit(True))
    tests = symbols.filter((F.col("kind") == "test") & F.col("path").contains("test")).select("path").distinct().withColumn("module", paths.module(F.col("path")))
    priority = F.when(F.col("same"), 0).when(F.col("path").rlike("fixtures|benchmarks"), 2).otherwise(1)
    rows = tests.join(own, "module", "left").select("path", priority.alias("priority"))
    least = rows.agg(F.min("priority").alias("least"))
    return rows.crossJoin(F.broadcast(least)).filter("priority = 0 or least > 0").select("path", "priority").orderBy("priority", "path").limit(limit)


def path_rules(best: DataFrame, table: DataFrame) -> DataFrame:
    """Texts of the rules (columns needle, rule) whose needle a path of the pack contains."""
    return table.filter(F.exists(F.lit([r.path for r in best.select("path").limit(1000).collect()]).cast("array<string>"), lambda p: p.contains(F.col("needle")))).select("rule").distinct()


#: The tools by name, as a server would offer them: each takes a graph and its own arguments.
TOOLS = {
    "query_graph": run, "get_impact_radius": impact_radius, "get_affected_flows": affected_flows, "detect_changes": detect_changes,
    "get_architecture_overview": overview, "get_review_context": review_context, "suggest_tests": tests_for,
    "semantic_search_nodes": lambda g, query, kind=None, limit=20: search.substring(g.nodes, query, kind, limit),
    "list_files": lambda g, **kw: lookup.list_files(g.nodes.filter("kind = 'file'"), **kw), "list_symbols": lambda g, **kw: lookup.list_symbols(g.nodes.filter("kind != 'file'"), **kw),
    "get_file_neighborhood": lambda g: lookup.neighborhood(g.nodes.filter("kind = 'file'"), g.of_kinds("imports", "calls")),
    "find_dead_code": lambda g: review.dead_code(g.nodes, _files(g), g.edges), "rename_references": lambda g, name: refactor.rename_references(g.nodes, g.of_kinds("calls"), name),
}


def call(g: Graph, tool: str, **arguments):
    """Run a tool by its name; an unknown name is a KeyError that lists the known ones."""
    if tool not in TOOLS:
        raise KeyError(f"unknown tool {tool}; known: {', '.join(sorted(TOOLS))}")
    return TOOLS[tool](g, **arguments)
