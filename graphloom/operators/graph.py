"""Graph operators over edges (src, dst): reachability, components, cycles, rank, shortest traces.

Loops run on the driver but hold no rows there: each round is a join whose result is written to the shared
folder, and a round that adds nothing ends the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..runtime import bucketed, forget, written


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(node, depth) of all nodes within ``depth`` edges of the seeds (column node), each at its least depth."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    if depth > 1:
        step = written(step, "steps")
    seen = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    front = seen
    for k in range(1, depth + 1):
        found = front.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = written(found.withColumn("depth", F.lit(k)), "reached")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is connected to it, by alternating large and small stars."""
    links = written(edges.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("u")).distinct(), "links")
    now, last = links.filter("u != v"), None
    while True:
        # large star: what is linked to v from above goes to the least of v's own links
        low = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = now.join(low.hint("merge"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        # small star: u and its other links go to the least of them; the row of the least one stands for u
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u"))).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        seen = Observation()
        now = written(small.distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links")
        size = seen.get["n"], seen.get["sum"]
        if size == last:
            break
        last = size
    # every node that has a smaller one linked to it has one link by now, the others are components' smallest
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    below = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tops.unionByName(below).groupBy("node").agg(F.min("component").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles: strongly connected components of two or more, and self-loops.

    Nodes without a predecessor or without a successor are cut off first, round by round. Nodes that point at each other
    are drawn together, as are those that others of theirs do; what is left is split by forward and backward colours
    (smallest node that reaches it, or that it reaches)."""
    arcs = edges if hasattr(edges, "written_at") else written(edges.select("src", "dst"), "given")
    loops = arcs.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left, n = _trimmed(*_counted(arcs.filter("src != dst")))
    if not n:
        return loops.distinct()
    pairs = written(left.groupBy(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("u")).agg(F.bool_or(F.col("src") < F.col("dst")).alias("up"), F.bool_or(F.col("src") > F.col("dst")).alias("down")), "pairs")
    rings = found = None
    mutual = pairs.filter("up and down")
    # where they are few, drawing them together costs more than it saves
    if mutual.count() * 10 >= pairs.count():
        rings = written(components(mutual.select(F.col("v").alias("src"), F.col("u").alias("dst"))), "rings")
    left = pairs.filter("not (up and down)").select(F.when(F.col("up"), F.col("v")).otherwise(F.col("u")).alias("src"), F.when(F.col("up"), F.col("u")).otherwise(F.col("v")).alias("dst"))
    if rings is not None:
        for end in ("src", "dst"):
            ring = rings.select(F.col("node").alias(end), F.col("component").alias("ring")).hint("merge")
            left = left.join(ring, end, "left").withColumn(end, F.coalesce("ring", end)).drop("ring")
        left = left.filter("src != dst").distinct()
    left, n = _counted(written(left, "arcs"))
    if rings is not None:
        left, n = _trimmed(left, n)
    while n:
        fore = _least_reaching(left)
        inside = left.join(fore.hint("merge"), left["dst"] == fore["node"]).drop("node").withColumnRenamed("least", "c").join(fore.hint("merge"), left["src"] == fore["node"]).filter("c = least").select("src", "dst", "c")
        inside = written(inside, "inside")
        # of each colour, the nodes that reach its own root make the root's component
        back = written(fore.filter("node = least").select("node", F.col("least").alias("c")), "back")
        front = back
        while True:
            more = front.join(inside.hint("merge"), (front["node"] == inside["dst"]) & (front["c"] == inside["c"])).select(inside["src"].alias("node"), inside["c"]).distinct()
            front = written(more.join(back.hint("merge"), ["node", "c"], "left_anti"), "back")
            if front.isEmpty():
                break
            back = back.unionByName(front)
        group = written(back.withColumn("n", F.count("*").over(Window.partitionBy("c"))).filter("n > 1").select("node", F.col("c").alias("component")), "cycle")
        found = group if found is None else found.unionByName(group)
        gone = back.select("node").hint("merge")
        left = left.join(gone, left["src"] == gone["node"], "left_anti").join(gone, left["dst"] == gone["node"], "left_anti")
        left, n = _trimmed(*_counted(written(left, "arcs")))
    if rings is not None:
        # a ring is named by its smallest node, so what it was found to be part of is named by the smallest of all
        part = rings if found is None else rings.join(found.select(F.col("node").alias("component"), F.col("component").alias("whole")).hint("merge"), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
        found = part if found is None else found.join(rings.select("node").hint("merge"), "node", "left_anti").unionByName(part)
    return loops.distinct() if found is None else found.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def _counted(arcs: DataFrame) -> tuple[DataFrame, int]:
    return arcs, arcs.count()


def _trimmed(left: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(arcs, their number) without those to nodes that nothing leaves and from nodes that nothing reaches, until none of
    these is left. The second join of a round moves only what the first one kept."""
    while n:
        out = left.select(F.col("src").alias("n")).distinct().hint("merge")
        into = left.select(F.col("dst").alias("n")).distinct().hint("merge")
        seen, last = Observation(), n
        left = written(left.join(out, left["dst"] == out["n"], "left_semi").join(into, left["src"] == into["n"], "left_semi").observe(seen, F.count("*").alias("n")), "arcs")
        n = seen.get["n"]
        if n == last:
            break
    return left, n


def _least_reaching(arcs: DataFrame) -> DataFrame:
    """(node, least): the smallest node that reaches it, itself included. Only nodes whose colour changed tell it on."""
    nodes = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct()
    now = written(nodes.select("node", F.col("node").alias("least"), F.lit(True).alias("new")), "colour")
    while True:
        sent = arcs.join(now.filter("new").hint("merge"), arcs["src"] == now["node"]).select(F.col("dst").alias("node"), "least", F.lit(None).cast("boolean").alias("new"))
        old = F.min(F.when(F.col("new").isNotNull(), F.col("least")))
        seen = Observation()
        both = now.unionByName(sent).groupBy("node").agg(F.min("least").alias("least"), old.alias("was"))
        now = written(both.select("node", "least", (F.col("least") < F.col("was")).alias("new")).observe(seen, F.count_if("new").alias("changed")), "colour")
        if not seen.get["changed"]:
            return now.select("node", "least")


def rank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, inflate: bool = True) -> DataFrame:
    """(node, score) after ``rounds`` rounds from 1 / n. With ``inflate`` every round hands out the sum of all
    scores, not only that of nodes without successors; without it the scores stay a distribution."""
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    # in buckets of src, so that a round moves the scores and what is sent, but no arcs
    degree = F.sum("w").over(Window.partitionBy("src"))
    shares = lambda df: df.groupBy("src", "dst").agg(F.count("*").alias("w")).select("src", "dst", (F.col("w") / degree).alias("share"))
    arcs = bucketed(edges.select("src", "dst"), "arcs", "src", "dst", shares)
    ends = arcs.select(F.col("src").alias("node"), F.lit(True).alias("sends")).distinct()
    base = written(nodes.select("node").distinct().join(ends.hint("merge"), "node", "left").select("node", F.coalesce("sends", F.lit(False)).alias("sends")), "nodes")
    now, spread = base.select("node", "sends", F.lit(1.0 / n).alias("score")), 1.0
    if not inflate:
        spread = base.filter("not sends").count() / n
    for _ in range(rounds):
        # one shuffle and one job a round: the nodes and what is sent to them meet in one aggregate, and the write
        # reports the sum that the next round hands out
        sent = arcs.join(now.select(F.col("node").alias("src"), "score").hint("shuffle_hash"), "src").select(F.col("dst").alias("node"), F.lit(None).cast("boolean").alias("sends"), (F.col("score") * F.col("share")).alias("got"))
        got = base.select("node", "sends", F.lit(0.0).alias("got")).unionByName(sent).groupBy("node").agg(F.max("sends").alias("sends"), F.sum("got").alias("got")).filter("sends is not null")
        seen = Observation()
        handed = F.col("score") if inflate else F.when(F.col("sends"), 0.0).otherwise(F.col("score"))
        new = got.select("node", "sends", (F.lit((1 - damping) / n + damping * spread / n) + damping * F.col("got")).alias("score"))
        now = written(new.observe(seen, F.sum(handed).alias("spread")), "rank")
        spread = seen.get["spread"]
    forget(arcs)
    return now.select("node", "score")


def traces(edges: DataFrame, entries: DataFrame, targets: DataFrame, depth: int = 12) -> DataFrame:
    """(entry, path): from each entry (column node) the shortest path to a target (column node) other than itself.

    edges may have a column ord, by which equally short paths are told apart, then by the path's text."""
    step = edges.select("src", "dst", (F.col("ord") if "ord" in edges.columns else F.lit(0)).alias("ord"))
    goal = targets.select(F.col("node").alias("goal")).distinct()
    front = written(entries.select(F.col("node").alias("entry"), "node", F.array(F.col("node").cast("string")).alias("path"), F.array().cast("array<int>").alias("ords")).distinct(), "trace")
    seen, out = front.select("entry", "node"), None
    for _ in range(depth):
        more = front.join(step, front["node"] == step["src"]).select("entry", F.col("dst").alias("node"), F.concat("path", F.array(F.col("dst").cast("string"))).alias("path"), F.concat("ords", F.array(F.col("ord").cast("int"))).alias("ords"))
        more = more.join(seen, ["entry", "node"], "left_anti")
        front = written(more.groupBy("entry", "node").agg(F.min(F.struct("ords", "path")).alias("best")).select("entry", "node", "best.path", "best.ords"), "trace")
        if front.isEmpty():
            break
        hit = front.join(goal, front["node"] == goal["goal"], "left_semi")
        best = written(hit.groupBy("entry").agg(F.min(F.struct("ords", "path")).alias("b")).select("entry", "b.path"), "hits")
        out = best if out is None else out.unionByName(best)
        seen = seen.unionByName(front.select("entry", "node"))
        front = front.join(best.select("entry"), "entry", "left_anti")
    return out if out is not None else front.select("entry", "path").limit(0)


def edge_query(nodes: DataFrame, edges: DataFrame, selector: str, incoming: bool, kinds: tuple[str, ...] = ("imports", "calls")) -> DataFrame:
    """Edges of the given kinds into or out of the nodes whose name or path contains the selector."""
    sel = nodes.filter(F.lower("name").contains(selector.lower()) | F.lower("path").contains(selector.lower())).select("node")
    side = "dst" if incoming else "src"
    hit = edges.filter(F.col("kind").isin(*kinds)).join(sel, edges[side] == sel["node"], "left_semi")
    name = lambda p: nodes.select(F.col("node").alias(p), F.col("name").alias(f"{p}_name"), F.col("path").alias(f"{p}_path"))
    return hit.join(name("src"), "src").join(name("dst"), "dst").select("src", "src_name", "src_path", "dst", "dst_name", "dst_path", "kind")
