"""Keyword, BM25, vector and hybrid search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

K1, B = 1.2, 0.75


def bm25(docs: DataFrame, query: str, limit: int, key: str = "node", text: str = "content") -> DataFrame:
    """(key, score) of the documents that have all terms of the query, best first.

    Each document is read once: its length and its count of every term come from the same pass, the corpus'
    numbers from one aggregate over it, so nothing is exploded and nothing but two scalars is joined."""
    words = list(dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())))
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    # words between single blanks; with doubled blanks, each " word " can be counted by what its removal saves
    flat = docs.select(key, F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " ")).alias("t"))
    wide = flat.select(key, F.when(F.col("t") == "", 0).otherwise(F.length("t") - F.length(F.replace("t", F.lit(" "))) + 1).alias("len"), F.concat(F.lit(" "), F.replace("t", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("t"))
    count_of = lambda w: ((F.length("t") - F.length(F.replace("t", F.lit(f" {w} ")))) / (len(w) + 2)).cast("long")
    tf = [count_of(w).alias(f"tf{k}") for k, w in enumerate(words)]
    counts = wide.select(key, "len", *tf)
    total = counts.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(words))])
    hits = counts.filter(reduce(lambda a, b: a & b, [F.col(f"tf{k}") > 0 for k in range(len(words))])).crossJoin(F.broadcast(total))

    def part(k: int) -> Column:
        idf = F.greatest(F.log((F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5)), F.lit(1e-6))
        return idf * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("len") / F.col("mean")))

    score = reduce(lambda a, b: a + b, [part(k) for k in range(len(words))])
    return hits.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def substring(nodes: DataFrame, query: str, kind: str | None, limit: int) -> DataFrame:
    score = scoring.substring_score(F.col("name"), F.col("path"), F.col("signature"), F.col("kind"), query)
    rows = nodes.filter(F.col("kind") == kind) if kind else nodes
    return rows.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "node").limit(limit)


def nearest(vectors: DataFrame, query: list[float], limit: int, key: str = "node", vector: str = "vector") -> DataFrame:
    """Exact cosine search: one scan, the query as a literal, a distributed top k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, scoring.cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def hash_embedding(docs: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, vector): tokens hashed to signed buckets, length 1; each distinct token of a text is hashed once."""
    tok = docs.select(key, F.explode(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda t: t != "")).alias("tok")).groupBy(key, "tok").count()
    bucket, weight = scoring.hash_parts(F.col("tok"), dims)
    sums = tok.select(key, bucket.alias("b"), (weight * F.col("count")).alias("w")).groupBy(key, "b").agg(F.sum("w").alias("w"))
    full = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(F.col("size") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("size")).otherwise(0.0))
    out = docs.select(key).join(full.select(key, vector.alias("vector")), key, "left")
    return out.select(key, F.coalesce("vector", F.array_repeat(F.lit(0.0), dims)).alias("vector"))


def hybrid(vectors: DataFrame, lexical: DataFrame, ranks: DataFrame, query: list[float], limit: int) -> DataFrame:
    """0.45 lexical + 0.45 cosine + 0.10 rank, each relative to its maximum (rank's at least 1), and a bonus by kind.

    vectors: node, name, kind, vector; lexical: node, score; ranks: node, score. Without vectors the lexical hits."""
    q = F.array(*[F.lit(float(x)) for x in query])
    top = lexical.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("lmax")).crossJoin(ranks.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("rmax")))
    rows = vectors.join(lexical.select("node", F.col("score").alias("lex")), "node", "left").join(ranks.select("node", F.col("score").alias("rank")), "node", "left").crossJoin(F.broadcast(top))
    zero = F.lit(0.0)
    bonus = F.when(F.col("kind").isin("function", "method"), 0.05).when(F.col("kind") == "file", 0.0).otherwise(0.02)
    cos = scoring.cosine(F.col("vector"), q)
    score = 0.45 * F.coalesce("lex", zero) / F.coalesce("lmax", F.lit(1.0)) + 0.45 * F.greatest(cos, zero) + 0.10 * F.coalesce("rank", zero) / F.coalesce("rmax", F.lit(1.0)) + bonus
    reason = F.when(F.col("lex").isNull(), "semantic_vector_graph").otherwise("hybrid_fts_vector_graph")
    return rows.select("node", "name", "kind", score.alias("score"), reason.alias("reason")).orderBy(F.desc("score"), "name", "node").limit(limit)


def search(docs: DataFrame, nodes: DataFrame, query: str, kind: str | None, limit: int) -> DataFrame:
    """BM25 hits with the reason "fts5"; where there are none, substring hits with "substring"."""
    found = bm25(docs if kind is None else docs.filter(F.col("kind") == kind), query, limit)
    if not found.isEmpty():
        return found.withColumn("reason", F.lit("fts5"))
    return substring(nodes, query, kind, limit).select("node", "score", F.lit("substring").alias("reason"))
