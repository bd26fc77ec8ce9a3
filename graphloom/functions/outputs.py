"""Scores of the answers that code-search tools give: recall, compactness, noise, and the gates that a mode must pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (measure, its weight) of the quality, and (counter, weight of one, most) of the noise.
QUALITY = [("file_recall", 1.25), ("symbol_recall", 1.25), ("reverse_dep_quality", 0.75), ("test_accuracy", 0.75), ("actionability", 0.75), ("compactness", 0.25)]
NOISE = [
    ("duplicate_paths", 0.15, 0.75), ("duplicate_symbols", 0.05, 0.5), ("duplicate_dep_paths", 0.1, 0.5), ("duplicate_reverse_deps", 0.1, 0.5),
    ("duplicate_warnings", 0.1, 0.5), ("encoding_errors", 0.1, 1.0), ("irrelevant_rules", 0.25, 0.75), ("irrelevant_tests", 0.25, 0.75),
]


def compactness(tokens: Column) -> Column:
    return F.when(tokens <= 3000, 1.0).when(tokens <= 4000, 0.9).when(tokens <= 8000, 0.75).when(tokens <= 16_000, 0.45).otherwise(0.25)


def step(text: Column, levels: list[tuple[float, str]]) -> Column:
    """The score of the first pattern (regular expressions, best first) that the lower-cased text has, 0 without any."""
    low = F.lower(text)
    return reduce(lambda w, x: w.when(low.rlike(x[1]), x[0]), levels[1:], F.when(low.rlike(levels[0][1]), levels[0][0])).otherwise(0.0)


def summed(text: Column, parts: list[tuple[float, str]], most: float = 1.0) -> Column:
    """The sum of the scores of all patterns that the lower-cased text has, at most ``most``."""
    low = F.lower(text)
    return F.least(reduce(lambda a, b: a + b, [F.when(low.rlike(rx), x).otherwise(0.0) for x, rx in parts]), F.lit(most))


def mentions(text: Column, pattern: str) -> Column:
    """How often a text has a pattern, for counters of noise."""
    return F.regexp_count(text, F.lit(pattern))


def scored(modes: DataFrame) -> DataFrame:
    """``modes`` (the columns of QUALITY and NOISE, tokens) with quality, noise, final (0 to 5) and its rate per 1,000 tokens."""
    quality = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in QUALITY])
    noise = reduce(lambda a, b: a + b, [F.least(F.col(c) * w, F.lit(most)) for c, w, most in NOISE])
    out = modes.withColumn("quality", F.round(quality, 3)).withColumn("noise", F.round(noise, 3))
    final = F.greatest(F.lit(0.0), F.least(F.lit(5.0), quality - noise))
    rate = F.when(F.col("tokens") > 0, F.round(final / F.col("tokens") * 1000, 3)).otherwise(0.0)
    return out.withColumn("final", F.round(final, 3)).withColumn("per_1k", rate)


def gates(rows: DataFrame, target: str, rivals: str, least: float = 4.5) -> DataFrame:
    """Failures of the target mode: too low a score, a rate no better than the best rival's (modes that start so), noise."""
    best = rows.agg(F.coalesce(F.max(F.when(F.col("mode").startswith(rivals), F.col("per_1k"))), F.lit(0.0)).alias("best"))
    own = rows.filter(F.col("mode") == target).crossJoin(F.broadcast(best))
    clean = [F.when(F.col(c) != 0, f"{c} != 0") for c in ("duplicate_paths", "encoding_errors", "irrelevant_rules")]
    checks = [F.when(F.col("final") < least, f"final < {least}"), F.when(F.col("per_1k") <= F.col("best"), "per_1k <= best rival"), *clean]
    return own.select(F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("failure"))


def averages(rows: DataFrame) -> DataFrame:
    """Of each mode: tasks, mean score, tokens and files, all time, share that succeeded."""
    return rows.groupBy("mode").agg(
        F.count("*").alias("tasks"), F.avg("score").alias("score"), F.avg("tokens").alias("tokens"), F.avg("files").alias("files"),
        F.sum("elapsed_ms").alias("elapsed_ms"), F.avg(F.col("ok").cast("int")).alias("ok_share"),
    )
