"""Scores, terms and vectors as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = set(
    "about add after an and are as at be been before being between bug but by can change could did do does feature fix for "
    "from get had has have implement in into is issue make may might new no nor not of on or remove set shall should so task "
    "that the these this those to under update was were when will with would yet a".split()
)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits of more than two bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) > 2)


def keywords(task: str) -> list[str]:
    """Distinct words of a task, sorted; stop words are matched before lower-casing."""
    return sorted({w.lower() for w in re.split(r"[\W_]+", task) if len(w.encode()) > 2 and w not in STOP})


def hits(text: Column, words: list[str], weight: float) -> Column:
    """``weight`` for each word that the lower-cased text contains."""
    return reduce(lambda a, w: a + F.when(F.lower(text).contains(w), weight).otherwise(0.0), words, F.lit(0.0))


def relevance(name: Column, path: Column, words: list[str]) -> Column:
    return hits(name, words, 1.0) + hits(path, words, 0.5)


def file_relevance(path: Column, words: list[str], backend: bool = False) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    bonus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = relevance(path, path, words) + bonus(low.contains("/src/"), 1.0)
    score = score - bonus(low.rlike("benchmarks/fixtures|/fixtures/"), 5.0) - bonus(low.rlike("target/|node_modules/"), 10.0)
    if backend:
        score = score + bonus(low.rlike(r"(cargo\.toml|package\.json)$"), 3.0) + bonus(low.rlike(r"/(lib|mod)\.rs$"), 2.5) + bonus(low.rlike(r"/db\.rs|cache|database|storage"), 2.0)
    return score


#: (score, regular expression on a symbol's lower-cased name); a table, so that a user can set their own
SYMBOL_BONUS = [(6.0, "initialize|open"), (5.0, "config"), (3.0, "clear|delete|insert|upsert"), (-2.0, "count|stats")]


def symbol_relevance(name: Column, signature: Column, kind: Column, words: list[str], bonus=SYMBOL_BONUS) -> Column:
    score = hits(name, words, 2.0) + hits(F.coalesce(signature, F.lit("")), words, 1.0)
    score = score + F.when(kind.isin("class", "enum", "interface", "struct", "trait"), 2.5).otherwise(0.0)
    return reduce(lambda a, b: a + F.when(F.lower(name).rlike(b[1]), b[0]).otherwise(0.0), bonus, score)


def substring_score(name: Column, path: Column, signature: Column, kind: Column, query: str) -> Column:
    """5 for the whole query, and for each of its terms 3 in the name, 2 in the path, 1 in the signature."""
    words = [w for w in re.split(r"[\W_]+", query.lower()) if len(w.encode()) > 2]
    signature = F.coalesce(signature, F.lit(""))
    whole = F.lower(F.concat_ws(" ", name, path, signature, kind)).contains(query.lower())
    return F.when(whole, 5.0).otherwise(0.0) + hits(name, words, 3.0) + hits(path, words, 2.0) + hits(signature, words, 1.0)


def risk_score(changes: Column, lines: Column, impacted: Column, flows: Column, reasons: Column) -> Column:
    part = lambda c, n, most: F.least(c * n, F.lit(most))
    total = part(changes, 5, 25) + F.least(F.floor(lines / 40), F.lit(20)) + part(impacted, 2, 25) + part(flows, 8, 20) + part(reasons, 5, 20)
    return F.least(total, F.lit(100)).cast("long")


def risk_level(score: Column) -> Column:
    return F.when(score <= 24, "low").when(score <= 59, "medium").when(score <= 84, "high").otherwise("critical")


def metrics_risk(fan_in: Column, fan_out: Column, churn: Column, complexity: Column, symbols: Column) -> Column:
    return fan_in * 0.30 + fan_out * 0.15 + churn * 0.25 + complexity * 0.20 + F.when(symbols > 10, 0.10).otherwise(0.0)


def test_confidence(score: Column) -> Column:
    return F.when(score >= 10, "high").when(score >= 5, "medium").otherwise("low")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


#: Typographic signs and their ASCII spelling.
FOLDED = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "→": "->", "←": "<-", "…": "...", "•": "*", " ": " "}


def ascii_fold(text: Column) -> Column:
    for raw, plain in FOLDED.items():
        text = F.replace(text, F.lit(raw), F.lit(plain))
    return text


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for different or no dimensions and for a zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(0.0)


def hash_parts(token: Column, dims: int = 64) -> tuple[Column, Column]:
    """(bucket, signed weight) of a token from the first three bytes of its SHA-256."""
    h = F.sha2(token, 256)
    byte = lambda k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int")
    return byte(0) % dims, F.when(byte(1) % 2 == 0, 1.0).otherwise(-1.0) * (1 + byte(2) / F.lit(255.0))
