"""Sources: a source tree, version control, rule and alias files."""

from __future__ import annotations

import json
import os
import re
import subprocess
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..schema import GIT_CHANGES

MOST_BYTES = 1 << 20


def ignore_file(root: str, name: str = ".graphloomignore") -> list[str]:
    """Patterns of an ignore file without blanks and comments; none if there is no file."""
    path = os.path.join(root, name)
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [x for x in (line.strip() for line in f) if x and not x.startswith("#")]


def scan(spark: SparkSession, root: str, preset: str | None = None, more: list[str] = ()) -> DataFrame:
    """Files of a tree that are worth parsing: path, language, hash, size_bytes, loc, text.

    Left out: ignored and hidden paths (but .env*), unknown languages, more than 1 MiB, empty files (Spark doesn't list them). Filters on path and
    length are checked before contents are decoded."""
    root = os.path.abspath(root)
    extra = [*more, *ignore_file(root)]
    git = [p for p in ignore_file(root, ".gitignore") if not p.startswith("!")]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load("file://" + root).filter(F.col("length") <= MOST_BYTES)
    rel = F.expr(f"substring(path, instr(path, '{root}/') + {len(root) + 1})")
    rows = raw.select(rel.alias("path"), "length", "content")
    name = F.element_at(F.split("path", "/"), -1)
    under = paths.either(paths.ignore_match(F.col("path"), p.lstrip("/")) | F.concat(F.lit("/"), F.col("path")).contains("/" + p.strip("/") + "/") if "*" not in p else paths.ignore_match(name, p) for p in git)
    keep = ~paths.ignored(F.col("path"), extra, preset) & ~under & (~F.col("path").startswith(".") | F.col("path").startswith(".env"))
    rows = rows.filter(keep).withColumn("language", paths.language(F.col("path"))).filter("language != 'unknown'")
    text = F.decode("content", "UTF-8")
    lines = F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n")))
    return rows.select("path", "language", F.sha2("content", 256).alias("hash"), F.col("length").alias("size_bytes"), lines.cast("long").alias("loc"), text.alias("text"))


def git(root: str, *args: str) -> list[str]:
    out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout
    return [line for line in out.split("\n") if line]


def is_git_repo(root: str) -> bool:
    return os.path.isdir(os.path.join(root, ".git"))


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "value string")


def diff(spark: SparkSession, names: list[str], numbers: list[str]) -> DataFrame:
    """path, status, lines_added, lines_deleted from the lines of --name-status and --numstat; renames keep the old
    path, binary files count 0."""
    cols = F.split("value", "\t")
    status = _lines(spark, names).select(F.get(cols, F.lit(1)).alias("path"), cols[0].alias("status"))
    num = lambda k: F.coalesce(F.expr(f"try_cast(split(value, '\t')[{k}] as bigint)"), F.lit(0).cast("long"))
    stat = _lines(spark, numbers).select(F.get(cols, F.lit(2)).alias("path"), num(0).alias("lines_added"), num(1).alias("lines_deleted"))
    return with_sizes(status, stat)


def with_sizes(status: DataFrame, stat: DataFrame) -> DataFrame:
    """path, status, lines_added, lines_deleted; 0 where the sizes have no row for a path."""
    zero = F.lit(0).cast("long")
    return status.join(stat, "path", "left").select("path", "status", F.coalesce("lines_added", zero).alias("lines_added"), F.coalesce("lines_deleted", zero).alias("lines_deleted"))


def diff_files(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    span = f"{base}...{head}"
    return diff(spark, git(root, "diff", "--name-status", span), git(root, "diff", "--numstat", span))


def log(spark: SparkSession, lines: list[str]) -> DataFrame:
    """hash, author, date, message from lines of --format=%H|%an|%aI|%s; the message may hold bars."""
    p = F.split("value", r"\|", 4)
    return _lines(spark, lines).filter(F.size(p) == 4).select(*[p[k].alias(c) for k, c in enumerate(("hash", "author", "date", "message"))])


def blame(spark: SparkSession, lines: list[str]) -> DataFrame:
    """line, hash, author, text from git blame --porcelain."""
    rows, authors, commit = [], {}, ""
    for line in lines:
        if re.fullmatch(r"[0-9a-f]{40} \d+ \d+( \d+)?", line):
            commit = line[:40]
        elif line.startswith("author "):
            authors[commit] = line[7:]
        elif line.startswith("\t"):
            rows.append((len(rows) + 1, commit, authors.get(commit, ""), line[1:]))
    return spark.createDataFrame(rows, "line int, hash string, author string, text string")


def churn(changes: DataFrame) -> DataFrame:
    """Commits that added or changed each path. changes: path, status (A, M and so on), one row for each commit."""
    return changes.filter(F.col("status").isin("A", "M")).groupBy("path").agg(F.count("*").alias("churn"))


def name_status(spark: SparkSession, lines: list[str]) -> DataFrame:
    """path, status from lines of --name-status."""
    p = F.split("value", "\t")
    return _lines(spark, lines).filter(F.size(p) > 1).select(p[1].alias("path"), p[0].alias("status"))


def owners(commits: DataFrame) -> DataFrame:
    """(path, owner, commits): the author with most commits of each path, the first of equals. commits: path, author."""
    n = commits.groupBy("path", "author").count()
    best = n.groupBy("path").agg(F.min_by(F.struct("author", "count"), F.struct(-F.col("count"), "author")).alias("b"))
    return best.select("path", F.col("b.author").alias("owner"), F.col("b.count").alias("commits"))


def changed_paths(spark: SparkSession, porcelain: list[str], names: list[str], skip: bool = False) -> DataFrame:
    """Union of a working tree's status lines (renames give the new path) and a diff's names."""
    tree = _lines(spark, porcelain).select(F.element_at(F.split(F.expr("substring(value, 4)"), " -> "), -1).alias("path"))
    both = union_of(tree, _lines(spark, names).toDF("path"))
    return both.filter(~paths.skipped_by_update(F.col("path"))) if skip else both


def union_of(*sets: DataFrame) -> DataFrame:
    """Distinct normalised paths (column path) of several change sets."""
    both = reduce(DataFrame.union, [x.select("path") for x in sets])
    return both.select(paths.normalize(F.regexp_replace("path", '^"|"$', "")).alias("path")).filter("path != ''").distinct()


def tsconfig_aliases(spark: SparkSession, text: str) -> DataFrame:
    """alias, target of compilerOptions.paths: the first target, without /*."""
    found = json.loads(text).get("compilerOptions", {}).get("paths", {})
    rows = [(a.removesuffix("/*"), t[0].removesuffix("/*")) for a, t in found.items() if t]
    return spark.createDataFrame(rows, "alias string, target string")


def rules_from_json(text: str) -> list[tuple]:
    """Rules as operators.review takes them; YAML files are read where a YAML reader is installed."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    return [(r["name"], r.get("severity", "error"), r.get("from"), r.get("to"), r.get("path"), r.get("max_lines")) for r in data.get("rules", [])]


def no_changes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], GIT_CHANGES)
