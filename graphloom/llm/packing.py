"""Packing documents into windows of fixed length by the sum-of-squares rule.

A text of n tokens fills n // window windows of its own; the rest is one piece. Pieces come in the order of a
hash of doc_id and go, one after the other and for good, where the sum over the fill levels 1 .. window - 1 of
(number of windows at the level) squared comes out smallest: into a window of some level that has room, or
into a new one. Levels and their numbers of windows are one array, so a piece costs one pass over the levels.
Among equal sums the fullest window wins, among the windows of one level the one filled last.

The pieces are spread over bins by a hash of doc_id, about BIN_DOCS documents each; every bin is packed on
its own, so the work spreads over the cluster and a bin leaves at most window - 1 windows part-filled levels.

Result of ``packed``: one row for each stretch of a document in a window: doc_id, piece (from 0), start_token,
tokens, window_id ("bin-number"), offset (where the stretch starts in its window).

Defined cases: a null or empty text has no tokens: one row with tokens 0 and a null window_id, so no document
is lost; a null doc_id is packed like others; rows of one doc_id are each packed (ties are ordered by their
text's hash).
"""

from __future__ import annotations

import os
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, staged, table
from ._tokens import TOKENIZERS, counter

WINDOW, BIN_DOCS = 2048, 20_000
VOCABULARY = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, piece int, start_token long, tokens int, window_id string, offset int"


class Levels:
    """Windows by fill level; ``place`` puts one piece and returns (window, offset)."""

    def __init__(self, window: int):
        self.window, self.made = window, 0
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def place(self, size: int) -> tuple[int, int]:
        c, top = self.count, self.window
        # growth of the sum of squares if a window of level h gets the piece; levels 0 and top don't count
        here = c[: top - size + 1]
        there = c[size:].copy()
        grow = 2 * (there - here) + 2
        grow[0] = 2 * there[0] + 1
        if size <= top:
            grow[top - size] = 1 - 2 * here[top - size] if top > size else 0
        grow[1:][here[1:] == 0] = np.iinfo(np.int64).max
        best = len(grow) - 1 - int(np.argmin(grow[::-1]))
        if best:
            window = self.open[best].pop()
            c[best] -= 1
        else:
            window, self.made = self.made, self.made + 1
        if best + size < top:
            c[best + size] += 1
            self.open[best + size].append(window)
        return window, best


def pack(ids: list, sizes: list[int], window: int, name: str) -> list[tuple]:
    """Rows of SCHEMA for one bin whose documents come in the given order."""
    levels, rows = Levels(window), []
    for doc, n in zip(ids, sizes):
        piece = 0
        for start in range(0, n - window + 1, window):
            rows.append((doc, piece, start, window, f"{name}-{levels.made}", 0))
            levels.made += 1
            piece += 1
        rest = n % window
        if rest:
            at, offset = levels.place(rest)
            rows.append((doc, piece, n - rest, rest, f"{name}-{at}", offset))
        elif not n:
            rows.append((doc, 0, 0, 0, None, None))
    return rows


def _pack_bin(t: pa.Table, window: int) -> pa.Table:
    t = t.sort_by([("key", "ascending"), ("th", "ascending"), ("tokens", "ascending")])
    name = str(t.column("bin")[0].as_py())
    rows = pack(t.column("doc_id").to_pylist(), t.column("tokens").to_pylist(), window, name)
    cols = list(zip(*rows))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32()]
    names = ["doc_id", "piece", "start_token", "tokens", "window_id", "offset"]
    return pa.table([pa.array(c, k) for c, k in zip(cols, types)], names=names)


def _count(batch: pa.RecordBatch, vocabulary: str, folder: str) -> pa.RecordBatch:
    n = counter(vocabulary, folder).count(batch.column("text"))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("th"), pa.array(n)], ["doc_id", "key", "th", "tokens"])


def packed(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, bin_docs: int = BIN_DOCS) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("doc_id").alias("key"), F.xxhash64("text").alias("th"), "text")
    sizes = staged(arrow_map(texts, partial(_count, vocabulary=vocabulary, folder=folder), "doc_id long, key long, th long, tokens long"), "sizes")
    bins = max(1, -(-sizes.count() // bin_docs))
    placed = sizes.withColumn("bin", F.pmod("key", F.lit(bins)))
    return placed.groupBy("bin").applyInArrow(lambda t: _pack_bin(t, window), SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), folder=os.environ.get("GRAPHLOOM_TOKENIZERS", TOKENIZERS))


QUERIES = {"op4_packing": op4_packing}
SQL: dict[str, str] = {}
