"""A stored inverted index: terms, their postings and the collection's numbers, as Parquet in buckets of terms.

A query reads the buckets of its terms only, so it costs what its postings cost and not what the corpus does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import K1, B

BUCKETS = 64


def documents(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(node, kind, content): of each file its path, what it imports and its text; of each symbol its name, path,
    signature, documentation and what its file imports. files: node, path, text; symbols: node, kind, path, name, signature,
    doc_comment; imports: path, target."""
    named = imports.groupBy("path").agg(F.concat_ws(" ", F.array_sort(F.collect_list("target"))).alias("targets"))
    own = files.join(named, "path", "left").select("node", F.lit("file").alias("kind"), F.concat_ws(" ", "path", "targets", "text").alias("content"))
    parts = symbols.join(named, "path", "left").select("node", "kind", F.concat_ws(" ", "name", "path", "signature", "doc_comment", "targets").alias("content"))
    return own.unionByName(parts)


#: What is no ASCII letter or digit parts words; all bytes of other characters are beyond ASCII.
_WORDS = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_CHUNK = 1 << 19


def _counting():
    """The pass over documents. A document is one row, so that its counts are complete here and need no shuffle. A function
    within one goes to the workers as it is; they needn't have the package."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies, texts = batch.columns
            first, terms, tf, length, times = 0, [], [], [], []
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                words = (text or b"").translate(_WORDS).split()
                found = Counter(words)
                terms.append(b"")
                terms.extend(found)
                tf.append(1)
                tf.extend(found.values())
                length.append(None if text is None else len(words))
                times.append(len(found) + 1)
                if len(terms) >= _CHUNK or k == batch.num_rows - 1:
                    at = pa.array(np.repeat(np.arange(len(times)), times))
                    own = [c.take(at) for c in (keys.slice(first, len(times)), copies.slice(first, len(times)), pa.array(length, pa.int32()))]
                    out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *own[:2], pa.array(tf, pa.int32()), own[2]], ["term", "key", "copy", "tf", "len"])
                    yield out.take(pc.array_sort_indices(out.column(0)))  # Spark's sort merges runs that are in order
                    first, terms, tf, length, times = k + 1, [], [], [], []

    return counted


def postings(docs: DataFrame, key: str = "node", text: str = "content", repeated: bool = False) -> DataFrame:
    """(term, key, copy, tf, len): terms are runs of ASCII letters and digits, lower-cased. Each document has a row with
    the term '' too, whose len is null if it has no text. repeated: documents may share a key; copy tells them apart."""
    copy = F.monotonically_increasing_id() if repeated else F.lit(0).cast("long")
    rows = docs.select(F.col(key).alias("key"), copy.alias("copy"), F.lower(F.col(text)).cast("binary").alias("text"))
    return rows.mapInArrow(_counting(), f"term string, key {rows.schema['key'].dataType.simpleString()}, copy long, tf int, len int")


class Index:
    """The index under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, docs: DataFrame, key: str = "node", text: str = "content") -> "Index":
        """Write the index anew. Documents without a term count for the collection all the same.

        Postings are shuffled once, by bucket; a bucket that is large is written by several tasks."""
        repeated = not docs.groupBy(key).count().filter("count > 1").isEmpty()
        rows = postings(docs, key, text, repeated)
        # a row that is of no document (tf 0), so that an empty index has a schema too
        rows = rows.unionByName(self.spark.range(1).select(F.lit("").alias("term"), F.lit(None).cast(rows.schema["key"].dataType).alias("key"), F.lit(0).cast("long").alias("copy"), F.lit(0).alias("tf"), F.lit(None).cast("int").alias("len")))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        rows.hint("rebalance", 4 * BUCKETS, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        numbers = self._of([""]).agg(F.sum("tf").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean"), F.lit(repeated).alias("repeated"))
        numbers.write.mode("overwrite").parquet(f"{self.path}/numbers")
        return self

    def _all(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def read(self) -> DataFrame:
        return self._all().filter("term != ''")

    def terms(self) -> DataFrame:
        """(term, docs, uses): how many keys have the term, and how often it occurs."""
        rows = self.read()
        if self.spark.read.parquet(f"{self.path}/numbers").first().repeated:
            rows = rows.groupBy("term", "key").agg(F.sum("tf").alias("tf"))
        return rows.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))

    def clear(self) -> None:
        self.build(self.spark.createDataFrame([], "node string, content string"))

    def _of(self, words: list[str]) -> DataFrame:
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(BUCKETS)).cast("int") for w in words]))).collect()]
        return self._all().filter(F.col("bucket").isin(buckets) & F.col("term").isin(words))

    def of(self, words: list[str]) -> DataFrame:
        """Postings of the words, from their buckets alone."""
        return self._of(words).filter("term != ''")

    def bm25(self, query: str, limit: int) -> DataFrame:
        """(key, score) of the documents that have all terms of the query, best first."""
        words = list(dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())))
        if not words:
            return self.read().select("key", F.lit(0.0).alias("score")).limit(0)
        rows = self.of(words)
        df = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the query
        numbers = self.spark.read.parquet(f"{self.path}/numbers")
        idf = df.crossJoin(F.broadcast(numbers)).select("term", "mean", F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)).alias("idf"))
        tf = F.col("tf")
        part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        # parts are added in the query's order, so that equal documents get equal scores to the last bit
        parts = [F.max(F.when(F.col("term") == w, part)) for w in words]
        hits = rows.join(F.broadcast(idf), "term").groupBy("key", "copy").agg(reduce(lambda a, b: a + b, parts).alias("score"), F.count("*").alias("found"))
        return hits.filter(F.col("found") == len(words)).select("key", "score").orderBy(F.desc("score"), "key").limit(limit)
