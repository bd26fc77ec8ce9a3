"""Token counts as rollups that are kept up to date by deltas.

Totals of documents and tokens by source, language and tokenizer version are sums, so a change is a signed
delta: an insert adds (+1, +tokens), a delete (-1, -tokens), a revised count (0, new - old); a document that
changes its source or language is a delete and an insert. A batch of changes is reduced to one row for each
group and written to a folder of its own; the commit is a small file, named after the batch, that names the folder and
is moved to its place only if none is there, as the commit logs of streaming queries are. A batch that is delivered
again, or was cut off before its commit, is therefore counted once.

``apply_batch`` adds a batch, ``totals`` reads the sums over all committed batches, ``compact`` folds them into
one file set with a note of the batches that it holds.

Changes have the columns change (insert, delete, revise), doc_id, source, lang, version, tokens and, for a
revision, old_tokens.

Defined cases: a null source, language or version is a group of its own; null tokens count as 0; a group
whose documents and tokens come to 0 isn't reported; an empty batch commits and changes nothing; an unknown
change raises an error; equal rows in one batch are separate changes.
"""

from __future__ import annotations

import os
import time
import uuid
from functools import partial

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, discard, shared_dir, staged, table
from ._tokens import TOKENIZERS, counter

GROUP = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"
VOCABULARIES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def deltas(changes: DataFrame) -> DataFrame:
    """One row for each group that the changes touch."""
    sign = F.when(F.col("change") == "insert", 1).when(F.col("change") == "delete", -1).when(F.col("change") == "revise", 0)
    sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("change", F.lit("null")))).cast("int"))
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    moved = F.when(F.col("change") == "revise", new - old).otherwise(sign * new)
    return changes.groupBy(*GROUP).agg(F.sum(sign).cast("long").alias("docs"), F.sum(moved).cast("long").alias("tokens"))


class Store:
    """Deltas under ``path``: a folder of rows for each batch or compaction, and the files that commit them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._hadoop.Path(self.path)
        self._fs, self._files = root.getFileSystem(conf), self._hadoop.FileContext.getFileContext(root.toUri(), conf) if root.toUri().getScheme() else self._hadoop.FileContext.getFileContext(conf)
        self._fs.mkdirs(root)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _names(self, start: str) -> list[str]:
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if n.startswith(start))

    def _folder(self, commit: str) -> str:
        stream = self._fs.open(self._at(commit))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _parts(self) -> tuple[str | None, list[int]]:
        """The newest compaction and the committed batches that it doesn't hold."""
        base = max(self._names("upto-"), key=_number, default=None)
        low = _number(base) if base else -1
        return base, sorted(b for b in map(_number, self._names("batch-")) if b > low)

    def committed(self, batch: int) -> bool:
        base, more = self._parts()
        return batch in more or bool(base and batch <= _number(base))

    def apply_batch(self, batch: int, changes: DataFrame) -> bool:
        """True if the batch was committed now, False if it had been before."""
        if self.committed(batch):
            return False
        return self._write(deltas(changes), f"batch-{batch}")

    def _write(self, df: DataFrame, commit: str) -> bool:
        own = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data-{own}")
        stream = self._fs.create(self._at(f"tmp-{own}"), False)
        stream.write(bytearray(f"data-{own}".encode()))
        stream.close()
        kinds = getattr(self._hadoop, "Options$Rename")
        option = self.spark.sparkContext._gateway.new_array(kinds, 1)
        option[0] = kinds.NONE
        try:
            self._files.rename(self._at(f"tmp-{own}"), self._at(commit), option)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            for name in (f"tmp-{own}", f"data-{own}"):  # another writer committed the same batch first
                self._fs.delete(self._at(name), True)
            return False
        return True

    def _rows(self, base: str | None, batches: list[int]) -> DataFrame | None:
        paths = [f"{self.path}/{self._folder(n)}" for n in ([base] if base else []) + [f"batch-{b}" for b in batches]]
        if not paths:
            return None
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        rows = self._rows(*self._parts())
        return self.spark.createDataFrame([], SCHEMA) if rows is None else rows.filter("docs != 0 or tokens != 0")

    def compact(self, upto: int) -> None:
        """Fold the batches up to ``upto``, none of which may come later; their rows stay until ``sweep``."""
        base, more = self._parts()
        rows = self._rows(base, [b for b in more if b <= upto])
        if rows is not None:
            self._write(rows, f"upto-{upto}")

    def sweep(self, age: float = 86_400) -> None:
        """Remove what the newest compaction holds, and what writers left uncommitted that began ``age`` seconds ago or more."""
        base, _ = self._parts()
        low = _number(base) if base else -1
        for name in [*self._names("batch-"), *self._names("upto-")]:
            if name != base and _number(name) <= low:
                folder = self._folder(name)
                self._fs.delete(self._at(name), False)
                self._fs.delete(self._at(folder), True)
        live = {self._folder(n) for n in [*self._names("batch-"), *self._names("upto-")]}
        for name in [*self._names("data-"), *self._names("tmp-")]:
            if name not in live and self._fs.getFileStatus(self._at(name)).getModificationTime() <= (time.time() - age) * 1000:
                self._fs.delete(self._at(name), True)


def _number(name: str) -> int:
    return int(name.split("-")[1])


def _count(batch: pa.RecordBatch, vocabularies: list[str], folder: str) -> pa.RecordBatch:
    """A row for each text and vocabulary."""
    keep = [c for c in batch.schema.names if c != "text"]
    parts = []
    for v in vocabularies:
        n = counter(v, folder).count(batch.column("text"))
        parts.append(pa.table([*(batch.column(c) for c in keep), pa.array([v] * batch.num_rows, pa.string()), pa.array(n)], names=[*keep, "version", "tokens"]))
    return pa.concat_tables(parts).combine_chunks().to_batches()[0]


def counted(docs: DataFrame, vocabularies: list[str] = VOCABULARIES, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, source, lang, version and exact tokens of each document, under each vocabulary."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, partial(_count, vocabularies=vocabularies, folder=folder), "doc_id long, source string, lang string, version string, tokens long")


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under two tokenizer versions, those of bad quality by the labels are deleted, and the
    counts of the others are revised (one end-of-text token each); the delete batch is delivered twice, and two
    batches are folded."""
    docs = table(spark, sf_dir, "documents")
    rows = staged(counted(docs, folder=os.environ.get("GRAPHLOOM_TOKENIZERS", TOKENIZERS)), "counted")
    store = Store(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    none = F.lit(None).cast("long").alias("old_tokens")
    store.apply_batch(0, rows.select(F.lit("insert").alias("change"), "*", none))
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    gone = rows.join(bad, "doc_id", "left_semi").select(F.lit("delete").alias("change"), "*", none)
    store.apply_batch(1, gone)
    store.apply_batch(1, gone)
    left = rows.join(bad, "doc_id", "left_anti")
    revised = left.select(F.lit("revise").alias("change"), "doc_id", *GROUP, (F.col("tokens") + 1).alias("tokens"), F.col("tokens").alias("old_tokens"))
    store.apply_batch(2, revised)
    store.compact(1)
    discard(rows)
    return store.totals()


QUERIES = {"op9_token_rollup": op9_token_rollup}
SQL: dict[str, str] = {}
