"""Continuous updates: a stream of changed files keeps the graph's tables current.

Every micro-batch is applied by key and content hash, so a batch that runs again after a failure changes
nothing, and a second edit of the same file is seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import paths


def changed(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose hash is new or differs."""
    return current.join(seen.select("path", F.col("hash").alias("__was")), "path", "left").filter(~F.col("hash").eqNullSafe(F.col("__was"))).drop("__was")


def vanished(current: DataFrame, seen: DataFrame) -> DataFrame:
    return seen.select("path").join(current.select("path"), "path", "left_anti")


#: Buckets of keys of a table.
BUCKETS = 32


def same_set(now: DataFrame, before: DataFrame) -> bool:
    """Whether two sets of (path, hash) are equal."""
    pick = lambda a, b: a.select("path", "hash").join(b.select("path", "hash"), ["path", "hash"], "left_anti").isEmpty()
    return pick(now, before) and pick(before, now)


def latest(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key within a micro-batch."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return batch.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


class Table:
    """A keyed table in BUCKETS buckets of keys. A micro-batch writes the buckets that it touches, once, under its
    number; the table is the newest copy of each bucket. The two newest copies of a bucket stay."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: list[str]):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self._names(self.path) if n.startswith("v-") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def _copies(self, before: int | None = None) -> dict[int, list[str]]:
        """Folders of each bucket, newest first."""
        out: dict[int, list[str]] = {}
        for v in reversed(self.versions()):
            if before is None or v < before:
                for n in self._names(f"{self.path}/v-{v}"):
                    if n.startswith("bucket="):
                        out.setdefault(int(n[7:]), []).append(f"{self.path}/v-{v}/{n}")
        return out

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        paths_ = [c[0] for b, c in sorted(self._copies(before).items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths_) if paths_ else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Rows of the batch replace older ones; the buckets before this batch are the base, also when it runs again."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]
        if not touched:
            return
        base = self.read(number, touched)
        rows = latest(base.unionByName(batch.select(*base.columns)), self.key, self.order)
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v-{number}")
        for copies in self._copies().values():
            for old in copies[2:]:
                self._fs.delete(self._path(old), True)


def watch(spark: SparkSession, source: str, schema: str, table: Table, checkpoint: str, on_batch: Callable[[int, int], None] | None = None, once: bool = True, interval: str = "1500 milliseconds", keep: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Follow a folder of Parquet change files into a table; ``once`` takes what is there and ends."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream = keep(stream) if keep else stream

    def apply(batch: DataFrame, number: int) -> None:
        table.merge(batch, number)
        if on_batch:
            on_batch(number, batch.select(table.key).distinct().count())

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def not_skipped(df: DataFrame) -> DataFrame:
    return df.filter(~paths.skipped_by_update(F.col("path")))


def windowed_counts(stream: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window and keys; rows that come later than ``late`` are dropped with the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("window"), *keys).count().selectExpr("window.start as start", *keys, "count as n")
