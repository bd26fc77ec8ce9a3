"""Queries that run a stream to its end and return the table it keeps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir
from ..sources.tables import read
from ..streaming import watch

_CHANGES = "path string, event_type string, ts timestamp_ntz, event_id long"


def watch_stream(spark: SparkSession, d: str) -> DataFrame:
    """The change stream of ``events``, one micro-batch after the other, kept as the last change of each path."""
    base = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
    read(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id").write.parquet(f"{base}/in")
    table = watch.Table(spark, f"{base}/table", _CHANGES, "path", ["ts", "event_id"])
    watch.watch(spark, f"{base}/in", _CHANGES, table, f"{base}/checkpoint").awaitTermination()
    return table.read().select("path", "event_type", "event_id")


QUERIES = {"watch_stream": watch_stream}
SQL = {"watch_stream": "select path, event_type, event_id from (select cast(user_id as varchar) as path, event_type, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1"}
