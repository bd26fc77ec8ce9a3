"""Tables written to the folder that all executors share, to cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own if all runs on one machine (tests), an error on a
    cluster, whose executors couldn't read each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a copy in the shared folder; the copy goes with the application, or before it by ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove written copies that nothing reads any more."""
    for t in tables:
        fs, at = file_system(t.sparkSession, t.written_at)
        fs.delete(at, True)


def bucketed(df: DataFrame, name: str, key: str, order: str, made=lambda df: df) -> DataFrame:
    """What is ``made`` of ``df`` after its rows went to their buckets, from a copy in the shared folder, in as many buckets of ``key`` as a shuffle has partitions, so that joins on
    the key don't move it. Spark keeps buckets for tables only, so the copy is one until ``forget``."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    count, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shared_dir(spark)}/{table}"
    made(df.repartition(count, key)).write.bucketBy(count, key).sortBy(order).option("path", path).saveAsTable(table)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.table(table)
    out.table = table
    return out


def forget(*tables: DataFrame) -> None:
    """Take bucketed copies out of the catalog; their files stay until the application ends."""
    for t in tables:
        t.sparkSession.sql(f"drop table {t.table}")
