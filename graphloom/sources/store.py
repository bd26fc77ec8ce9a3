"""The tables of an indexed code base, kept as Parquet versions under one folder.

A table is replaced by writing a new version beside the old one; its number in the file CURRENT makes it the one that is
read. The last version but one stays until the next write, so that readers end in peace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble
from ..runtime import file_system
from . import sinks


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/{name}")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and fs.exists(file_system(self.spark, f"{self.path}/{name}/{n}/_SUCCESS")[1]))

    def has(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/v-{self._versions(name)[-1]}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """A new version; it counts from its _SUCCESS file on."""
        old = self._versions(name)
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/v-{(old[-1] if old else 0) + 1}")
        fs, _ = file_system(self.spark, self.path)
        for v in old[:-1]:
            fs.delete(file_system(self.spark, f"{self.path}/{name}/v-{v}")[1], True)
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        return self.write(name, self.read(name).unionByName(rows) if self.has(name) else rows)

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        return self.write(name, sinks.upsert(self.read(name), rows, keys) if self.has(name) else rows)

    def replace_by(self, name: str, rows: DataFrame, key: str, touched: DataFrame) -> DataFrame:
        return self.write(name, sinks.replace_by(self.read(name), rows, key, touched) if self.has(name) else rows)

    def delete_edges(self, name: str, kind: str, sources: DataFrame | None = None) -> DataFrame:
        """Edges of a kind go, or those of them that leave the sources (column src)."""
        return self.write(name, sinks.without(self.read(name), kind, sources))

    def set_config(self, key: str, value: str) -> None:
        self.upsert("config", self.spark.createDataFrame([(key, value)], "key string, value string"), ["key"])

    def get_config(self, key: str, default: str | None = None) -> str | None:
        row = self.read("config").filter(F.col("key") == key).first() if self.has("config") else None
        return row.value if row else default

    def index(self, files: DataFrame) -> dict[str, int]:
        """Bring the tables up to date with a scan (path, language, hash, size_bytes, loc, text); what was done."""
        if not self.has("files"):
            tables = assemble.index(files)
            done = {"added": files.count(), "changed": 0, "removed": 0}
        else:
            names = ["files", "symbols", "imports", "calls"]
            tables, report = assemble.reindex(files, {n: self.read(n) for n in names})
            done = {k: v.count() for k, v in report.items()}
        self.set_config("graph", "dirty")
        for name, df in tables.items():
            self.write(name, df)
        self.set_config("graph", "current")
        return done

    def graph(self) -> assemble.Graph:
        return assemble.graph({n: self.read(n) for n in ("files", "symbols", "import_edges", "call_edges", "file_calls")})

    def views(self, prefix: str = "") -> list[str]:
        """Every table as a temporary view, for queries in SQL."""
        fs, at = file_system(self.spark, self.path)
        names = [n for n in (s.getPath().getName() for s in fs.listStatus(at)) if self.has(n)]
        for n in names:
            self.read(n).createOrReplaceTempView(prefix + n)
        return sorted(prefix + n for n in names)
