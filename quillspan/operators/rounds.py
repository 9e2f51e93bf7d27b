"""Iterations over tables: each round is written to a folder that all executors share, so lineage ends there and a restart goes on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that isn't set, a local session gets a temporary one and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillspan/{tag}-{uuid.uuid4().hex}"


class Rounds:
    """Named tables in a folder.  A folder given by the caller stays, and what is whole in it isn't made again; an own one goes away with the application."""

    def __init__(self, spark: SparkSession, tag: str = "rounds", folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_folder(spark, tag)
        store, path = self._at("")
        if folder is None:
            store.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, name: str) -> bool:
        store, path = self._at(f"{name}/_SUCCESS")
        return store.exists(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def keep(self, name: str, make: DataFrame | Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, written now unless it is whole already; a half-written one is replaced."""
        if self.has(name):
            return self.read(name)
        table = make if isinstance(make, DataFrame) else make()
        table.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(table.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later round reads."""
        for name in names:
            store, path = self._at(name)
            store.delete(path, True)


def union_all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out
