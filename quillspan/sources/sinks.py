"""Sinks: upserts, frozen tables, and manifests of digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one of largest order; properties (a map column ``props``) are merged, later values win."""
    entries = F.array_sort(F.collect_list(F.struct(order, F.map_entries("props").alias("props"))))  # maps have no order, their entries do
    rows = old.unionByName(new).groupBy(key).agg(entries.alias("rows"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    # later entries replace earlier ones of the same name
    def join(acc, r):
        new = F.map_from_entries(r["props"])
        return F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(new, k)), new)

    return rows.select(key, F.aggregate("rows", none, join).alias("props"))


def manifest(df: DataFrame, columns: list[str]) -> tuple[int, str]:
    """Number of rows and a digest of a table that doesn't depend on their order: the sum of the rows' hashes and their exclusive or."""
    h = F.xxhash64(*columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return row["n"], f"{(row['x'] or 0) & (2**64 - 1):016x}{int(row['s'] or 0) & (2**64 - 1):016x}"


def write_frozen(df: DataFrame, path: str) -> bool:
    """Writes a table once. Writing the same rows again changes nothing (False); other rows raise ValueError."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        old = spark.read.parquet(path)
        if old.columns != df.columns or manifest(old, old.columns) != manifest(df, df.columns):
            raise ValueError(f"{path} is frozen with other rows")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True
