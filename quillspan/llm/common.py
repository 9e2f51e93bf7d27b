"""Helpers shared by the operators: shared storage, materialisation, joins with hot keys, splitting of long batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one row in so many is hot, so there are fewer hot keys than this, whatever the input.
HOT_KEYS = 20_000


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder URI below the checkpoint folder that all executors share.

    The folder comes from ``spark.checkpoint.dir`` (or a folder already set on the
    context).  Where neither is set, a local session (a test, a laptop) gets a temporary
    one; a cluster is refused, as its executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillspan/{tag}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, and lost executors lose nothing.

    The folder goes away with the application, or with ``discard``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    store, where = _store(spark, path)
    store.deleteOnExit(where)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``materialize`` that no later step reads."""
    for table in tables:
        store, where = _store(table.sparkSession, table.written_to)
        store.delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` left-joined with ``table`` on a string key that may be hot, or null, in ``rows``; no other column is in both.

    ``table`` has each key once and, in ``weight``, how many rows have it.  Keys with
    more than one row in HOT_KEYS of all are fewer than HOT_KEYS by counting; they are
    broadcast.  What they and null keys don't claim is joined by key, where no key is
    hot any more; rows already claimed go past that join under keys of their own.
    """
    total, n = table.agg(F.sum(weight), F.count(F.lit(1))).first()
    values = [c for c in table.columns if c not in (key, weight)]
    if n <= HOT_KEYS:
        return rows.join(F.broadcast(table.drop(weight)), key, "left")
    is_hot = F.col(weight) > total / HOT_KEYS
    hot, own, cold, found = (unused(rows.join(table, key, "left"), name) for name in ("hot_values", "own_key", "cold_values", "found_values"))
    first = rows.join(F.broadcast(table.where(is_hot).select(key, F.struct(*values).alias(hot))), key, "left")
    alone = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    spread = first.withColumn(own, F.when(F.col(hot).isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(alone))
    rest = table.where(~is_hot).select(F.col(key).alias(own), F.struct(*values).alias(cold))
    both = spread.join(rest, own, "left").withColumn(found, F.coalesce(hot, cold))
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(found)[c].alias(c) for c in values))


def pieces_of(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the given string column holds about ``max_bytes`` at most in each (one row at least)."""
    for batch in batches:
        if batch.num_rows and batch.column(column).nbytes > max_bytes:
            rows = max(1, batch.num_rows * max_bytes // batch.column(column).nbytes)
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
        elif batch.num_rows:
            yield batch


def map_rows(make: Callable[[], Callable], schema: pa.Schema, text_column: int = 1) -> Callable:
    """A ``mapInArrow`` function: ``make()`` runs once in each task and returns a function from one row's values to a tuple."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in pieces_of(batches, text_column):
            rows = [each(*values) for values in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run
