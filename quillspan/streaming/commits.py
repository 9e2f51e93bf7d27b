"""A sink that survives restarts: every key once, whatever is killed or sent again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders by which keys are told apart in the output.
BUCKETS = 16


def committed(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """What whole batches (numbered below ``before``, if given) have written; null if there is none. A batch that was killed has no mark of success and isn't read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    whole = [s.getPath() for s in store.listStatus(path) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    own = [p for p in whole if before is None or int(p.getName().removeprefix("batch=")) < before]
    names = [p.toString() for p in own if len(store.listStatus(p)) > 1]  # a batch without new keys has its mark only
    return spark.read.option("basePath", out).parquet(*names) if names else None


def process_once(stream: DataFrame, key: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
    """Starts a query that writes ``work`` of every key of the stream once, and ends when nothing is left.

    A batch is written to a folder of its own number, over what a killed run of the same
    batch left there, so a batch that is sent again changes nothing.  Keys that earlier
    batches have written are left out; only the buckets of the batch's own keys are read
    for that.  ``work`` keeps the key.  A new checkpoint on an old output goes on after
    the batches that are there.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    done_before = committed(spark, out)
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    fresh = not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    shift_file = spark._jvm.org.apache.hadoop.fs.Path(checkpoint + "-first")
    store = shift_file.getFileSystem(spark._jsc.hadoopConfiguration())
    if fresh:  # numbers of this checkpoint's batches begin after those of an older one
        taken = [int(s.getPath().getName().removeprefix("batch=")) for s in store.listStatus(spark._jvm.org.apache.hadoop.fs.Path(out))] if done_before is not None else []
        first = max(taken, default=-1) + 1
        stream_out = store.create(shift_file, True)
        stream_out.writeUTF(str(first))
        stream_out.close()
    reader = store.open(shift_file)
    first = int(reader.readUTF())
    reader.close()

    def batch(rows: DataFrame, batch_id: int) -> None:
        number = first + batch_id
        rows = rows.withColumn("bucket", bucket).dropDuplicates([key])
        old = committed(rows.sparkSession, out, number)
        if old is not None:
            own = [r[0] for r in rows.select("bucket").distinct().collect()]  # of `buckets` numbers
            rows = rows.join(old.where(F.col("bucket").isin(own)).select("bucket", key), ["bucket", key], "left_anti")
        result = work(rows.drop("bucket")).withColumn("bucket", bucket)
        result.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
