"""Rate windows, budgets and resumable work, on tables and on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Seconds of a block of time, in which a key's rows meet (longer windows make longer blocks).
BLOCK_SECONDS = 3600


def rolling_sum(df: DataFrame, key: str, ts: str, value: str, seconds: int = 61, name: str = "used") -> DataFrame:
    """Adds the sum of a key's values in the last ``seconds`` (the row itself included, the far edge not).

    Time is cut into blocks; a row that a window of the next block may reach is repeated
    there for its value alone, so a key with very many rows is no single task's.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    block = max(BLOCK_SECONDS, seconds) * 1_000_000
    timed = df.withColumns({"__at": micros, "__block": F.floor(micros / F.lit(block))})
    reaches = F.col("__at") + seconds * 1_000_000 > (F.col("__block") + 1) * block
    places = F.when(reaches, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = timed.withColumn("__later", F.explode_outer(places)).withColumn("__block", F.coalesce(F.col("__block") + F.col("__later"), F.lit(0)))
    window = Window.partitionBy(key, "__block").orderBy("__at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return dealt.withColumn(name, F.sum(value).over(window)).where("__later = 0").drop("__at", "__block", "__later")


def ledger(df: DataFrame, key: str, order: str, cost: str, limit: float) -> DataFrame:
    """Which calls a spend limit admits, one after another: a call that would exceed it is refused and costs nothing.

    Columns: key, order, admitted, spent after the call.  Each decision needs the one
    before it, so a ledger's calls stream, sorted, through one task with one sum as its
    state; nothing is held.  Amounts are decimals, so that sums are exact; a null amount
    is refused.
    """
    kinds = dict(df.dtypes)
    most = Decimal(str(limit))
    dealt = df.select(key, order, F.col(cost).cast("decimal(20,6)").alias("cost")).repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, spent = None, Decimal(0)
        for batch in batches:
            admitted, sums = [], []
            for owner, amount in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (owner,) != last:
                    last, spent = (owner,), Decimal(0)
                fits = amount is not None and spent + amount <= most
                spent = spent + amount if fits else spent
                admitted.append(fits)
                sums.append(spent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(admitted, pa.bool_()), pa.array(sums, pa.decimal128(20, 6))], names=[key, order, "admitted", "spent"])

    return dealt.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean, spent decimal(20,6)")


def windowed_rates(stream: DataFrame, key: str, ts: str, value: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Sums and counts per key and tumbling window; rows later than the watermark are left out. For streams and tables."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", window).alias("w"), key).agg(F.sum(value).alias("used"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "used", "n")


def resume(stream: DataFrame, done_path: str, key: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]):
    """Processes each item of a stream once over all restarts: a batch skips the keys that ``done_path`` holds already.

    Returns the started query; results are appended to ``done_path`` as Parquet.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        try:
            done = spark.read.parquet(done_path).select(key)
            df = df.join(done, key, "left_anti")
        except Exception as e:  # the first batch finds no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(df.dropDuplicates([key])).write.mode("append").parquet(done_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
