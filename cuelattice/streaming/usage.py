"""Streaming forms of the usage history and of event sessions (an extension of the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; state older than ``late`` is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, keys: list[str], time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of rows at most ``gap`` apart, with their size: the streaming form of joined regions."""
    s = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def commit(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key isn't in ``target`` yet; a batch that is replayed writes the same folder again.

    Each micro-batch owns the folder of its number and overwrites it, so a retry can't add twice;
    keys already committed by other batches are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            done = spark.read.option("basePath", target).parquet(target).where(F.col("batch") != number).select(key).distinct()
            rows = rows.join(done, key, "left_anti")
        except Exception as e:  # no batch committed yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
