"""Resumable work as a stream: files that arrive are answered once and upserted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def drain(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str) -> StreamingQuery:
    """Runs ``work`` on the new rows of the Parquet folder ``source`` and appends to ``out``, then ends.

    Keys that ``out`` has already are left out, so that a batch repeated after a failure adds nothing twice.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        from lectern.sources.writers import pending

        new = pending(spark, batch.dropDuplicates([key]), out, key)
        work(new).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by window and type, for late rows up to ``late``; the same plan serves tables and streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
