"""Runs that read what has come since the last one, the source keeping the place from run to run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_new(spark: SparkSession, folder: str, schema: str, checkpoint: str, apply: Callable[[DataFrame, int], None], by: str = "updated_at", max_files: int = 1000) -> None:
    """Apply what was added to a folder of Parquet files since the run before, in batches of ``max_files``, and store the mark.

    The checkpoint of the stream knows the files that were read, also those of a batch that broke off, which the next run gives to
    ``apply`` again with the same number: it must then change nothing (an upsert, or ``EventStore.merge``). A run without new files
    reads none. ``mark`` tells the latest value of ``by`` so far.
    """

    def step(batch: DataFrame, number: int) -> None:
        apply(batch, number)
        latest = batch.agg(F.max(by).cast("timestamp_ntz").alias("mark")).withColumn("batch", F.lit(number).cast("bigint"))
        latest.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{checkpoint}-marks")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def mark(spark: SparkSession, checkpoint: str, overlap_seconds: int = 120) -> object:
    """The time to ask a server from: the latest value read less the overlap; null before the first run."""
    try:
        rows = spark.read.schema("mark timestamp_ntz, batch bigint").parquet(f"{checkpoint}-marks")
    except AnalysisException:  # no run yet
        return None
    return rows.agg((F.max("mark") - F.expr(f"INTERVAL {overlap_seconds} SECONDS")).alias("m")).first()["m"]
