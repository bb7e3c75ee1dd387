"""Structured Streaming: clouds scored as they land, and live run metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.classes import RUNLOG_SCHEMA
from ..sources.clouds import number_lines, unlabelled_points


def score_stream(spark: SparkSession, landing: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Score every new cloud file once and append it to a Parquet table.

    A file is atomic, so its features are complete within the micro-batch.  The
    batch number is a partition of the table and a batch that is run again
    replaces it.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(landing)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_s"))

    def each(batch: DataFrame, number: int) -> None:
        numbered = number_lines(batch.withColumn("_m", F.monotonically_increasing_id()))
        scored = score(unlabelled_points(numbered)).withColumn("batch", F.lit(number))
        scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_metrics_stream(spark: SparkSession, path: str) -> DataFrame:
    """Per run: epochs seen, best accuracy and its epoch, from a growing CSV log."""
    rows = spark.readStream.option("header", True).schema(RUNLOG_SCHEMA + ", run string").csv(path)
    return rows.groupBy("run").agg(F.count("*").alias("epochs"), F.max("val_acc").alias("best_val_acc"), F.max_by("epoch", F.struct("val_acc", -F.col("epoch"))).alias("best_epoch"))
