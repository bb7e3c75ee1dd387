"""Sinks and sources of rooms, blocks, models, segmented text and run logs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import RUNLOG_SCHEMA
from .files import write_named


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def write_rooms(points: DataFrame, path: str) -> None:
    """Room tables by area and room; only the partitions written are replaced."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("area", "room").parquet(path)


def read_rooms(spark: SparkSession, path: str, areas: list[str] | None = None) -> DataFrame:
    """Room tables; the area list prunes partitions."""
    out = spark.read.parquet(path)
    return out if areas is None else out.where(F.col("area").isin(areas))


def write_blocks(blocks: DataFrame, path: str, by: str = "area") -> None:
    """Nested blocks; partitions that are written replace earlier ones."""
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_block_table(blocks: DataFrame, name: str, path: str, key: str = "block_id", buckets: int = 64) -> DataFrame:
    """Blocks as a table bucketed and sorted by their key, for random access.

    Joins on the key read the buckets where they are, without an exchange of
    the blocks; a filter on keys is pushed to the sorted files.
    """
    blocks.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return blocks.sparkSession.table(name)


def fetch_batches(members: DataFrame, table: DataFrame, key: str = "block_id") -> DataFrame:
    """Batch members with their blocks; members travel to the buckets of the blocks."""
    return members.hint("shuffle_merge").join(table.hint("shuffle_merge"), key)


def write_watched(df: DataFrame, path: str, counts: dict[str, Column], limits: dict[str, float] | None = None, by: str = "n") -> dict[str, float]:
    """Write a Parquet table and return what was counted on the way, with ``seconds``.

    ``counts`` are aggregates that the writing pass observes, so the table is
    scanned once.  ``limits`` bound a count as a share of count ``by``: beyond
    one the job fails and the path stays as it was.
    """
    spark = df.sparkSession
    seen, pending, began = Observation(), f"{path}-pending-{uuid.uuid4().hex}", time.time()
    df.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.parquet(pending)
    got = dict(seen.get) | {"seconds": time.time() - began}
    beyond = {n: got[n] / got[by] for n, most in (limits or {}).items() if got[by] and got[n] / got[by] > most}
    jvm = spark._jvm.org.apache.hadoop.fs
    here, there = jvm.Path(pending), jvm.Path(path)
    fs = here.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if beyond:
        fs.delete(here, True)
        raise ValueError(f"over the limit: {', '.join(f'{n} {share:.4f}' for n, share in beyond.items())}")
    fs.delete(there, True)
    fs.mkdirs(there.getParent())
    if not fs.rename(here, there):
        raise OSError(f"cannot rename {pending}")
    return got


def build_if_missing(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a Parquet table, building it first when its path does not exist."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Save a fitted pipeline, replacing an earlier one."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A fitted pipeline saved by :func:`save_model`."""
    return PipelineModel.load(path)


def segmented_line(x: Column, y: Column, z: Column, r: Column, g: Column, b: Column, pred: Column) -> Column:
    """One line of a segmented cloud; colours lose their fractions."""
    return F.format_string("%.6f %.6f %.6f %d %d %d %d", x, y, z, r.cast("long"), g.cast("long"), b.cast("long"), pred.cast("long"))


def write_segmented(points: DataFrame, path: str) -> None:
    """Text files per cloud in point order, one sorted range of points per file."""
    line = segmented_line(*[F.col(c) for c in ("x", "y", "z", "r", "g", "b", "pred")])
    ordered = points.repartitionByRange("cloud_id", "point_idx").sortWithinPartitions("cloud_id", "point_idx")
    ordered.select(F.concat("cloud_id", F.lit("_segmented")).alias("cloud"), line.alias("value")).write.mode("overwrite").partitionBy("cloud").text(path)


def write_segmented_files(points: DataFrame, path: str) -> None:
    """One text file ``<cloud>_segmented.txt`` per cloud, in point order."""
    line = segmented_line(*[F.col(c) for c in ("x", "y", "z", "r", "g", "b", "pred")])
    lines = points.select(F.concat("cloud_id", F.lit("_segmented.txt")).alias("file"), "point_idx", line.alias("value"))
    write_named(lines, path, "file", ["point_idx"])


def epoch_lines(log: DataFrame) -> DataFrame:
    """Epoch metrics as formatted strings, with both differences."""
    f = lambda c, n: F.format_string(f"%.{n}f", c)
    return log.select(
        "run", "epoch",
        *[f(F.col(c), 6).alias(c) for c in ("train_loss", "train_acc", "val_loss", "val_acc")],
        f(F.col("val_loss") - F.col("train_loss"), 6).alias("loss_diff"),
        f(F.col("train_acc") - F.col("val_acc"), 6).alias("acc_diff"),
        f(F.col("learning_rate"), 8).alias("learning_rate"),
    )


def append_epochs(log: DataFrame, path: str) -> None:
    """Append epoch rows to a CSV log partitioned by run."""
    epoch_lines(log).write.mode("append").option("header", True).partitionBy("run").csv(path)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """The CSV log with typed columns; ``run`` comes from the path."""
    return spark.read.option("header", True).schema(RUNLOG_SCHEMA + ", run string").csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Run summaries as JSON, one row per run."""
    summary.write.mode("overwrite").json(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summaries, one row per run."""
    return spark.read.json(path)
