"""Losses, accuracies and confusion over scored points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import IGNORE
from ..functions.vectors import argmax, finite, log_softmax


def with_scores(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Add ``logp`` (log softmax) and ``pred`` (first largest class)."""
    return df.withColumn("logp", log_softmax(F.col(scores))).withColumn("pred", argmax(F.col(scores)))


def nll(df: DataFrame, by: list[str], label: str = "y") -> DataFrame:
    """Mean negative log likelihood of labelled rows; ignored labels are left out."""
    p = -F.element_at("logp", F.col(label) + 1)
    return df.where(F.col(label) != IGNORE).groupBy(*by).agg(F.avg(p).alias("loss"), F.count("*").alias("n"))


def accuracy(df: DataFrame, by: list[str], label: str = "y", pred: str = "pred") -> DataFrame:
    """Correct and total rows and their ratio, null for no rows."""
    out = df.where(F.col(label) != IGNORE).groupBy(*by).agg(F.count_if(F.col(pred) == F.col(label)).alias("correct"), F.count("*").alias("total"))
    return out.withColumn("accuracy", F.col("correct") / F.nullif("total", F.lit(0)))


def confusion(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    return df.where(F.col(label) != IGNORE).groupBy(label, pred).agg(F.count("*").alias("n"))


def class_iou(counts: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """Intersection over union per class from a confusion table."""
    rows = counts.select(F.explode(F.array(F.struct(F.col(label).alias("class_id"), F.col("n"), F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("hit"), F.lit(0).cast("long").alias("twice")), F.struct(F.col(pred).alias("class_id"), F.col("n"), F.lit(0).cast("long").alias("hit"), F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("twice")))).alias("r"))
    out = rows.groupBy("r.class_id").agg(F.sum("r.hit").alias("hit"), (F.sum("r.n") - F.sum("r.twice")).alias("joined"))
    return out.withColumn("iou", F.col("hit") / F.nullif("joined", F.lit(0)))


def batch_mean_loss(batches: DataFrame, by: list[str], skipped: Column, mode: str = "clean", loss: str = "loss") -> DataFrame:
    """Mean of batch losses.

    'clean' divides by the batches that count; 'reference' also counts skipped
    batches in the denominator, which pulls the mean down.
    """
    if mode not in ("clean", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    kept = F.sum(F.when(skipped, None).otherwise(F.col(loss)))
    n = F.count("*") if mode == "reference" else F.count_if(~skipped)
    return batches.groupBy(*by).agg((F.coalesce(kept, F.lit(0.0)) / F.nullif(n, F.lit(0))).alias("loss"), n.alias("n_batches"))


def stability(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Rows with a not-a-number or infinite value per group, and whether all are finite."""
    nan = [F.coalesce(F.isnan(c), F.lit(False)) for c in columns]
    good = [finite(F.col(c)) for c in columns]
    any_nan = nan[0]
    bad = ~good[0]
    for a, b in zip(nan[1:], good[1:], strict=True):
        any_nan, bad = any_nan | a, bad | ~b
    out = df.groupBy(*by).agg(F.count_if(any_nan).alias("n_nan"), F.count_if(bad & ~any_nan).alias("n_inf"), F.count("*").alias("n"))
    return out.withColumn("stable", (F.col("n_nan") == 0) & (F.col("n_inf") == 0))
