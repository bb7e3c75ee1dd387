"""Analysis of training-run logs: gaps, best epochs, learning rates, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_name(at: Column) -> Column:
    """Name of a run that starts at a time, to the second."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def run_time(name: Column) -> Column:
    """Start of a run from its name; null for other names."""
    return F.try_to_timestamp(name, F.lit("yyyyMMdd_HHmmss"))


def gaps(log: DataFrame) -> DataFrame:
    """Add ``loss_diff`` and ``acc_diff``."""
    return log.withColumn("loss_diff", F.col("val_loss") - F.col("train_loss")).withColumn("acc_diff", F.col("train_acc") - F.col("val_acc"))


def best(log: DataFrame) -> DataFrame:
    """Best epoch per run: the largest validation accuracy, the first of equals."""
    return log.groupBy("run").agg(F.max_by("epoch", F.struct("val_acc", -F.col("epoch"))).alias("best_epoch"), F.max("val_acc").alias("best_val_acc"))


def running_best(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    out = log.withColumn("best_so_far", F.max("val_acc").over(w))
    return out.withColumn("is_new_best", F.col("val_acc") > F.coalesce(F.max("val_acc").over(prior), F.lit(float("-inf"))))


def replay_rates(log: DataFrame, start: float = 1e-3, factor: float = 0.5, patience: int = 4, least: float = 1e-6, relative: float = 1e-4) -> DataFrame:
    """``(run, epoch, learning_rate)``: the rate after each epoch of a plateau schedule.

    An ordered fold per run (runs are short): an epoch is better when its loss
    is below best * (1 - relative); after more than ``patience`` others the
    rate is multiplied by ``factor``, down to ``least``.
    """
    state = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(start).alias("lr"), F.array().cast("array<double>").alias("out"))

    def step(s, e):
        better = e["val_loss"] < s["best"] * (1 - relative)
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        drop = bad > patience
        lr = F.when(drop, F.greatest(s["lr"] * factor, F.lit(least))).otherwise(s["lr"])
        return F.struct(F.when(better, e["val_loss"]).otherwise(s["best"]).alias("best"), F.when(drop, 0).otherwise(bad).alias("bad"), lr.alias("lr"), F.concat(s["out"], F.array(lr)).alias("out"))

    runs = log.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "val_loss"))).alias("_e"))
    runs = runs.withColumn("_r", F.aggregate("_e", state, step)["out"])
    return runs.select("run", F.explode(F.arrays_zip(F.col("_e.epoch").alias("epoch"), F.col("_r").alias("rate"))).alias("_z")).select("run", F.col("_z.epoch").alias("epoch"), F.col("_z.rate").alias("learning_rate"))


def rate_changes(log: DataFrame, column: str = "learning_rate") -> DataFrame:
    """Epochs whose rate differs from the one before, with both values."""
    w = Window.partitionBy("run").orderBy("epoch")
    out = log.withColumn("before", F.lag(column).over(w)).where(F.col("before") != F.col(column))
    return out.select("run", "epoch", "before", F.col(column).alias("after"))


def failure_runs(log: DataFrame, limit: int = 3) -> DataFrame:
    """Islands of consecutive failed epochs and the stop epoch.

    Failed is what column ``outcome`` says, or both training metrics zero in a log without it.

    ``stop_epoch`` is where the run would end: the epoch that completes the
    first island of at least ``limit``.
    """
    failed = log.where(F.col("outcome") == "failed" if "outcome" in log.columns else (F.col("train_loss") == 0) & (F.col("train_acc") == 0))
    island = F.col("epoch") - F.row_number().over(Window.partitionBy("run").orderBy("epoch"))
    out = failed.withColumn("_i", island).groupBy("run", "_i").agg(F.min("epoch").alias("first_epoch"), F.count("*").alias("length")).drop("_i")
    stop = F.when(F.col("length") >= limit, F.col("first_epoch") + limit - 1)
    return out.withColumn("stop_epoch", F.min(stop).over(Window.partitionBy("run")))


def summary(log: DataFrame, config: dict[str, float]) -> DataFrame:
    """One nested row per run: ``training_config``, ``best_performance``, ``training_history``."""
    series = ["train_loss", "train_acc", "val_loss", "val_acc"]
    runs = log.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", *series))).alias("_e"), F.max_by("epoch", F.struct("val_acc", -F.col("epoch"))).alias("_b"), F.max("val_acc").alias("_a"))
    return runs.select(
        "run",
        F.struct(*[F.lit(v).alias(k) for k, v in config.items()]).alias("training_config"),
        F.struct(F.col("_b").alias("best_epoch"), F.col("_a").alias("best_val_accuracy"), F.element_at("_e.train_loss", -1).alias("final_train_loss"), F.element_at("_e.val_loss", -1).alias("final_val_loss")).alias("best_performance"),
        F.struct(*[F.col(f"_e.{s}").alias(s) for s in series]).alias("training_history"),
    )
