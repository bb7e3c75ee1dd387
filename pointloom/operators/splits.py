"""Routing by area, train/validation splits, shuffled batches and batch checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.clouds import dense_index_ranged


def route(area: Column, train: list[str], test: str) -> Column:
    """'test', 'train' or null, by equality; the test area comes first."""
    return F.when(area == test, "test").when(area.isin(train), "train")


def order_key(key: Column, *seeds: int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), *[F.lit(str(s)) for s in seeds]))


def split_exact(blocks: DataFrame, key: str, share: tuple[int, int] = (1, 5), seed: int = 42) -> DataFrame:
    """Add ``part``: exactly ceil(share * n) rows are 'val', by seeded order.

    Hash prefixes are counted first; rows are ranked only within the prefix
    that holds the border, so no task sorts all rows.
    """
    num, den = share
    keyed = blocks.withColumn("_h", order_key(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, 3))
    w = Window.partitionBy(F.lit(0))  # over at most 4,096 prefixes
    sums = keyed.groupBy("_p").agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_to", F.sum("_n").over(w.orderBy("_p"))).withColumn("_want", F.ceil(F.sum("_n").over(w) * F.lit(num) / F.lit(den)))
    sums = sums.select("_p", (F.col("_want") - F.col("_to") + F.col("_n")).alias("_take"), "_n")
    out = keyed.join(sums, "_p")
    border = (F.col("_take") > 0) & (F.col("_take") < F.col("_n"))
    sure = out.where(~border).withColumn("part", F.when(F.col("_take") > 0, "val").otherwise("train"))
    ranked = out.where(border).withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)))
    ranked = ranked.withColumn("part", F.when(F.col("_k") <= F.col("_take"), "val").otherwise("train")).drop("_k")
    return sure.unionByName(ranked).drop("_h", "_p", "_take", "_n")


def split_approx(blocks: DataFrame, key: str, percent: int = 20, seed: int = 42) -> DataFrame:
    """Add ``part`` by a hash bucket alone: no shuffle, about ``percent`` % in 'val'."""
    bucket = F.conv(F.substring(order_key(F.col(key), seed), 1, 6), 16, 10).cast("long") % 100
    return blocks.withColumn("part", F.when(bucket < percent, "val").otherwise("train"))


def batches(blocks: DataFrame, key: str, size: int, epoch: int, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """Add ``batch_id`` and ``slot``: seeded order per epoch, the last batch may be short."""
    keyed = blocks.withColumn("_h", order_key(F.col(key), seed, epoch))
    out = dense_index_ranged(keyed, [], ["_h", key] if shuffle else [key], "_k")
    return out.withColumn("batch_id", F.floor(F.col("_k") / size)).withColumn("slot", (F.col("_k") % size).cast("int")).drop("_h", "_k")


def batch_validity(members: DataFrame, batch: str = "batch_id", valid: str = "valid") -> DataFrame:
    """Members, good members and whether at least max(1, members // 2) are good."""
    out = members.groupBy(batch).agg(F.count("*").alias("n"), F.count_if(F.col(valid)).alias("n_valid"))
    return out.withColumn("ok", F.col("n_valid") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))


def error_rate(rows: DataFrame, bad: Column, by: list[str], limit: float = 0.1) -> DataFrame:
    """Share of bad rows per group and whether it stays within the limit."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))
    return out.withColumn("rate", F.col("n_bad") / F.col("n")).withColumn("within", F.col("rate") <= limit)
