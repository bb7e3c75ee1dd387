"""Blocks of consecutive points: numbering, padding, masks, nesting and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import IGNORE


def assign(points: DataFrame, scope: list[str], size: int) -> DataFrame:
    """Add ``block_no``, ``offset``, ``start_idx`` and ``end_idx`` from the dense point index."""
    counts = points.groupBy(*scope).agg(F.count("*").alias("_n"))
    out = points.join(counts, scope)
    start = F.col("block_no") * size
    out = out.withColumn("block_no", F.floor(F.col("point_idx") / size)).withColumn("offset", (F.col("point_idx") % size).cast("int"))
    return out.withColumn("start_idx", start).withColumn("end_idx", F.least(start + size, F.col("_n"))).drop("_n")


def room_blocks(points: DataFrame, scope: list[str], size: int) -> DataFrame:
    """Points and blocks per room, and the number of blocks in the rooms before it.

    The prefix sum runs over rooms, not points.
    """
    rooms = points.groupBy(*scope).agg(F.count("*").alias("n_points")).withColumn("n_blocks", F.ceil(F.col("n_points") / F.lit(size)))
    before = Window.partitionBy(F.lit(0)).orderBy(*scope).rowsBetween(Window.unboundedPreceding, -1)
    return rooms.withColumn("first_block", F.coalesce(F.sum("n_blocks").over(before), F.lit(0)))


def block_name(block_id: Column, area: Column) -> Column:
    return F.format_string("block_%06d_%s", block_id, area)


def range_name(start: Column, end: Column) -> Column:
    return F.format_string("block_%06d_%06d", start, end)


def pad_long(blocks: DataFrame, keys: list[str], size: int, zeros: list[str], repeats: list[str], label: str | None = "label") -> DataFrame:
    """Fill every block to ``size`` rows; ``valid`` tells real rows.

    Padding rows hold zeros in ``zeros``, the values of the last real row in
    ``repeats`` and the ignored label.
    """
    cols = [*keys, "offset", *zeros, *repeats, *([label] if label else [])]
    real = blocks.select(*cols, F.lit(True).alias("valid"))
    last = blocks.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.max_by(c, "offset").alias(c) for c in repeats]).where(F.col("_n") < size)
    pads = last.withColumn("offset", F.explode(F.sequence(F.col("_n").cast("int"), F.lit(size - 1))))
    kinds = dict(blocks.dtypes)
    pads = pads.withColumns({c: F.lit(0).cast(kinds[c]) for c in zeros} | ({label: F.lit(IGNORE).cast(kinds[label])} if label else {}))
    return real.unionByName(pads.select(*cols, F.lit(False).alias("valid")))


def nest(blocks: DataFrame, keys: list[str], size: int, features: list[str], position: list[str], label: str | None = "label", pad: bool = True) -> DataFrame:
    """One row per block: ``num_valid`` and ``points array<struct<x, pos[, y]>>`` of fixed length."""
    item = [F.array(*[F.col(c).cast("float") for c in features]).alias("x"), F.array(*[F.col(c).cast("float") for c in position]).alias("pos")]
    if label:
        item.append(F.col(label).cast("int").alias("y"))
    got = blocks.groupBy(*keys).agg(F.count("*").cast("int").alias("num_valid"), F.array_sort(F.collect_list(F.struct("offset", F.struct(*item).alias("p")))).alias("_s"))
    got = got.withColumn("points", F.transform("_s", lambda s: s["p"])).drop("_s")
    if not pad:
        return got
    last = F.element_at("points", -1)
    filler = [F.array_repeat(F.lit(0.0).cast("float"), len(features)).alias("x"), last["pos"].alias("pos")]
    if label:
        filler.append(F.lit(IGNORE).alias("y"))
    return got.withColumn("points", F.concat("points", F.array_repeat(F.struct(*filler), F.lit(size) - F.col("num_valid"))))


def unnest(nested: DataFrame) -> DataFrame:
    """Valid rows of nested blocks with their offsets."""
    keys = [c for c in nested.columns if c != "points"]
    return nested.select(*keys, F.posexplode(F.slice("points", F.lit(1), F.col("num_valid"))).alias("offset", "point"))


def mask(num_valid: Column, size: int) -> Column:
    """Array of ``size`` booleans, true for real rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < num_valid)


def check_blocks(nested: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Valid blocks and the quarantine: null columns or a wrong array length."""
    good = F.col("points").isNotNull() & F.col("num_valid").isNotNull() & (F.size("points") == size) & F.col("num_valid").between(1, size)
    flagged = nested.withColumn("_ok", F.coalesce(good, F.lit(False)))
    return flagged.where("_ok").drop("_ok"), flagged.where(~F.col("_ok")).drop("_ok")


def time_per_block(jobs: DataFrame, seconds: str = "seconds", n_blocks: str = "n_blocks") -> DataFrame:
    """Add ``per_block``, seconds per block; null for a job without blocks."""
    return jobs.withColumn("per_block", F.col(seconds).cast("double") / F.nullif(F.col(n_blocks), F.lit(0)))
