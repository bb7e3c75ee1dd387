"""Moments of batches and their running values, as batch standardisation keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batch_moments(rows: DataFrame, batch: list[str], columns: list[str]) -> DataFrame:
    """``(batch, n, mean array, var array)``: means and sample variances of every batch, null values left out.

    One aggregation with partial sums that merge; the variance of a single
    value is null.
    """
    means, variances = [F.avg(c) for c in columns], [F.var_samp(c) for c in columns]
    return rows.groupBy(*batch).agg(F.count("*").alias("n"), F.array(*means).alias("mean"), F.array(*variances).alias("var"))


def running_moments(moments: DataFrame, run: list[str], order: str, momentum: float = 0.1, chunk: int = 1000) -> DataFrame:
    """Add ``running_mean`` and ``running_var`` after each batch, in order of ``order`` (0, 1, 2, ... in a run).

    new = (1 - momentum) * old + momentum * batch, from mean 0 and variance 1;
    a null moment leaves its running value as it is.  The fold is an affine
    map, and maps compose: every chunk of consecutive batches is folded by
    itself, the chunks' maps are folded in order, and each batch gets the value
    its chunk started from.  So a run of any length is worked on in parallel,
    with ``chunk`` batches, or one row per chunk, in a task at a time.
    """
    kept = 1.0 - momentum
    width = F.size("mean")
    both = F.concat("mean", "var")  # folded together: means, then variances
    rows = moments.withColumn("_c", F.floor(F.col(order) / chunk)).withColumn("_v", both)
    item = F.struct(F.col(order).alias("o"), F.col("_v").alias("v"))
    chunks = rows.groupBy(*run, "_c").agg(F.array_sort(F.collect_list(item)).alias("_e"))
    # of a chunk, after each batch: by how much the start counts, and what is added to it
    first = F.struct(F.transform(F.col("_e")[0]["v"], lambda _: F.lit(1.0)).alias("a"), F.transform(F.col("_e")[0]["v"], lambda _: F.lit(0.0)).alias("b"))
    a = lambda s, e: F.zip_with(s["a"], e["v"], lambda x, v: F.when(v.isNull(), x).otherwise(x * kept))
    b = lambda s, e: F.zip_with(s["b"], e["v"], lambda x, v: F.when(v.isNull(), x).otherwise(x * kept + v * momentum))
    start = F.struct(first.alias("now"), F.array().cast("array<struct<a:array<double>,b:array<double>>>").alias("all"))

    def step(s, e):
        now = F.struct(a(s["now"], e).alias("a"), b(s["now"], e).alias("b"))
        return F.struct(now.alias("now"), F.concat(s["all"], F.array(now)).alias("all"))

    chunks = chunks.withColumn("_m", F.aggregate("_e", start, step)["all"])
    # the chunks of a run in order: a row each
    ends = chunks.select(*run, "_c", F.element_at("_m", -1).alias("_end"))
    seen = Window.partitionBy(*(run or [F.lit(0)])).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.collect_list("_end").over(seen))
    origin = F.transform(F.col("_end.a"), lambda _, i: F.when(i * 2 < F.size("_end.a"), 0.0).otherwise(1.0))
    carry = F.aggregate("_before", origin, lambda s, m: F.zip_with(F.zip_with(m["a"], s, lambda x, y: x * y), m["b"], lambda x, y: x + y))
    ends = ends.select(*run, "_c", carry.alias("_carry"))
    each = chunks.join(ends, [*run, "_c"]).select(*run, F.explode(F.arrays_zip(F.col("_e.o").alias("o"), F.col("_m").alias("m"))).alias("_z"), "_carry")
    value = F.zip_with(F.zip_with(F.col("_z.m.a"), F.col("_carry"), lambda x, y: x * y), F.col("_z.m.b"), lambda x, y: x + y)
    each = each.select(*run, F.col("_z.o").alias(order), value.alias("_r"))
    return moments.join(each, [*run, order]).withColumn("running_mean", F.slice("_r", F.lit(1), width)).withColumn("running_var", F.slice("_r", width + 1, width)).drop("_r")


def standardise(rows: DataFrame, mean: list[float], var: list[float], columns: list[str], eps: float = 1e-5) -> DataFrame:
    """The columns less their mean over the root of their variance plus ``eps``."""
    return rows.withColumns({c: (F.col(c) - m) / (v + eps) ** 0.5 for c, m, v in zip(columns, mean, var, strict=True)})
