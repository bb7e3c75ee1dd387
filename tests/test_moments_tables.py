"""Running moments, bucketed blocks and counted writes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import moments
from pointloom.sources import tables


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_running_moments_equal_the_loop(spark, chunk):
    rng = np.random.default_rng(4)
    rows = [(run, b, float(v), float(v * 3 + 1)) for run, n in (("a", 11), ("b", 3)) for b in range(n) for v in rng.normal(size=1 if b == 2 else 5)]
    got = moments.running_moments(moments.batch_moments(spark.createDataFrame(rows, "run string, batch long, x double, y double"), ["run", "batch"], ["x", "y"]), ["run"], "batch", 0.1, chunk).collect()
    assert len(got) == 14
    now = {"a": (np.zeros(2), np.ones(2)), "b": (np.zeros(2), np.ones(2))}
    for r in sorted(got, key=lambda r: (r.run, r.batch)):
        x = np.array([v[2:] for v in rows if v[:2] == (r.run, r.batch)])
        mean, var = now[r.run]
        now[r.run] = 0.9 * mean + 0.1 * x.mean(axis=0), (0.9 * var + 0.1 * x.var(axis=0, ddof=1)) if len(x) > 1 else var
        assert np.allclose(r.running_mean, now[r.run][0], atol=1e-12) and np.allclose(r.running_var, now[r.run][1], atol=1e-12)
    out = moments.standardise(spark.createDataFrame([(3.0, 1)], "x double, k int"), [1.0], [4.0], ["x"], 0.0).first()
    assert out.x == 1.0 and out.k == 1


def test_batches_are_fetched_without_moving_blocks(spark, tmp_path):
    blocks = spark.range(500).select(F.col("id").alias("block_id"), F.expr("array_repeat(cast(id AS double), 50)").alias("points"))
    table = tables.write_block_table(blocks, "blocks_for_batches", str(tmp_path / "b"), buckets=8)
    members = spark.range(500).select(F.col("id").alias("block_id"), F.floor(F.col("id") / 4).alias("batch_id"))
    out = tables.fetch_batches(members, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # that of the members
    assert out.where("points[0] <> block_id").count() == 0 and out.count() == 500
    some = table.where("block_id IN (3, 77)")
    assert "PushedFilters: [In(block_id, [3,77])]" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 2


def test_a_limit_fails_the_job(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).select((F.when(F.col("id") % 4 == 0, float("nan")).otherwise(F.col("id"))).alias("x"))
    counts = {"n": F.count("*"), "n_nan": F.count_if(F.isnan("x"))}
    got = tables.write_watched(df, path, counts, {"n_nan": 0.3})
    assert (got["n"], got["n_nan"]) == (100, 25) and got["seconds"] > 0 and spark.read.parquet(path).count() == 100
    with pytest.raises(ValueError, match="n_nan 0.2500"):
        tables.write_watched(df.limit(40), path, counts, {"n_nan": 0.1})
    assert os.listdir(tmp_path) == ["t"] and spark.read.parquet(path).count() == 100
    assert tables.write_watched(df.limit(40), path, counts)["n"] == 40 and spark.read.parquet(path).count() == 40
