"""Point clouds, run logs, texts and scores derived from the given tables.

``POINTS`` and ``RUNLOG`` are texts that Spark SQL and DuckDB both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import CLASSES

POINTS = """
WITH b AS (
  SELECT o_orderkey AS pid, o_custkey,
         o_custkey % 6 + 1 AS area_no,
         CAST((o_custkey - o_custkey % 6) / 6 AS BIGINT) % 20 AS room,
         (o_orderkey * 7919 + o_custkey * 104729) % 5003 AS xi,
         (o_orderkey * 31 + o_custkey * 6151) % 5009 AS yi,
         (o_orderkey * 389 + o_custkey * 17) % 3001 AS zi
  FROM orders)
SELECT pid, CONCAT('Area_', CAST(area_no AS VARCHAR(9))) AS area, room, xi, yi, zi,
       CAST(xi AS DOUBLE) / 1000 AS x, CAST(yi AS DOUBLE) / 1000 AS y, CAST(zi AS DOUBLE) / 1000 AS z,
       CAST(pid % 256 AS INT) AS r, CAST(o_custkey % 256 AS INT) AS g, CAST((pid * 7) % 256 AS INT) AS b,
       CAST((zi * 13 - (zi * 13) % 3001) / 3001 AS INT) AS y_label,
       CAST(((zi * 13 - (zi * 13) % 3001) / 3001 + CASE WHEN pid % 5 = 0 THEN 1 ELSE 0 END) % 13 AS INT) AS pred
FROM b
"""

RUNLOG = """
WITH e AS (SELECT user_id % 8 AS run, event_id % 30 + 1 AS epoch, CAST((event_id - event_id % 30) / 30 AS BIGINT) % 5 AS part, value FROM events),
a AS (SELECT run, epoch,
  AVG(CASE WHEN part <> 0 THEN value END) / 10 AS tl, AVG(CASE WHEN part = 0 THEN value END) / 10 AS vl,
  AVG(CASE WHEN part <> 0 AND value > 20 THEN CAST(1 AS DOUBLE) WHEN part <> 0 THEN CAST(0 AS DOUBLE) END) AS ta,
  AVG(CASE WHEN part = 0 AND value > 20 THEN CAST(1 AS DOUBLE) WHEN part = 0 THEN CAST(0 AS DOUBLE) END) AS va
 FROM e GROUP BY run, epoch)
SELECT run, epoch, CASE WHEN run % 2 = 0 AND epoch BETWEEN 10 + run AND 12 + run THEN CAST(0 AS DOUBLE) ELSE ROUND(tl, 6) END AS train_loss,
  CASE WHEN run % 2 = 0 AND epoch BETWEEN 10 + run AND 12 + run THEN CAST(0 AS DOUBLE) ELSE ROUND(ta, 6) END AS train_acc,
  ROUND(vl, 6) AS val_loss, ROUND(va, 6) AS val_acc FROM a
"""

_NAMES = " ".join(f"WHEN {i} THEN '{c[0]}'" for i, c in enumerate(CLASSES))


def cloud_text_sql(fmt: str) -> str:
    """Annotation lines of the points; ``fmt`` is the engine's printf function.

    Some lines are cut to two tokens, one class of one area has an unknown name.
    """
    name = f"CASE WHEN area = 'Area_6' AND y_label = 12 THEN 'stairs' ELSE CASE y_label {_NAMES} END END"
    number = "CAST(y_label AS VARCHAR(9))"
    whole = f"{fmt}('%.3f %.3f %.3f %d %d %d', x, y, z, r, g, b)"
    return f"""SELECT CONCAT(area, '/room_', CAST(room AS VARCHAR(9)), '/Annotations/', {name}, '_', {number}, '.txt') AS file_path,
        pid AS line_no, CASE WHEN pid % 997 = 0 THEN {fmt}('%.3f %.3f', x, y) ELSE {whole} END AS value, pid FROM points"""


def _view(spark: SparkSession, sf_dir: str, table: str) -> None:
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "orders")
    return spark.sql(POINTS)


def runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "events")
    return spark.sql(RUNLOG)


def cloud_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    points(spark, sf_dir).createOrReplaceTempView("points")
    return spark.sql(cloud_text_sql("format_string"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, y, scores array<double>)``: all components of each vector as class scores."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("scores"))


def gate(df: DataFrame) -> DataFrame:
    """Points with some coordinates made not-a-number or infinite."""
    x = F.when(F.col("pid") % 101 == 0, F.lit(float("nan"))).when(F.col("pid") % 103 == 0, F.lit(float("inf"))).otherwise(F.col("x"))
    return df.withColumn("x", x)
