"""Materialised intermediate tables that survive lost executors.

Lineage is cut by writing Parquet below the folder the cluster names in
``spark.checkpoint.dir`` (shared by the driver and all executors).  Only in
local mode, as in unit tests, a private folder stands in when it is unset.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
#: Column of row ids; no table of ours names a column like this.
ROW = "__row"


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; an own one in local mode where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="pointloom-"))
    return f"file://{_OWN[0]}"


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` below the shared folder and return the written table.

    The plan that follows starts from files every executor can read, so a lost
    executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def numbered(rows: DataFrame, name: str = "rows") -> DataFrame:
    """``rows`` written with an id of their own in column ``ROW``, which every later plan sees alike."""
    return materialise(rows.withColumn(ROW, F.monotonically_increasing_id()), name)


def release(df: DataFrame | None) -> None:
    """Delete a table written by :func:`materialise` that no plan reads any more."""
    path = getattr(df, "_written_at", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def evenly(df: DataFrame) -> DataFrame:
    """Put a plain exchange between an aggregate and the join that follows.

    Adaptive execution can split a hot key of a join only when both inputs come
    straight from exchanges; an aggregate on the same key would forbid it.
    """
    return df.hint("rebalance")


def small(df: DataFrame, name: str, max_rows: int = 100_000) -> DataFrame:
    """Materialise a table expected to be small; broadcast it only if it is.

    The rows are counted after writing.  Beyond ``max_rows`` the joins that
    follow are ordinary ones, with a plain exchange that can be split.
    """
    table = materialise(df, name)
    out = F.broadcast(table) if table.count() <= max_rows else evenly(table)
    out._written_at = table._written_at
    return out
