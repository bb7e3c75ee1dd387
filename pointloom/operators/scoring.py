"""Scoring of clouds by a model saved before, the same for tables and streams.

A cloud goes from points to nine features, to padded blocks, through the saved
model block by block, and back to its points in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import FEATURES
from ..functions.shared import written
from ..sources.tables import load_model
from . import blocks, geometry, learn


@dataclass(frozen=True)
class CloudScorer:
    """How clouds are scored: a saved pipeline, and how its features and blocks were made."""

    model_path: str
    k: int = 20
    radius: float = 0.6
    block_size: int = 8192

    def load(self) -> Callable[[DataFrame], DataFrame]:
        """Read the model once; the function scores any number of tables or batches with it."""
        scores = learn.block_scorer(load_model(self.model_path))
        return lambda points: self.score(points, scores)

    def score(self, points: DataFrame, scores: Callable) -> DataFrame:
        """``points`` (cloud_id, point_idx, x, y, z, r, g, b) with ``pred``.

        Points with a coordinate that is null or not finite have no features
        and get class 0, as does every point that no block returns.
        """
        cloud = written(points.withColumn("pid", F.monotonically_increasing_id()), "cloud")
        ready = nine(geometry.geometric_features(cloud, ["cloud_id"], self.k, self.radius))
        ready = blocks.assign(ready, ["cloud_id"], self.block_size)
        nested = blocks.nest(ready, ["cloud_id", "block_no"], self.block_size, FEATURES, ["x", "y", "z"], None)
        # offsets are places among the points that have features; the block keeps their numbers
        numbers = ready.groupBy("cloud_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("offset", "point_idx"))).alias("_n"))
        found = learn.score_blocks(nested, scores, ["cloud_id", "block_no"])
        found = found.join(numbers.select("cloud_id", "block_no", F.posexplode("_n.point_idx").alias("offset", "point_idx")), ["cloud_id", "block_no", "offset"])
        return learn.merge_predictions(cloud.drop("pid"), found, ["cloud_id", "point_idx"])


def nine(points: DataFrame) -> DataFrame:
    """The nine features as columns: colours as shares of 255; single points, which have no curvature, count as flat."""
    return points.withColumns({n: F.col(c) / 255.0 for n, c in zip(FEATURES[6:], "rgb", strict=True)} | {"curvature": F.coalesce("curvature", F.lit(0.0))})
