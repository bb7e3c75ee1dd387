"""Comparing all members of groups in bounded blocks.

The members of a group are dealt to blocks by a hash; every pair of blocks is
one unit of work, so a large group becomes many equal units and no task holds
more than two blocks of it.  Small groups are packed together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_of(member: str, blocks: str) -> Column:
    """The block a member of a group is dealt to."""
    return F.pmod(F.xxhash64(F.col(member), F.lit(17)), F.col(blocks)).cast("int")


def block_pairs(rows: DataFrame, group: list[str], member: str, blocks: str, bins: int) -> DataFrame:
    """Add ``unit long``, ``_i``, ``_j`` (the pair of blocks) and ``_b`` (the row's block).

    Column ``blocks`` of ``rows`` is the number of blocks of the row's group; it
    is dropped.  A row comes once per block pair it belongs to.  Groups of one
    block are dealt to ``bins`` units.
    """
    rows = rows.withColumn("_b", block_of(member, blocks))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    rows = rows.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))
    unit = F.when(F.col(blocks) == 1, F.pmod(F.xxhash64(*group), F.lit(bins))).otherwise(F.xxhash64(*group, "_i", "_j"))
    return rows.withColumn("unit", unit).drop("_o", blocks)


def forest_edges(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (left[k], right[k]) between n members.

    Labels settle by repeated minima over links and pointer jumping; at most
    n - 1 edges (member, smallest member of its part) come out.
    """
    label = np.arange(n)
    if not len(left):
        return []
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = np.flatnonzero(label != np.arange(n))
    return [(int(i), int(label[i])) for i in moved]
