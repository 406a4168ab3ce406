"""Pairs inside groups of any size, in blocks of bounded size.

A group's members are dealt over ``n_blocks`` blocks by a hash; one task row
group holds two blocks (or one with itself).  A task returns per member its
number of links and the root of its local component, so links are counted
without a row per link.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, group: str, member: str, n_blocks: str | Column, own: str | None = None) -> DataFrame:
    """``rows`` with ``pair`` (a key of the group and two blocks) and ``side``
    (0/1: in the pair's first or second block; 2 if the pair is a block with
    itself), repeated for every pair that the row's block takes part in.  ``n_blocks`` is
    constant in a group.  ``own``: the row's block, if it is known."""
    n = F.col(n_blocks) if isinstance(n_blocks, str) else n_blocks
    return (rows.withColumn("__n", n.cast("int"))
            .withColumn("__own", (F.pmod(F.xxhash64(F.lit(17), F.col(member)), F.col("__n")) if own is None
                                  else F.col(own)).cast("int"))
            .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
            .withColumn("side", F.when(F.col("__own") == F.col("__other"), 2)
                        .otherwise((F.col("__own") > F.col("__other")).cast("int")))
            .withColumn("pair", F.xxhash64(F.lit(29), F.col(group), F.least("__own", "__other"),
                                           F.greatest("__own", "__other")))
            .drop("__n", "__own", "__other"))


def local_roots(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each node's component under a symmetric link matrix."""
    root = ids.copy()
    seen = np.zeros(len(ids), bool)
    for start in range(len(ids)):
        if seen[start]:
            continue
        members = np.zeros(len(ids), bool)
        members[start] = True
        front = np.array([start])
        while len(front):
            reach = links[front].any(axis=0) & ~members
            members |= reach
            front = np.flatnonzero(reach)
        seen |= members
        root[members] = ids[members].min()
    return root


def sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows and columns to compare of a pair's ``side``, and whether they are
    the same block (a pair of which one block is empty has no columns)."""
    if len(side) and side[0] == 2:
        return np.arange(len(side)), np.arange(len(side)), True
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False
