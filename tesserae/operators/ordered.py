"""Neighbours in ordered groups, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], carry: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """``df`` with the ``carry`` columns of the preceding row of its group as ``prev_...``.

    ``block`` is a coarse form of the order (a day, say), non-decreasing along it. Windows run
    within (group, block); over the blocks of a group only their last rows are looked
    at, so a group that holds a third of all rows is still spread over many tasks.
    The first row of a group gets nulls, and a struct ``_at`` of the order is added.
    Null order values come first. Null keys form a group.
    """
    df = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    rows = df.withColumn("_here", F.struct(*carry)).withColumn("_prev", F.lag("_here").over(inner))
    last = df.groupBy(*keys, "_block").agg(F.max_by(F.struct(*carry), F.struct(*order)).alias("_last"))
    outer = Window.partitionBy(*keys).orderBy("_block")
    before = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), F.lag("_last").over(outer).alias("_carried"))
    match = F.col("_block").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(before, match, "left")
    prev = F.coalesce("_prev", "_carried")
    return joined.select(*[c for c in df.columns if c != "_block"], *[prev[c].alias(f"{prefix}{c}") for c in carry])
