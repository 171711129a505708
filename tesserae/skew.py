"""Hot keys: finding them, and joining on them without one overloaded task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import Scratch

#: Rows of one key from which it is split.
HOT_ROWS = 100_000
#: Most keys that are split, hence most rows that are broadcast to split them. With more
#: hot keys than that none holds a notable share, and only the hottest are split.
MAX_HOT_KEYS = 50_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys held by more than ``hot_rows`` rows, with ``_salts``, the parts to split them into.

    Counted with map-side pre-aggregation and written to scratch; None if there are none.
    At most MAX_HOT_KEYS rows: the threshold is raised tenfold until that holds.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    found, _ = Scratch(df.sparkSession, "hot-keys").save(counts)
    limit, n = hot_rows, found.count()
    while n > MAX_HOT_KEYS:
        limit *= 10
        n = found.where(F.col("_n") > limit).count()
    if not n:
        return None
    return found.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts"))


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Columns equal pair by pair, null to null."""
    match = F.lit(True)
    for a, b in zip(left, right):
        match &= F.col(a).eqNullSafe(F.col(b))
    return match


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str,
    spread: Column,
    hot_rows: int = HOT_ROWS,
    rows: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """``big`` joined to ``small`` (unique on ``keys``) with hot keys of ``big`` split.

    Rows of ``big`` whose key is hot get a salt from ``spread`` (a column that differs
    within the key), and the one row of ``small`` for that key is repeated per salt.
    Null keys match null keys. ``how`` is inner, left, left_semi or left_anti. ``rows`` is the number of rows of
    ``big`` at most, where it is known: no key of fewer than ``hot_rows`` rows can be hot, and nothing is counted. ``hot`` is what ``hot_keys``
    gave for a side that is joined again and again.
    """
    keys = list(keys)
    theirs = [f"_key{i}" for i in range(len(keys))]
    rest = [c for c in small.columns if c not in keys]
    other = small.select(*[F.col(k).alias(t) for k, t in zip(keys, theirs)], *rest)
    kept = big.columns if how in ("left_semi", "left_anti") else [*big.columns, *rest]
    if hot is None and (rows is None or rows > hot_rows):
        hot = hot_keys(big.select(*keys), keys, hot_rows)
    if hot is None:
        return big.join(other, same(keys, theirs), how).select(*kept)
    hot = F.broadcast(hot.select(*[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)], "_salts"))
    hots = [f"_hot{i}" for i in range(len(keys))]
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = big.join(hot, same(keys, hots), "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts.cast("long")).cast("int")).select(*big.columns, "_salt")
    right = other.join(hot, same(theirs, hots), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), salts - 1))).select(*other.columns, "_part")
    return left.join(right, same([*keys, "_salt"], [*theirs, "_part"]), how).select(*kept)
