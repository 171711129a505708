"""Content hashes, and which sources changed since they were last seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(payload: Column) -> Column:
    """SHA-256 of the canonical JSON: independent of key order and layout; null if it is no JSON."""
    return F.sha2(F.to_json(F.try_parse_json(payload)), 256)


def has_changed(sources: DataFrame, cache: DataFrame, key: str = "source_key", digest: str = "source_hash") -> DataFrame:
    """(key, has_changed): a source that was never cached counts as changed."""
    known = cache.select(key, F.col(digest).alias("_cached"))
    return sources.select(key, digest).join(known, key, "left").select(key, (F.col("_cached").isNull() | ~F.col("_cached").eqNullSafe(F.col(digest))).alias("has_changed"))


def upserted(cache: DataFrame, entries: DataFrame, key: str = "source_key") -> DataFrame:
    """The cache table with ``entries`` put in or replaced."""
    return cache.join(entries.select(key), key, "left_anti").unionByName(entries)
