"""References to records that do not exist, at the time they are made.

A Bloom filter of all parent keys proves most orphans at once: what it does not contain was
never registered. Only references it lets through are joined exactly. The filter takes up to 64 MiB, at which 45 million keys
have their 12 bits each; more keys share them, and beyond 180 million it would let more than a quarter through and
is left out (as it is in a remote session, which has no such filter): then all references are joined, with the same result.

A record holds a reference made at the time it begins, but not one made at the time it ends.

Defined results: null and empty references are no references. A reference with a null
scope matches no record and is missing. Without a time it is not held by any record: late,
or missing if there is no record. A record without a first time never begins.
Repeated rows count each. Columns of any name are kept, but for ``reason``, which is
replaced. An empty registry makes every reference missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.bloom import available, bloom_of, might_contain
from tesserae.session import Scratch
from tesserae.skew import HOT_ROWS, salted_join

FAR = "9999-12-31 00:00:00"


def orphans(
    refs: DataFrame,
    registry: DataFrame,
    scope: str = "scene_id",
    ref: str = "ref",
    at: str = "at",
    key: str = "id",
    begins: str = "first_seen_at",
    ends: str = "removed_at",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows of ``refs`` that nothing held, with ``reason``: missing, deleted or late.

    ``registry`` has one row per life span of a record. A reference holds if a span began at or
    before its time and ended, if ever, after it. Reason ``deleted``: some span had begun by then.
    """
    spark = refs.sparkSession
    kept = [c for c in refs.columns if c.lower() != "reason"]
    # The rows travel as one struct, so that their columns cannot clash with those made here.
    made = refs.where(F.col(ref).isNotNull() & (F.col(ref) != "")).select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(scope).alias("scope"), F.col(ref).alias("ref"), F.col(at).alias("at")
    )
    spans = registry.where(F.col(scope).isNotNull() & F.col(key).isNotNull()).select(
        F.col(scope).alias("_scope"), F.col(key).alias("_key"), F.col(begins).alias("_b"), F.coalesce(F.col(ends), F.lit(FAR).cast(registry.schema[ends].dataType)).alias("_e")
    )
    hashed = F.xxhash64("scope", "ref")
    passed, refused = made, None
    blooms = bloom_of(spans, F.xxhash64("_scope", "_key"), spans.count()) if available(spark) else None
    if blooms:
        # Written once, as both sides are read again.
        sifted, _ = Scratch(spark, "references").save(made.withColumn("_maybe", might_contain(blooms, hashed)))
        passed, refused = sifted.where("_maybe").drop("_maybe"), sifted.where("not _maybe").drop("_maybe").withColumn("reason", F.lit("missing"))
    # One row per record, pre-aggregated: enough for every record with a single life span.
    records = spans.groupBy("_scope", "_key").agg(
        F.min("_b").alias("_first"), F.max(F.when(F.col("_b").isNotNull(), F.col("_e"))).alias("_last"), F.count_distinct("_b", "_e").alias("_spans")
    )
    records = records.withColumnsRenamed({"_scope": "scope", "_key": "ref"})
    own = ["_row", "scope", "ref", "at"]
    judged = salted_join(passed, records, ["scope", "ref"], "left", F.col("_row"), hot_rows)
    known, begun = F.col("_spans").isNotNull(), F.col("_first") <= F.col("at")
    simple = (
        F.when(~known, "missing")
        .when(~F.coalesce(begun, F.lit(False)), "late")
        .when(F.col("_last") <= F.col("at"), "deleted")
        .when(F.col("_spans") <= 1, "")
    )
    judged, _ = Scratch(spark, "references").save(judged.select(*own, simple.alias("reason")))
    settled = judged.where(F.col("reason").isNotNull() & (F.col("reason") != ""))
    if refused is not None:
        settled = settled.unionByName(refused.select(*own, "reason"))
    # Records that went and came back: does any span cover the time? Merged in order of time,
    # by day, so that neither a record with many spans nor one with many references is a hot group.
    open_ = judged.where(F.col("reason").isNull()).select(*own)
    if open_.isEmpty():
        return settled.select("_row.*", "reason")
    more = records.where("_spans > 1").select(F.col("scope").alias("_scope"), F.col("ref").alias("_key"))
    many = spans.join(more, ["_scope", "_key"], "left_semi").where(F.col("_b").isNotNull()).distinct()
    day = many.groupBy("_scope", "_key", F.to_date("_b").alias("_day")).agg(F.max("_e").alias("_reach"))
    ask = open_.select(F.col("scope").alias("_scope"), F.col("ref").alias("_key"), F.to_date("at").alias("_day")).distinct()
    by_day = Window.partitionBy("_scope", "_key").orderBy("_day", F.col("_reach").isNull().desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both_days = day.unionByName(ask.withColumn("_reach", F.lit(None).cast(day.schema["_reach"].dataType))).groupBy("_scope", "_key", "_day").agg(F.max("_reach").alias("_reach"))
    before = both_days.withColumn("_carry", F.max("_reach").over(by_day.rowsBetween(Window.unboundedPreceding, -1))).select("_scope", "_key", "_day", "_carry")
    ticks = open_.select(F.col("scope").alias("_scope"), F.col("ref").alias("_key"), F.col("at").alias("_t")).distinct().withColumn("_day", F.to_date("_t"))
    marks = (
        ticks.select("_scope", "_key", "_day", "_t", F.lit(1).alias("_asks"), F.lit(None).cast(day.schema["_reach"].dataType).alias("_reach"))
        .unionByName(many.select("_scope", "_key", F.to_date("_b").alias("_day"), F.col("_b").alias("_t"), F.lit(0).alias("_asks"), F.col("_e").alias("_reach")))
    )
    in_day = Window.partitionBy("_scope", "_key", "_day").orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = marks.withColumn("_sofar", F.max("_reach").over(in_day)).where("_asks = 1").select("_scope", "_key", "_day", "_t", "_sofar")
    reach = reach.join(before, ["_scope", "_key", "_day"], "left").withColumn("_upto", F.greatest("_sofar", "_carry"))
    held = reach.select(F.col("_scope").alias("scope"), F.col("_key").alias("ref"), F.col("_t").alias("at"), "_upto")
    rest = salted_join(open_, held, ["scope", "ref", "at"], "left", F.col("_row"), hot_rows)
    gone = rest.where(F.coalesce(F.col("_upto") <= F.col("at"), F.lit(True))).select(*own, F.lit("deleted").alias("reason"))
    return settled.unionByName(gone).select("_row.*", "reason")
