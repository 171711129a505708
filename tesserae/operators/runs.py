"""Runs of identical or nearly identical consecutive events, collapsed to one event each.

Gaps and islands: every event is canonicalised, and the row number within entity and canonical
event, subtracted from the row number within the entity, is constant along a run; the run is what shares
canonical event and difference. As nearness is defined between neighbours and values may drift along a
chain of near ones, the canonical value of an event is that of the event its chain began with. It tells a chain
from the one before it unless that one began with the same value; then, and where the order leaves a
gap, a new segment begins, and the segment is part of the canonical event. So a value that
comes back after others has the same canonical event again, and the difference tells the runs apart.

An entity is worked on in blocks of its order, so that one entity may hold any share
of all rows: within a block rows become segments, and over an entity only the first
and last segments of its blocks are looked at, to join those that touch.

Defined results: rows without order or value are left out; ties of the order are
taken by ``tie`` (nulls first); null keys form an entity; extra columns are ignored.
NaN differs from every value. An empty table gives no runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import Scratch


def latest(df: DataFrame, keys: Sequence[str], at: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Of the rows that share ``keys``, the ``values`` of the last by ``at``; ties go to the greater values. Pre-aggregated."""
    last = F.max(F.struct(*at, *values)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col("_last")[v].alias(v) for v in values])


def collapse_runs(
    events: DataFrame,
    entity: Sequence[str],
    order: str,
    tie: str,
    value: str,
    tolerance: float = 0.0,
    max_gap: float | None = None,
    block: int = 4096,
) -> DataFrame:
    """One row per run: the entity, first and last order value, count, duration and first value.

    A run goes on while the value differs from the preceding event's by at most
    ``tolerance`` and the order by at most ``max_gap`` (None: any gap). ``block`` is the
    width, in units of the order, of the pieces in which an entity is worked on.
    """
    keys = list(entity)
    kept = events.where(F.col(order).isNotNull() & F.col(value).isNotNull())
    rows = kept.select(
        *keys,
        F.col(order).alias("_o"),
        F.col(tie).alias("_t"),
        F.col(value).cast("double").alias("_v"),
        F.floor(F.col(order) / F.lit(block)).cast("long").alias("_block"),
    )

    def goes_on(before_o, before_v, o, v):
        near = F.abs(v - before_v) <= F.lit(tolerance)
        near &= ~F.isnan(v - before_v)
        return near if max_gap is None else near & ((o - before_o) <= F.lit(max_gap))

    inner = Window.partitionBy(*keys, "_block").orderBy("_o", "_t", "_v")
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_o, before_v = F.lag("_o").over(inner), F.lag("_v").over(inner)
    gap = F.lit(False) if max_gap is None else F.coalesce((F.col("_o") - before_o) > F.lit(max_gap), F.lit(False))
    chained = F.coalesce(goes_on(before_o, before_v, F.col("_o"), F.col("_v")), F.lit(False))
    ends = F.lead("_block").over(inner).isNull()
    rows = rows.withColumns({"_rn": F.row_number().over(inner), "_gap": gap, "_start": F.when(~chained, F.col("_v")), "_end": ends})
    rows = rows.withColumn("_canon", F.last("_start", True).over(upto))
    back = F.col("_start").isNotNull() & (F.col("_gap") | F.coalesce(F.lag("_canon").over(inner) == F.col("_canon"), F.lit(False)))
    rows = rows.withColumn("_segment", F.count_if(back).over(upto))
    same = Window.partitionBy(*keys, "_block", "_segment", "_canon").orderBy("_o", "_t", "_v")
    rows = rows.withColumn("_island", F.col("_rn") - F.row_number().over(same))
    segments = rows.groupBy(*keys, "_block", "_segment", "_canon", "_island").agg(
        F.min("_rn").alias("_seg"),
        F.min("_o").alias("_o1"),
        F.max("_o").alias("_o2"),
        F.min_by("_v", "_rn").alias("_v1"),
        F.max_by("_v", "_rn").alias("_v2"),
        F.count(F.lit(1)).alias("_n"),
        F.bool_or("_end").alias("_end"),
    )
    # Written once, as inner and outer segments of the blocks part ways here.
    segments, _ = Scratch(events.sparkSession, "runs").save(segments.drop("_segment", "_canon").withColumn("_first", F.col("_seg") == 1))
    inside = segments.where(~F.col("_first") & ~F.col("_end"))
    edge = segments.where(F.col("_first") | F.col("_end"))
    outer = Window.partitionBy(*keys).orderBy("_block", "_seg")
    touches = F.coalesce(goes_on(F.lag("_o2").over(outer), F.lag("_v2").over(outer), F.col("_o1"), F.col("_v1")), F.lit(False))
    # Within a block two segments never touch, else they would be one.
    edge = edge.withColumn("_run", F.sum(F.when(touches & (F.lag("_block").over(outer) != F.col("_block")), 0).otherwise(1)).over(outer.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(*keys, "_run").agg(
        F.min("_o1").alias("_o1"), F.max("_o2").alias("_o2"), F.min_by("_v1", F.struct("_block", "_seg")).alias("_v1"), F.sum("_n").alias("_n")
    )
    out = inside.select(*keys, "_o1", "_o2", "_v1", "_n").unionByName(joined.select(*keys, "_o1", "_o2", "_v1", "_n"))
    return out.select(
        *keys,
        F.col("_o1").alias("first_order"),
        F.col("_o2").alias("last_order"),
        F.col("_n").cast("long").alias("n_events"),
        (F.col("_o2") - F.col("_o1")).alias("duration"),
        F.col("_v1").alias("first_value"),
    )
