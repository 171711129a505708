"""Frames shared out to workers, with the bytes each chunk needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import reach, visibility
from tesserae.plans.model import SceneTables


def chunks(start: int, end: int, workers: int) -> list[tuple[int, int, int]]:
    """Contiguous (worker, first, last) ranges of equal length but the last; there may be fewer than workers."""
    if workers < 1:
        raise ValueError("worker_count must be at least 1")
    if end < start:
        raise ValueError("frame_end must not be before frame_start")
    size = max(1, -(-(end - start + 1) // workers))
    return [(i, s, min(s + size - 1, end)) for i, s in enumerate(range(start, end + 1, size))]


def chunk_table(t: SceneTables, start: int, end: int, workers: int) -> DataFrame:
    """(scene_id, worker, worker_id, frame_start, frame_end, frame_count): every scene's chunks."""
    ranges = F.array(*(F.struct(F.lit(w).alias("worker"), F.lit(f"worker-{w}").alias("worker_id"), F.lit(s).alias("frame_start"), F.lit(e).alias("frame_end")) for w, s, e in chunks(start, end, workers)))
    return t.scenes.select("scene_id").distinct().select("scene_id", F.inline(ranges)).withColumn("frame_count", F.col("frame_end") - F.col("frame_start") + 1)


def costs(t: SceneTables, nodes: DataFrame, edges: DataFrame, start: int, end: int, workers: int) -> DataFrame:
    """Every chunk with its visible objects and the bytes of the assets it needs, for all chunks in one walk of the graph.

    A chunk needs what its visible objects reach and all that the graph does not know; an
    asset that is listed twice counts twice, and frame bounds have no say.
    """
    shown = visibility.report_by_chunk(t, chunks(start, end, workers))
    found = reach.reachable_assets(nodes, edges, shown.withColumnRenamed("object_id", "node"), "worker", workers)
    sizes = t.assets.groupBy("scene_id", "path").agg(F.sum("size_bytes").alias("_bytes"))
    known = nodes.where("kind = 'asset'").select("scene_id", F.col("label").alias("path")).distinct()
    needed = found.join(sizes, ["scene_id", "path"]).groupBy("scene_id", "worker").agg(F.sum("_bytes").alias("_needed"))
    unknown = sizes.join(known, ["scene_id", "path"], "left_anti").groupBy("scene_id").agg(F.sum("_bytes").alias("_unknown"))
    counts = shown.groupBy("scene_id", "worker").agg(F.count(F.lit(1)).alias("visible_object_count"))
    out = chunk_table(t, start, end, workers).join(needed, ["scene_id", "worker"], "left").join(unknown, "scene_id", "left").join(counts, ["scene_id", "worker"], "left")
    total = F.coalesce("_needed", F.lit(0)) + F.coalesce("_unknown", F.lit(0))
    return out.select("scene_id", "worker_id", "frame_start", "frame_end", total.alias("estimated_asset_bytes"), F.coalesce("visible_object_count", F.lit(0)).alias("visible_object_count"))


def summary(chunk_costs: DataFrame) -> DataFrame:
    """(scene_id, chunk_count, total_estimated_bytes, max_chunk_bytes): shared assets count once per chunk."""
    return chunk_costs.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum("estimated_asset_bytes").alias("total_estimated_bytes"), F.max("estimated_asset_bytes").alias("max_chunk_bytes")
    )
