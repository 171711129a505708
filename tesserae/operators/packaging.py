"""Asset packages: by frame range, and pruned to what visible objects reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import reach, visibility
from tesserae.plans.model import SceneTables


def in_frames(assets: DataFrame, start: int, end: int) -> DataFrame:
    """Assets whose frames overlap the range; a null bound overlaps every range."""
    s, e = F.col("frame_start"), F.col("frame_end")
    return assets.where(s.isNull() | e.isNull() | ~((e < start) | (s > end)))


def manifest(assets: DataFrame, start: int, end: int) -> DataFrame:
    """One row per scene with selected assets: its package id, counts and total size."""
    count = F.count(F.lit(1))
    return in_frames(assets, start, end).groupBy("scene_id").agg(
        F.lit(f"pkg-{start}-{end}").alias("package_id"), count.alias("asset_count"), count.alias("required_file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes")
    )


def prune(assets: DataFrame, nodes: DataFrame, reachable: DataFrame) -> DataFrame:
    """Assets with ``is_kept``: reachable ones, and those the graph does not know. Both sides of the joins are unique."""
    known = nodes.where("kind = 'asset'").select("scene_id", F.col("label").alias("path")).distinct().withColumn("_known", F.lit(True))
    found = reachable.select("scene_id", "path").distinct().withColumn("_found", F.lit(True))
    joined = assets.join(known, ["scene_id", "path"], "left").join(found, ["scene_id", "path"], "left")
    return joined.withColumn("is_kept", F.col("_known").isNull() | F.col("_found").isNotNull()).select(*assets.columns, "is_kept")


def visible_seeds(t: SceneTables, start: int, end: int) -> DataFrame:
    return visibility.report(t, start, end).where("is_visible").select("scene_id", F.col("object_id").alias("node")).distinct()


def pruned_for(t: SceneTables, nodes: DataFrame, edges: DataFrame, start: int, end: int) -> DataFrame:
    """The scenes' assets with ``is_kept`` for a frame range."""
    return prune(t.assets, nodes, reach.reachable_assets(nodes, edges, visible_seeds(t, start, end)))


def optimized(t: SceneTables, nodes: DataFrame, edges: DataFrame, start: int, end: int) -> DataFrame:
    """One row per scene with assets: the manifest of the kept ones, what was pruned, and how many objects are visible."""
    judged = pruned_for(t, nodes, edges, start, end)
    chosen = F.col("is_kept") & (F.col("frame_start").isNull() | F.col("frame_end").isNull() | ~((F.col("frame_end") < start) | (F.col("frame_start") > end)))
    sums = judged.groupBy("scene_id").agg(
        F.lit(f"pkg-{start}-{end}").alias("package_id"),
        F.count_if(chosen).alias("asset_count"),
        F.coalesce(F.sum(F.when(chosen, F.col("size_bytes"))), F.lit(0)).alias("total_size_bytes"),
        F.count_if(~F.col("is_kept")).alias("pruned_asset_count"),
        F.coalesce(F.sum(F.when(~F.col("is_kept"), F.col("size_bytes"))), F.lit(0)).alias("pruned_size_bytes"),
    )
    shown = visible_seeds(t, start, end).groupBy("scene_id").agg(F.count(F.lit(1)).alias("visible_object_count"))
    return sums.join(shown, "scene_id", "left").na.fill(0, ["visible_object_count"])
