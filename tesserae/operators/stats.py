"""Scene statistics: counters of the snapshot, and those of the exported document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.plans.model import SceneTables


def _counted(t: SceneTables, parts: dict[str, DataFrame], of_objects: list) -> DataFrame:
    """One row per scene: pre-aggregated counts of each table, missing ones 0."""
    counts = [t.objects.groupBy("scene_id").agg(F.count(F.lit(1)).alias("object_count"), *of_objects)]
    counts += [df.groupBy("scene_id").agg(F.count(F.lit(1)).alias(name)) for name, df in parts.items()]
    every = reduce(lambda a, b: a.join(b, "scene_id", "left"), counts, t.scenes.select("scene_id").distinct())
    return every.na.fill(0)


def _lists(t: SceneTables) -> dict[str, DataFrame]:
    return {"collection_count": t.collections, "light_count": t.lights, "material_count": t.materials, "texture_count": t.textures, "image_count": t.images}


def _cameras() -> Column:
    return F.count_if(F.col("type") == "CAMERA").alias("camera_count")


def scene_statistics(t: SceneTables) -> DataFrame:
    """Nine counters. Lights are the scene-level ones; visible is neither hidden in renders nor in viewports."""
    animated = F.count_if(F.coalesce("animation.is_animated", F.lit(False))).alias("animated_object_count")
    visible = F.count_if(~F.col("visibility.hide_render") & ~F.col("visibility.hide_viewport")).alias("visible_object_count")
    return _counted(t, _lists(t), [_cameras(), animated, visible])


def export_statistics(t: SceneTables) -> DataFrame:
    """Eight counters: those of the document, with meshes and without animated and visible objects."""
    return _counted(t, _lists(t), [_cameras(), F.count_if(F.col("mesh").isNotNull()).alias("mesh_count")])
