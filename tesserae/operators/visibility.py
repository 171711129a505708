"""Which objects are visible in a frame range: static flags overridden by the first ``hide_render`` curve.

In a range with keyframes an object is visible if one of these is below the threshold, whatever
value the curve enters the range with; without any, the value held at its start decides, or the first
keyframe's if none came before. Works on each object's own arrays: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.plans.model import SceneTables

PATH = "hide_render"
THRESHOLD = 0.5


def keys(path: str = PATH) -> Column:
    """The keyframes (frame, place, value) of the first curve of ``path``; null without such a curve, and
    keyframes without frame or value left out."""
    curves = F.filter("animation.curves", lambda c: c["data_path"] == path)
    keyframes = F.get(curves, F.lit(0))["keyframes"]
    placed = F.transform(keyframes, lambda k, i: F.struct(k["frame"].alias("frame"), i.alias("pos"), k["value"].alias("value")))
    return F.filter(placed, lambda k: k["frame"].isNotNull() & k["value"].isNotNull())


def static() -> Column:
    """Without a curve: not hidden in renders. The viewport flag has no say."""
    return ~F.coalesce(F.col("visibility.hide_render"), F.lit(False))


def in_range(k: Column, start: Column, end: Column) -> Column:
    """Visible by a keyframe within the range; null if there is none."""
    inside = F.filter(k, lambda x: x["frame"].between(start, end))
    return F.when(F.size(inside) > 0, F.exists(inside, lambda x: x["value"] < THRESHOLD))


def held(k: Column, start: Column) -> Column:
    """Visible by the value held at ``start``: of the last keyframe up to it, else of the first."""
    last = F.array_max(F.filter(k, lambda x: x["frame"] <= start))["value"]
    return F.coalesce(last, F.array_min(k)["value"]) < THRESHOLD


def visible(k: Column, start: Column, end: Column) -> Column:
    return F.coalesce(F.when(F.size(k) > 0, F.coalesce(in_range(k, start, end), held(k, start))), static())


def report(t: SceneTables, start: int, end: int) -> DataFrame:
    """(scene_id, object_id, is_visible): each object's verdict; objects that share an id may have both."""
    rows = t.objects.select("scene_id", F.col("id").alias("object_id"), visible(keys(), F.lit(start), F.lit(end)).alias("is_visible"))
    return rows.distinct()


def report_by_chunk(t: SceneTables, chunks: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(scene_id, worker, object_id) of the objects visible in each (worker, start, end) chunk.

    The chunks are a parameter, so each object is unfolded by them; nothing is joined.
    """
    ranges = F.array(*(F.struct(F.lit(w).alias("worker"), F.lit(s).alias("start"), F.lit(e).alias("end")) for w, s, e in chunks))
    rows = t.objects.select("scene_id", "id", "visibility", keys().alias("_k"), F.inline(ranges))
    shown = rows.where(visible(F.col("_k"), F.col("start"), F.col("end")))
    return shown.select("scene_id", "worker", F.col("id").alias("object_id")).distinct()


def states(t: SceneTables) -> DataFrame:
    """The moment's state by flags alone."""
    hidden = F.coalesce("visibility.hide_render", F.lit(False))
    return t.objects.select(
        "scene_id", "id", hidden.alias("hidden"), hidden.alias("render_disabled"), F.coalesce("visibility.hide_viewport", F.lit(False)).alias("viewport_disabled"), F.lit(True).alias("selectable")
    )
