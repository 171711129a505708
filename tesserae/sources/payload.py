"""Scene payloads: JSON texts, one per scene, to the scene model.

A payload is parsed once to VARIANT; every field goes through the coercions of
``tesserae.functions.coerce``. In strict mode a record of the wrong kind raises; otherwise
what cannot be coerced is null or dropped.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import coerce as C
from tesserae.plans import model as M


def read_payloads(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(scene_id, payload): one row per JSON file, named by its path. A byte-order mark is dropped."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.option("wholetext", True).text(paths)
    return files.select(F.col("_metadata.file_path").alias("scene_id"), F.regexp_replace("value", "^﻿", "").alias("payload"))


def payloads_of(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "scene_id string, payload string")


def parsed(payloads: DataFrame, strict: bool = True) -> DataFrame:
    """``payload`` as VARIANT. Strict: anything but a JSON object raises; else such rows are left out."""
    value = F.parse_json("payload") if strict else F.try_parse_json("payload")
    out = payloads.select("scene_id", value.alias("v"))
    if not strict:
        return out.where(C.is_object(F.col("v")))
    checked = F.when(C.is_object(F.col("v")), F.col("v")).otherwise(F.raise_error(F.lit("Scene payload must be a JSON object")).cast("variant"))
    return out.select("scene_id", checked.alias("v"))


def _each(rows: DataFrame, key: str, pos: str, strict: bool, free: bool = False) -> DataFrame:
    """One row per element of a top-level list; free-form lists drop what is no object, the others raise on it."""
    found = C.items(C.child(F.col("v"), key), strict)
    out = rows.select("scene_id", F.posexplode(found).alias(pos, "x"))
    if free or not strict:
        return out.where(C.is_object(F.col("x")))
    message = f"{key} items must be dictionaries"
    return out.withColumn("x", F.when(C.is_object(F.col("x")), F.col("x")).otherwise(F.raise_error(F.lit(message)).cast("variant")))


def _struct(value: Column, fields: dict[str, Callable[[Column], Column]]) -> Column:
    return F.struct(*(make(C.child(value, name)).alias(name) for name, make in fields.items()))


def _material(x: Column, strict: bool) -> Column:
    return _struct(x, {"name": C.text, "shader": C.text, "node_tree": C.text, "image_textures": lambda v: C.texts(v, strict), "settings": C.settings})


def _int(strict: bool, default: int = 0) -> Callable[[Column], Column]:
    return lambda v: C.integer(v, default, strict)


def metadata(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Defaults for what is missing, and for everything if there is no metadata object."""
    m = C.child(F.col("v"), "metadata")
    m = F.when(C.is_object(m), m).otherwise(F.parse_json(F.lit("{}")))
    get = lambda k: C.child(F.col("m"), k)
    return rows.select("scene_id", m.alias("m")).select(
        "scene_id", C.text(get("name")).alias("name"), C.integer(get("frame_start"), 1, strict).alias("frame_start"), C.integer(get("frame_end"), 250, strict).alias("frame_end"),
        C.real(get("fps"), 24.0, strict).alias("fps"), C.text(get("units")).alias("units"), C.text(get("render_engine")).alias("render_engine"),
    )


def collections(rows: DataFrame, strict: bool = True) -> DataFrame:
    x = lambda k: C.child(F.col("x"), k)
    return _each(rows, "collections", "coll_pos", strict).select("scene_id", F.col("coll_pos").cast("long").alias("coll_pos"), C.text(x("name")).alias("name"), C.text(x("id")).alias("id"), C.optional_text(x("parent")).alias("parent"))


def materials(rows: DataFrame, strict: bool = True) -> DataFrame:
    return _each(rows, "materials", "item_pos", strict).select("scene_id", "item_pos", _material(F.col("x"), strict).alias("m")).select("scene_id", "item_pos", "m.*")


def free_form(rows: DataFrame, key: str, strict: bool = True) -> DataFrame:
    return _each(rows, key, "item_pos", strict, free=True).select("scene_id", "item_pos", F.to_json("x").alias("item"))


def objects(rows: DataFrame, strict: bool = True) -> DataFrame:
    x = lambda k: C.child(F.col("x"), k)
    seen = x("visibility")
    bad = F.raise_error(F.lit("object visibility must be a dictionary")).cast("variant") if strict else F.parse_json(F.lit("{}"))
    visibility = F.when(seen.isNull(), F.parse_json(F.lit("{}"))).when(C.is_object(seen), seen).otherwise(bad)
    n = _int(strict)
    mesh = {"name": C.text, **{f"{k}_count": n for k in ("vertex", "face", "edge", "triangle", "uv_map", "vertex_group")}, "has_normals": lambda v: C.flag(v, True)}
    keyframe = {"frame": n, "value": lambda v: C.real(v, 0.0, strict), "interpolation": C.text}
    curve = {
        "name": C.text, "data_path": C.text, "array_index": _int(strict, -1), "interpolation": C.text,
        "keyframes": lambda v: F.transform(C.objects(v, strict), lambda k: _struct(k, keyframe)),
    }
    animation = {"fcurves": n, "is_animated": C.flag, "curves": lambda v: F.transform(C.objects(v, strict), lambda c: _struct(c, curve))}
    modifier = {"name": C.text, "type": C.text, "subtype": C.text, "show_viewport": lambda v: C.flag(v, True), "show_render": lambda v: C.flag(v, True), "settings": C.settings}
    constraint = {"name": C.text, "type": C.text, "target": C.optional_text, "influence": lambda v: C.real(v, 1.0, strict), "settings": C.settings}
    transform = {k: C.reals for k in ("location", "rotation_euler", "rotation_quaternion", "scale")}

    def record(key: str, fields: dict, ddl: str) -> Column:
        return F.when(C.is_object(x(key)), _struct(x(key), fields)).otherwise(F.lit(None)).cast(ddl).alias(key)

    def several(key: str, fields: dict) -> Column:
        return F.transform(C.objects(x(key), strict), lambda e: _struct(e, fields)).alias(key)

    rows = _each(rows, "objects", "obj_pos", strict)
    return rows.select(
        "scene_id", "obj_pos", C.text(x("name")).alias("name"), C.text(x("id")).alias("id"), C.text(x("type")).alias("type"), C.optional_text(x("collection")).alias("collection"),
        C.optional_text(x("parent")).alias("parent"), C.texts(x("children"), strict).alias("children"),
        _struct(visibility, {"hide_render": C.flag, "hide_viewport": C.flag}).alias("visibility"),
        record("mesh", mesh, M.MESH), F.transform(C.objects(x("materials"), strict), lambda e: _material(e, strict)).alias("materials"), several("modifiers", modifier),
        several("constraints", constraint), record("animation", animation, M.ANIMATION), several("bones", {"name": C.text, "parent": C.optional_text}),
        several("particle_systems", {"name": C.text, "count": n}), record("transform", transform, M.TRANSFORM),
        F.when(C.is_object(x("camera")), F.to_json(x("camera"))).alias("camera"), C.texts(x("referenced_assets"), strict).alias("referenced_assets"),
    )


def assets(rows: DataFrame) -> DataFrame:
    """Candidate assets of the payload's ``assets`` list; what is no object is skipped. Frame bounds are not read."""
    x = lambda k: C.child(F.col("x"), k)
    plain = lambda v, default: F.when(v.isNull(), F.lit(default)).otherwise(F.try_variant_get(v, "$", "string"))
    none = F.lit(None).cast("int")
    found = rows.select("scene_id", F.posexplode(C.items(C.child(F.col("v"), "assets"))).alias("asset_pos", "x")).where(C.is_object(F.col("x"))).withColumn("asset_pos", F.col("asset_pos").cast("long"))
    return found.select(
        "scene_id", "asset_pos", plain(x("path"), "").alias("path"), plain(x("kind"), "unknown").alias("kind"), C.integer(x("size_bytes"), 0, True, "bigint").alias("size_bytes"),
        none.alias("frame_start"), none.alias("frame_end"),
    )


def normalize(payloads: DataFrame, strict: bool = True) -> M.SceneTables:
    """The scene model of (scene_id, payload) rows."""
    rows = parsed(payloads, strict)
    return M.SceneTables(
        scenes=metadata(rows, strict),
        collections=collections(rows, strict),
        objects=objects(rows, strict),
        materials=materials(rows, strict),
        lights=free_form(rows, "lights", strict),
        textures=free_form(rows, "textures", strict),
        images=free_form(rows, "images", strict),
        assets=assets(rows),
    )


def placeholder(name: str) -> str:
    """The payload of a source that cannot be read here: its name, the default frames, nothing else."""
    return json.dumps({"metadata": {"name": name, "frame_start": 1, "frame_end": 250, "fps": 24.0}})


def inspect_external(executable: str, script: str, source: str | Path, timeout: int = 60) -> str:
    """The JSON object that an external scene reader prints for a binary scene file.

    Its whole output must be one JSON object; anything else is a RuntimeError.
    """
    done = subprocess.run([executable, "--background", str(source), "--python", script], capture_output=True, text=True, timeout=timeout, check=False)
    if done.returncode:
        raise RuntimeError(f"scene reader failed with {done.returncode}: {done.stderr.strip()}")
    if not done.stdout.strip():
        raise RuntimeError("scene reader printed nothing")
    try:
        found = json.loads(done.stdout)
    except ValueError as error:
        raise RuntimeError("scene reader printed no JSON") from error
    if not isinstance(found, dict):
        raise RuntimeError("scene reader printed no JSON object")
    return done.stdout
