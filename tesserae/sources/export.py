"""The exported document of a scene: its records as tables, and single scenes as JSON files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import graph, relations, stats
from tesserae.plans.model import SceneTables

SCHEMA_VERSION = "v1.0.0"


def _vector(name: str, default: list[float]) -> Column:
    """A transform's vector; the default only if there is no transform at all."""
    return F.when(F.col("transform").isNull(), F.array(*map(F.lit, default)).cast("array<double>")).otherwise(F.coalesce(f"transform.{name}", F.array().cast("array<double>")))


def _names(column: str) -> Column:
    return F.transform(column, lambda x: F.coalesce(x["name"], F.lit("")))


def object_records(t: SceneTables) -> DataFrame:
    hidden, unseen = F.col("visibility.hide_render"), F.col("visibility.hide_viewport")
    return t.objects.select(
        "scene_id", "obj_pos", "id", "name", "type", F.coalesce("collection", F.lit("")).alias("collection"), F.coalesce("parent", F.lit("")).alias("parent"), "children",
        (~hidden & ~unseen).alias("visible"), (~hidden).alias("renderable"),
        F.struct(_vector("location", [0, 0, 0]).alias("location"), _vector("rotation_euler", [0, 0, 0]).alias("rotation"), _vector("scale", [1, 1, 1]).alias("scale")).alias("transform"),
        F.when(F.col("mesh").isNotNull(), F.concat(F.lit("mesh_"), "id")).otherwise("").alias("mesh"),
        _names("materials").alias("materials"), _names("modifiers").alias("modifiers"), _names("constraints").alias("constraints"), F.create_map().cast("map<string,string>").alias("custom_properties"),
    )


def mesh_records(t: SceneTables) -> DataFrame:
    empty = F.array().cast("array<string>")
    return t.objects.where(F.col("mesh").isNotNull()).select(
        "scene_id", "obj_pos", F.concat(F.lit("mesh_"), "id").alias("id"), "mesh.name", "mesh.vertex_count", "mesh.edge_count", "mesh.face_count",
        *(empty.alias(c) for c in ("uv_layers", "vertex_groups", "shape_keys", "material_slots")),
    )


def _member(item: str, key: str, default: object, type_: str) -> Column:
    """A member of a free-form record; only a missing one takes the default."""
    value = F.variant_get(F.parse_json(item), f"$.{key}", "variant")
    plain = F.to_json(value) if type_ == "json" else F.try_variant_get(value, "$", type_)
    return F.when(value.isNull(), F.lit(default)).otherwise(plain)


def camera_records(t: SceneTables) -> DataFrame:
    """Objects of any type with a camera that is not empty."""
    number = lambda k: _member("camera", k, 0.0, "double").alias(k)
    return t.objects.where(F.col("camera").isNotNull() & (F.col("camera") != "{}")).select(
        "scene_id", "obj_pos", F.concat(F.lit("camera_"), "id").alias("id"), "name", _member("camera", "type", "Perspective", "string").alias("type"),
        number("lens"), number("clip_start"), number("clip_end"), _vector("location", [0, 0, 0]).alias("location"), _vector("rotation_euler", [0, 0, 0]).alias("rotation"),
    )


def material_records(t: SceneTables) -> DataFrame:
    return t.materials.select(
        "scene_id", "item_pos", F.col("name").alias("id"), "name", "shader", _member("settings", "blend_mode", "", "string").alias("blend_mode"),
        _member("settings", "double_sided", True, "boolean").alias("double_sided"), F.col("image_textures").alias("textures"), F.array().cast("array<string>").alias("referenced_by"),
    )


def _free(items: DataFrame, fields: dict[str, tuple[object, str]], lists: tuple[str, ...] = ()) -> DataFrame:
    """Records of a free-form list; an id falls back on the name, and that on nothing."""
    name = _member("item", "name", "", "string")
    own = F.variant_get(F.parse_json("item"), "$.id", "variant")
    id_ = F.when(own.isNull(), name).otherwise(F.try_variant_get(own, "$", "string"))
    return items.select("scene_id", "item_pos", id_.alias("id"), name.alias("name"), *(_member("item", k, d, type_).alias(k) for k, (d, type_) in fields.items()), *(F.array().cast("array<string>").alias(c) for c in lists))


def texture_records(t: SceneTables) -> DataFrame:
    return _free(t.textures, {"type": ("Image", "string"), "image": ("", "string"), "color_space": ("", "string"), "mapping": ("{}", "json")}, ("referenced_by",))


def image_records(t: SceneTables) -> DataFrame:
    return _free(t.images, {"filepath": ("", "string"), "width": (0, "int"), "height": (0, "int"), "format": ("", "string")}, ("used_by",))


def light_records(t: SceneTables) -> DataFrame:
    return _free(
        t.lights,
        {"type": ("Point", "string"), "color": ("[1,1,1]", "json"), "energy": (0.0, "double"), "radius": (0.0, "double"), "location": ("[0,0,0]", "json"), "rotation": ("[0,0,0]", "json")},
    )


def collection_records(t: SceneTables) -> DataFrame:
    return t.collections.select("scene_id", "coll_pos", "id", "name", F.coalesce("parent", F.lit("")).alias("parent"), F.array().cast("array<string>").alias("children"))


#: Members that are JSON themselves.
_JSON = {"mapping", "color", "location", "rotation"}


def _records(df: DataFrame, order: str) -> list[dict]:
    """One scene's records in order, as Python values: what a document holds fits the driver."""
    rows = df.orderBy(order).drop("scene_id", order)
    out = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    return [{k: json.loads(v) if k in _JSON and isinstance(v, str) else v for k, v in r.items()} for r in out]


def _only(t: SceneTables, scene_id: str | None) -> SceneTables:
    if scene_id is None:
        return t
    parts = {k: getattr(t, k).where(F.col("scene_id") == scene_id) for k in ("scenes", "collections", "objects", "materials", "lights", "textures", "images", "assets")}
    return SceneTables(**parts)


def document(t: SceneTables, scene_id: str | None = None) -> dict:
    """The document of one scene; of several held ``scene_id`` names it."""
    if scene_id is None and len(t.scenes.select("scene_id").distinct().limit(2).collect()) > 1:
        raise ValueError("several scenes; name one")
    t = _only(t, scene_id)
    counters = stats.export_statistics(t).drop("scene_id").first()
    meta = t.scenes.first()
    get = lambda k: (meta[k] if meta is not None and k in meta.__fields__ else "") or ""
    objects, cameras = _records(object_records(t), "obj_pos"), _records(camera_records(t), "obj_pos")
    related = [r.asDict() for r in relations.all_relationships(t).orderBy("ord").select(F.col("source").alias("from"), F.col("target").alias("to"), "relationship").collect()]
    members: dict[str, list[str]] = {}
    for r in t.objects.where(F.col("collection").isNotNull()).orderBy("obj_pos").select("collection", "id").collect():
        members.setdefault(r["collection"], []).append(r["id"])
    collections = [c | {"objects": members.get(c["id"], [])} for c in _records(collection_records(t), "coll_pos")]
    materials, textures = _records(material_records(t), "item_pos"), _records(texture_records(t), "item_pos")
    images, lights = _records(image_records(t), "item_pos"), _records(light_records(t), "item_pos")
    return {
        "schema_version": SCHEMA_VERSION,
        "metadata": {
            "scene_name": get("name"), "scene_path": "", "engine": get("render_engine"), "format": "", "unit": get("units"), "up_axis": "", "created_at": "", "modified_at": "",
            "statistics": counters.asDict() if counters else {},
        },
        "objects": objects, "collections": collections, "meshes": _records(mesh_records(t), "obj_pos"), "materials": materials, "textures": textures, "images": images, "lights": lights, "cameras": cameras,
        "summary": {
            "objects": [o["id"] for o in objects], "collections": [c["id"] for c in collections], "materials": [m["name"] for m in materials], "textures": [x["id"] for x in textures],
            "images": [x["id"] for x in images], "lights": [x["id"] for x in lights], "cameras": [c["id"] for c in cameras], "relationships": related,
        },
    }


def graph_document(nodes: DataFrame, edges: DataFrame) -> dict:
    """One scene's graph in order of mention, with its statistics and integrity."""
    n = [{"id": r["id"], "label": r["label"], "kind": r["kind"]} for r in nodes.orderBy("ord").collect()]
    e = [{"source": r["source"], "target": r["target"], "relationship": r["relationship"]} for r in edges.orderBy("ord").collect()]
    missing = [r["target"] for r in graph.missing_targets(nodes, edges).orderBy("ord").collect()]
    unused = [{"id": r["id"], "label": r["label"], "kind": r["kind"]} for r in graph.unused_nodes(nodes, edges).orderBy("ord").collect()]
    return {
        "nodes": n, "edges": e, "statistics": {"node_count": len(n), "edge_count": len(e)},
        "integrity": {"missing_targets": missing, "unused_nodes": unused, "has_issues": bool(missing or unused)},
    }


def write_json(document: dict, path: str | Path, sort_keys: bool = False) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(document, indent=2, sort_keys=sort_keys), encoding="utf-8")
    return path


def write_records(t: SceneTables, folder: str) -> None:
    """The records of all scenes as JSON lines, one folder per section, written by the executors."""
    made = {
        "objects": object_records(t), "collections": collection_records(t), "meshes": mesh_records(t), "materials": material_records(t), "textures": texture_records(t), "images": image_records(t),
        "lights": light_records(t), "cameras": camera_records(t), "relationships": relations.all_relationships(t).drop("ord"), "statistics": stats.export_statistics(t),
    }
    for name, df in made.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder.rstrip('/')}/{name}")
