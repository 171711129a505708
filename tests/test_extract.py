"""Raw attributes of a host application to payloads, and those to the scene model."""

import json

import pytest

from tesserae.sources import extract, payload

CURVE = {"data_path": "hide_render", "array_index": 0, "points": [{"frame": 1.9, "value": 1.0, "interpolation": "LINEAR"}, {"frame": 5.0, "value": 0.0, "interpolation": "BEZIER"}]}
HERO = {
    "name": "hero", "type": "MESH", "in_collections": ["in", "out"], "children": ["cam"], "hide_render": True, "hide_viewport": False, "vertex_groups": 2, "library": "/a",
    "data": {"name": "m", "vertices": 5, "edges": 8, "corners": [3, 4, 5, 2], "uv_layers": 1, "library": "/b"}, "fcurves": [CURVE], "location": [1.0, 2.0, 3.0],
    "slots": [{"name": "glass", "tree": "t", "nodes": [{"type": "TEX_IMAGE", "image": "i.png"}, {"type": "BSDF", "feeds": "Surface"}, {"type": "MATH", "image": "no"}]}, None, {"name": "plain"}],
    "modifiers": [{"name": "sub", "type": "SUBSURF", "show_viewport": True, "show_render": False}], "constraints": [{"name": "c", "type": "T", "target": "cam"}],
    "particles": [{"name": "p", "live": 0, "authored": 7}, {"name": "q", "live": 3, "authored": 7}],
}
CAM = {"name": "cam", "type": "CAMERA", "parent": "hero", "data": {"name": "d", "kind": "PERSP", "lens": 35.0, "library": ""}, "fcurves": []}
RIG = {"name": "rig", "type": "ARMATURE", "data": {"bones": [{"name": "root"}, {"name": "arm", "parent": "root"}]}}


def test_raw_rows_become_scenes(spark, rows):
    scene = {"name": "S", "frame_start": 1.0, "frame_end": 9.0, "fps": 30.0, "fps_base": 1.25, "units": "METRIC", "render_engine": "E"}
    collections = [{"name": "in", "children": []}, {"name": "out", "children": ["in"]}, {"name": "also", "children": ["in", "also"]}]
    raw = spark.createDataFrame([("s", scene, collections, [HERO, None, CAM, RIG], 0.12345678, [4, 5, 1], True), ("none", scene, None, None, None, None, None)], extract.RAW)
    made = extract.payloads(raw)
    found = json.loads(made.where("scene_id = 's'").first()["payload"])
    assert found["inspection"] == {"duration_seconds": 0.123457, "host_version": [4, 5, 1], "background_mode": True}
    assert found["collections"] == [{"name": "in", "id": "in", "parent": "out"}, {"name": "out", "id": "out", "parent": None}, {"name": "also", "id": "also", "parent": None}]
    hero, cam, rig = found["objects"]
    assert hero["mesh"] == {"name": "m", "vertex_count": 5, "face_count": 4, "edge_count": 8, "triangle_count": 6, "uv_map_count": 1, "vertex_group_count": 2, "has_normals": True}
    assert [(m["name"], m["shader"], m["node_tree"], m["image_textures"]) for m in hero["materials"]] == [("glass", "BSDF", "t", ["i.png"]), ("plain", "SHADERLESS", "", [])]
    assert hero["animation"]["curves"][0]["interpolation"] == "LINEAR" and hero["animation"]["curves"][0]["keyframes"][0]["frame"] == 1
    assert hero["particle_systems"] == [{"name": "p", "count": 7}, {"name": "q", "count": 3}] and hero["referenced_assets"] == ["/a", "/b"] and hero["collection"] == "in"
    assert hero["constraints"][0] == {"name": "c", "type": "T", "target": "cam", "influence": 1.0} and hero["modifiers"][0]["subtype"] == "" and hero["camera"] is None
    assert cam["camera"]["lens"] == 35.0 and cam["camera"]["clip_end"] == 0.0 and cam["mesh"] is None and cam["bones"] == [] and cam["animation"]["is_animated"] is False
    assert rig["bones"] == [{"name": "root", "parent": None}, {"name": "arm", "parent": "root"}] and rig["animation"] is None
    t = payload.normalize(made)
    assert rows(t.scenes, "scene_id", "fps", "frame_end") == [("none", 24.0, 9), ("s", 24.0, 9)]
    assert rows(t.objects, "id", "collection") == [("cam", None), ("hero", "in"), ("rig", None)]


def test_no_open_scene_and_errors(spark):
    raw = spark.createDataFrame([("s", None, [], [], None, None, None)], extract.RAW)
    with pytest.raises(Exception, match="no open scene"):
        extract.payloads(raw).collect()
    error = spark.range(1).selectExpr("'ValueError' AS k", "'bad' AS m", "'at x' AS t").select(extract.error_payload(*map(extract.F.col, "kmt")).alias("e"))
    assert json.loads(error.first()["e"]) == {"generator": "tesserae", "status": "failed", "error": {"type": "ValueError", "message": "bad", "traceback": "at x"}}
    assert spark.range(1).select(extract.version_text(extract.F.array(*map(extract.F.lit, (4, 5, 0))))).first()[0] == "4.5.0"
