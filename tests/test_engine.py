"""The facade, the command line, the cache, and the stream of payload files."""

import json
import os
import sys
import types

import pytest

from tesserae import cli
from tesserae.engine import Request, SceneEngine, SceneLoader
from tesserae.operators import changes
from tesserae.sources import cache, export, payload
from tesserae.streaming import scan

PAYLOAD = {
    "metadata": {"name": "S", "render_engine": "E", "units": "M"},
    "collections": [{"id": "col-1", "name": "Main"}, {"id": "col-empty", "name": "Empty", "parent": "col-1"}],
    "objects": [
        {"id": "hero", "name": "Hero", "type": "MESH", "collection": "col-1", "mesh": {"vertex_count": 8}, "camera": {"lens": 35}, "constraints": [{"name": "t", "target": "obj-ghost"}], "referenced_assets": ["/hero"], "materials": [{"name": "M"}]},
        {"id": "back", "name": "Back", "type": "CAMERA", "parent": "hero", "visibility": {"hide_render": True}, "camera": {}, "referenced_assets": ["/back"], "transform": {"location": [1, 2, 3]}},
    ],
    "materials": [{"name": "M", "settings": {"blend_mode": "CLIP", "double_sided": False}}],
    "textures": [{"name": "T"}], "images": [{"id": "i1", "width": 4}], "lights": [{"name": "L"}],
    "assets": [{"path": "/hero", "kind": "blend", "size_bytes": 5}, {"path": "/back", "size_bytes": 5000}],
}


@pytest.fixture
def source(tmp_path):
    path = tmp_path / "in.json"
    path.write_text("﻿" + json.dumps(PAYLOAD), encoding="utf-8")
    return path


def request(tmp_path, source, **more):
    return Request(str(source), str(tmp_path / "o/scene.json"), str(tmp_path / "o/graph.json"), package_output=str(tmp_path / "o/package.json"), **more)


def test_all_outputs(spark, tmp_path, source):
    r = SceneEngine(spark).run(request(tmp_path, source, build_package=True, optimize_package_by_visibility=True))
    scene = json.loads(r.scene_output_path.read_text())
    assert scene["metadata"]["statistics"] == {"object_count": 2, "mesh_count": 1, "material_count": 1, "texture_count": 1, "image_count": 1, "light_count": 1, "camera_count": 1, "collection_count": 2}
    hero, back = scene["objects"]
    assert hero["mesh"] == "mesh_hero" and hero["transform"]["scale"] == [1.0, 1.0, 1.0] and hero["visible"] and "referenced_assets" not in hero
    assert back["transform"] == {"location": [1.0, 2.0, 3.0], "rotation": [], "scale": []} and not back["renderable"]
    assert [c["id"] for c in scene["cameras"]] == ["camera_hero"] and scene["cameras"][0]["type"] == "Perspective"
    assert scene["collections"][0]["objects"] == ["hero"] and scene["materials"][0]["blend_mode"] == "CLIP" and scene["materials"][0]["double_sided"] is False
    assert scene["textures"][0]["id"] == "T" and scene["images"][0]["width"] == 4 and scene["lights"][0]["color"] == [1, 1, 1]
    assert scene["summary"]["relationships"][0] == {"from": "back", "to": "hero", "relationship": "parent"}
    assert list(scene) == sorted(scene)
    graph = json.loads(r.graph_output_path.read_text())
    assert graph["integrity"]["missing_targets"] == ["obj-ghost"] and [n["id"] for n in graph["integrity"]["unused_nodes"]] == ["col-empty"]
    assert len(r.warnings) == 2 and r.warnings[0].startswith("Warning: 1 referenced")
    package = json.loads(r.package_output_path.read_text())
    assert [a["path"] for a in package["assets"]] == ["/hero"] and package["metadata"]["pruned_size_bytes"] == 5000
    assert r.visible_object_ids == {"hero"}


def test_cache_and_options(spark, tmp_path, source):
    engine, folder = SceneEngine(spark), str(tmp_path / "cache")
    first = engine.run(request(tmp_path, source, build_graph=False, cache_dir=folder))
    assert not first.from_cache and first.graph is None and not os.path.exists(tmp_path / "o/graph.json")
    again = engine.run(request(tmp_path, source, build_package=True, cache_dir=folder))
    assert again.from_cache and again.tables is None and again.package is None and "No changes" in again.messages[0]
    source.write_text(json.dumps(PAYLOAD | {"lights": []}))
    assert not engine.run(request(tmp_path, source, build_graph=False, cache_dir=folder)).from_cache


def test_loading(spark, tmp_path):
    binary = tmp_path / "x.BLEND"
    binary.write_bytes(b"1")
    assert SceneEngine(spark).load(binary)["metadata"]["name"] == "x"
    assert SceneEngine(spark, "prog", "s.py", lambda p, s, f: json.dumps({"by": p + s})).load(binary) == {"by": "progs.py"}
    assert SceneEngine(spark, read_binary=lambda p, s, f: 1 / 0).load(binary, "prog", "s.py")["metadata"]["fps"] == 24.0
    with pytest.raises(ValueError, match="script"):
        SceneEngine(spark, "prog").load(binary)
    with pytest.raises(RuntimeError, match="adapter"):
        SceneLoader().load("x")
    inside = types.ModuleType("host_application")
    sys.modules["host_application"] = inside
    assert SceneEngine(spark, host_module="host_application").load(binary)["metadata"]["name"] == "x"
    inside.context = None
    with pytest.raises(NotImplementedError):
        SceneEngine(spark, host_module="host_application").load(binary)
    inside.load_scene = lambda source: PAYLOAD
    assert SceneLoader(inside, SceneEngine(spark)).load("x").objects.count() == 2
    with pytest.raises(FileNotFoundError):
        SceneEngine(spark).load(tmp_path / "none.json")
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(TypeError):
        SceneEngine(spark).load(tmp_path / "l.json")
    for bad in ({"objects": 3}, {"objects": [1]}, {"lights": {}}, {"objects": [{"visibility": 1}]}):
        with pytest.raises(TypeError):
            SceneEngine(spark).analyze(bad)


def test_external_reader(tmp_path):
    program = tmp_path / "prog"
    for body, fails in (("echo '{\"a\": 1}'", False), ("exit 3", True), ("true", True), ("echo '[1]'", True), ("echo x", True)):
        program.write_text(f"#!/bin/sh\n{body}\n")
        program.chmod(0o755)
        if fails:
            with pytest.raises(RuntimeError):
                payload.inspect_external(str(program), "s.py", "f")
        else:
            assert json.loads(payload.inspect_external(str(program), "s.py", "f")) == {"a": 1}


def test_command_line(spark, tmp_path, source, capsys):
    out = ["-o", str(tmp_path / "s.json"), "--graph-output", str(tmp_path / "g.json"), "--cache-dir", str(tmp_path / "c")]
    assert cli.main([str(source), *out]) == 0
    said = capsys.readouterr()
    assert "Scene snapshot written" in said.out and "Warning" in said.err
    assert cli.main([str(source), *out]) == 0 and "No changes detected" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "none.json")]) == 1
    (tmp_path / "b.blend").write_bytes(b"1")
    assert cli.main([str(tmp_path / "b.blend"), *out, "--blender-executable", "prog"]) == 1 and "reader script" in capsys.readouterr().err
    plain = vars(cli.parser().parse_args(["in", "--no-graph", "--package", "--frame-end", "9"]))
    assert Request(**plain) == Request("in", build_graph=False, build_package=True, frame_end=9)
    source.write_text("{broken")
    assert cli.main([str(source), *out]) == 1


def test_hashes_and_index(tmp_path):
    assert cache.hash_payload({"a": 1, "b": [1, 2]}) == cache.hash_payload({"b": [1, 2], "a": 1}) != cache.hash_payload({"a": 2})
    file = tmp_path / "f.blend"
    file.write_bytes(b"x" * (cache.BLOCK + 1))
    assert cache.hash_source(file) == cache.hash_file(file)
    store = cache.SceneCache(tmp_path / "c")
    assert store.get("k") is None and store.has_changed("k", "h")
    store.put("k", cache.CacheEntry("h", "o"))
    assert store.get("k").scene_output == "o" and not cache.SceneCache(tmp_path / "c").has_changed("k", "h")
    store.invalidate("k")
    assert store.get("k") is None
    for broken in ("{", "[1]"):
        store.index_path.write_text(broken)
        assert store.get("k") is None


def test_content_hash_and_cache_table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", '{"x": 1, "y": 2}'), ("b", '{ "y":2,"x":1 }'), ("c", '{"x": 2}'), ("d", "{"), ("e", None)], "k string, p string")
    found = {r["k"]: r["h"] for r in df.select("k", changes.content_hash(F.col("p")).alias("h")).collect()}
    assert found["a"] == found["b"] != found["c"] and found["d"] is None and found["e"] is None
    schema = "source_key string, source_hash string"
    old, new = spark.createDataFrame([("a", "1"), ("b", "2")], schema), spark.createDataFrame([("b", "3"), ("c", "4"), ("a", "1")], schema)
    assert rows(changes.has_changed(new, old)) == [("a", False), ("b", True), ("c", True)]
    assert rows(changes.upserted(old, new)) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_records_of_many_scenes(spark, tmp_path):
    texts = {k: json.dumps(PAYLOAD) for k in ("s1", "s2")}
    t = payload.normalize(payload.payloads_of(spark, texts))
    export.write_records(t, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/objects")).count() == 4
    with pytest.raises(ValueError, match="several scenes"):
        export.document(t)
    assert export.document(t, "s2")["metadata"]["scene_name"] == "S"


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text(json.dumps(PAYLOAD))
    seen = []
    for _ in range(2):
        scan.analyze_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda t, n: seen.append(t.objects.count())).awaitTermination()
    assert seen == [6]
