"""Small scenes through the normalizer and the scene operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import coerce as C
from tesserae.operators import graph, packaging, reach, relations, scheduling, stats, visibility
from tesserae.operators.tasks import Task, TaskQueue
from tesserae.plans import model
from tesserae.sources import extract, payload


def scene(spark, strict=True, **parts):
    return payload.normalize(payload.payloads_of(spark, {"s": json.dumps(parts)}), strict)


def obj(id_, **more):
    return {"id": id_, "name": id_.upper(), "type": "MESH", **more}


def hide(*keys, path="hide_render"):
    return {"animation": {"is_animated": True, "fcurves": 1, "curves": [{"data_path": path, "keyframes": [{"frame": f, "value": v} for f, v in keys]}]}}


@pytest.mark.parametrize(
    ("value", "text", "integer", "real", "flag"),
    [
        ("null", "None", None, None, False), ("true", "True", 1, 1.0, True), ("3.7", "3.7", 3, 3.7, True), ('"12"', "12", 12, 12.0, True), ('"3.7"', "3.7", None, 3.7, True),
        ('"false"', "false", None, None, True), ('""', "", None, None, False), ("[]", "[]", None, None, False), ("{}", "{}", None, None, False), ("0", "0", 0, 0.0, False), (None, "", 7, 7.0, True),
    ],
)
def test_coercions(spark, value, text, integer, real, flag):
    body = "{}" if value is None else f'{{"k": {value}}}'
    x = C.child(F.parse_json(F.lit(body)), "k")
    row = spark.range(1).select(C.text(x), C.integer(x, 7), C.real(x, 7.0), C.flag(x, True)).first()
    assert tuple(row) == (text, integer, real, flag)


def test_strict_coercions_raise(spark):
    for parts in ({"objects": [{"mesh": {"face_count": None}}]}, {"objects": [1]}, {"objects": {}}, {"objects": [{"visibility": None}]}, {"collections": None}):
        with pytest.raises(Exception, match="not an integer|dictionar|expected a list"):
            scene(spark, **parts).objects.collect() + scene(spark, **parts).collections.collect()
    with pytest.raises(Exception, match="JSON object"):
        payload.normalize(payload.payloads_of(spark, {"s": "[1]"})).scenes.collect()
    assert payload.normalize(payload.payloads_of(spark, {"s": "[1]", "t": "{broken"}), strict=False).scenes.count() == 0


def test_defaults_and_dropped_items(spark):
    t = scene(spark, objects=[{"materials": [None, {"name": None, "image_textures": ["a", None, 1]}], "animation": {}, "mesh": {}, "camera": [], "transform": {"location": [1, None, 2]}}], lights=[1, {"name": "l"}])
    o = t.objects.first()
    assert (o["name"], o["id"], o["children"], o["mesh"]["has_normals"], o["mesh"]["face_count"], o["camera"]) == ("", "", [], True, 0, None)
    assert [(m["name"], m["image_textures"]) for m in o["materials"]] == [("None", ["a", "1"])]
    assert o["transform"]["location"] == [1.0, 2.0] and o["animation"]["curves"] == []
    meta = t.scenes.first()
    assert (meta["frame_start"], meta["frame_end"], meta["fps"]) == (1, 250, 24.0) and t.lights.count() == 1


def test_a_byte_order_mark_is_dropped(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{"metadata": {"name": "S"}}', encoding="utf-8")
    assert payload.normalize(payload.read_payloads(spark, str(tmp_path))).scenes.first()["name"] == "S"


def test_statistics_and_relationships(spark, rows):
    t = scene(
        spark, collections=[{"id": "c1"}, {"id": "c2"}], lights=[{}], textures=[{}], images=[{}], materials=[{}],
        objects=[obj("a", children=["b", "b", "ghost"], collection="c1", mesh={}), obj("b", parent="a", type="CAMERA", visibility={"hide_viewport": True}), obj("x", parent="ghost", collection="", **hide((1, 0)))],
    )
    s = stats.scene_statistics(t).first().asDict()
    assert s == {"scene_id": "s", "object_count": 3, "collection_count": 2, "camera_count": 1, "light_count": 1, "material_count": 1, "texture_count": 1, "image_count": 1, "animated_object_count": 1, "visible_object_count": 2}
    e = stats.export_statistics(t).first().asDict()
    assert e["mesh_count"] == 1 and "visible_object_count" not in e
    assert rows(relations.all_relationships(t), "source", "target", "relationship") == [("a", "b", "child"), ("a", "b", "child"), ("a", "c1", "collection"), ("b", "a", "parent")]
    assert relations.all_relationships(t).orderBy("ord").first()["relationship"] == "parent"
    assert rows(relations.collection_members(t), "collection", "member") == [("c1", "a"), ("c2", None)]


def test_graph_first_mention_wins_and_order(spark, rows):
    shared = [{"name": "M", "image_textures": ["t", "t"]}]
    t = scene(
        spark, collections=[{"id": "dup", "name": "Coll"}, {"id": "empty", "name": "Empty"}],
        objects=[obj("a", materials=shared, parent="b", collection="dup", referenced_assets=["/x"]), obj("b", materials=shared, constraints=[{"target": "ghost"}, {"target": ""}], children=[""]), obj("dup", **hide((1, 0)))],
    )
    n, e = graph.nodes(t), graph.edges(t)
    kinds = {r["id"]: (r["label"], r["kind"]) for r in n.collect()}
    assert kinds["dup"] == ("Coll", "collection") and kinds["material:M"] == ("M", "material") and kinds["action:dup"] == ("Action:DUP", "action")
    assert n.where("kind = 'texture'").count() == 1
    order = [(r["source"], r["target"], r["relationship"]) for r in e.orderBy("ord").collect()]
    assert order[:2] == [("a", "b", "parent"), ("a", "dup", "collection")] and order.count(("material:M", "texture:t", "texture")) == 1
    assert order.index(("a", "asset:/x", "references")) < order.index(("b", "", "child")) < order.index(("b", "ghost", "constraint"))
    missing, unused = graph.missing_targets(n, e), graph.unused_nodes(n, e)
    assert [r["target"] for r in missing.orderBy("ord").collect()] == ["", "ghost"]
    assert rows(unused, "id") == [("empty",)]
    assert graph.integrity(n, e).first()["has_issues"] and graph.statistics(n, e).first()["edge_count"] == e.count()


def test_warnings_show_five(spark):
    t = scene(spark, objects=[obj("a", children=[f"g{i}" for i in range(7)])])
    lines = graph.warnings(graph.nodes(t), graph.edges(t)).collect()
    assert [r["message"] for r in lines] == ["Warning: 7 referenced asset(s) could not be resolved: g0, g1, g2, g3, g4, ..."]


@pytest.mark.parametrize(
    ("more", "start", "end", "seen"),
    [
        ({}, 1, 24, True), ({"visibility": {"hide_render": True}}, 1, 24, False), ({"visibility": {"hide_viewport": True}}, 1, 24, True), (hide((1, 1), (50, 0)), 1, 10, False),
        (hide((1, 1), (50, 0)), 40, 60, True), (hide((1, 1), (50, 0)), 60, 80, True), (hide((1, 0), (50, 1)), 40, 60, False), (hide((5, 0.5)), 1, 10, False), (hide((30, 0)), 1, 10, True),
        (hide((1, 1), path="location"), 1, 10, True), (hide(), 1, 10, True), (hide((3, 1), (3, 0)), 10, 20, True), (hide((3, 0), (3, 1)), 10, 20, False), (hide((9, 1), (2, 0)), 3, 5, True),
    ],
)
def test_visibility(spark, more, start, end, seen):
    found = visibility.report(scene(spark, objects=[obj("a", **more)]), start, end).collect()
    assert [r["is_visible"] for r in found] == [seen]


def test_first_curve_of_the_path_decides_and_twins_may_have_both(spark, rows):
    two = {"animation": {"curves": hide((1, 1))["animation"]["curves"] + hide((1, 0))["animation"]["curves"]}}
    t = scene(spark, objects=[obj("a", **two), obj("b"), obj("b", visibility={"hide_render": True})])
    assert rows(visibility.report(t, 1, 5), "object_id", "is_visible") == [("a", False), ("b", False), ("b", True)]
    assert visibility.states(t).where("id = 'b' AND hidden").count() == 1


def test_reach_packages_and_schedules(spark, rows):
    t = scene(
        spark,
        objects=[obj("hero", referenced_assets=["/hero"], children=["limb"]), obj("limb", parent="hero", referenced_assets=["/limb"], constraints=[{"target": "gone"}]), obj("late", referenced_assets=["/late"], **hide((1, 1), (50, 0)))],
        assets=[{"path": "/hero", "size_bytes": 5}, {"path": "/late", "size_bytes": 9000}, {"path": "/free", "kind": "x", "size_bytes": 70}, 3, {"path": "/hero", "size_bytes": 5}],
    )
    n, e = graph.nodes(t), graph.edges(t)
    assert rows(reach.reachable_assets(n, e, packaging.visible_seeds(t, 1, 10)), "path") == [("/hero",), ("/limb",)]
    assert rows(packaging.pruned_for(t, n, e, 1, 10), "path", "is_kept") == [("/free", True), ("/hero", True), ("/hero", True), ("/late", False)]
    m = packaging.optimized(t, n, e, 1, 10).first()
    assert (m["package_id"], m["asset_count"], m["total_size_bytes"], m["pruned_asset_count"], m["pruned_size_bytes"], m["visible_object_count"]) == ("pkg-1-10", 3, 80, 1, 9000, 2)
    costs = scheduling.costs(t, n, e, 1, 100, 4)
    assert [r["estimated_asset_bytes"] for r in costs.orderBy("frame_start").collect()] == [80, 9080, 9080, 9080]
    queue = TaskQueue.of_chunks(costs.orderBy("frame_start").collect())
    assert queue.size() == 4 and queue.dequeue().payload["estimated_asset_bytes"] == 80 and queue.dequeue().task_id.endswith("/worker-1")
    s = scheduling.summary(costs).first()
    assert (s["chunk_count"], s["total_estimated_bytes"], s["max_chunk_bytes"]) == (4, 27320, 9080)


@pytest.mark.parametrize("hot_rows", [20, 10**6])
def test_reach_equals_brute_force(spark, hot_rows):
    """Many start sets, a hub, a chain of 40, cycles, nulls and repeated rows."""
    r = random.Random(6)
    pairs = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(70)] + [("hub", f"h{i}") for i in range(60)] + [("h3", "n1"), ("n2", "hub")]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("c40", "c30"), (None, "n1"), ("n1", None)]
    edges = [(s, a, b) for s in ("s", "t") for a, b in pairs] * 2
    seeds = [(s, w, n) for s, w, n in ((r.choice(["s", "t", "u"]), r.randrange(130), r.choice(["c0", "hub", f"n{r.randrange(60)}"])) for _ in range(200))] + [("s", 129, None)]
    ahead = {}
    for s, a, b in edges:
        if a is not None and b is not None:
            ahead.setdefault((s, a), set()).add(b)
    expected = set()
    for s, w, n in seeds:
        todo = [n] if n else []
        while todo:
            at = todo.pop()
            if (s, w, at) not in expected:
                expected.add((s, w, at))
                todo += ahead.get((s, at), ())
    made = [spark.createDataFrame(x, ddl) for x, ddl in ((edges, "scene_id string, source string, target string"), (seeds, "scene_id string, w int, node string"))]
    found = reach.reachable(*made, "w", 130, hot_rows=hot_rows).collect()
    assert len(found) == len(expected) and {tuple(x) for x in found} == expected


def test_places_beyond_32_bits(spark, rows):
    big = 2**31 + 5
    objects = spark.createDataFrame([], "row_id long, exported_at timestamp, ingested_at timestamp, " + model.OBJECTS)
    ddl = "row_id long, scene_id string, name string, id string, parent string, exported_at timestamp, ingested_at timestamp"
    collections = spark.createDataFrame([(big, "s", "b", "b", None, None, None), (big + 1, "s", "a", "a", "b", None, None)], ddl)
    t = model.from_deliveries(objects, collections)
    assert rows(t.collections, "coll_pos", "id") == [(big, "b"), (big + 1, "a")]
    assert [r["id"] for r in graph.nodes(t).orderBy("ord").collect()] == ["b", "a"]
    assert dict(t.assets.dtypes)["asset_pos"] == "bigint"


def test_reach_on_a_cycle_and_several_starts(spark, rows):
    edges = spark.createDataFrame([("s", a, b) for a, b in ("ab", "bc", "ca", "cd", "xy", "dd")], "scene_id string, source string, target string")
    seeds = spark.createDataFrame([("s", 1, "a"), ("s", 2, "x"), ("s", 2, "x"), ("t", 1, "a")], "scene_id string, w int, node string")
    assert rows(reach.reachable(edges, seeds, "w", 3), "scene_id", "w", "node") == [("s", 1, c) for c in "abcd"] + [("s", 2, "x"), ("s", 2, "y"), ("t", 1, "a")]
    assert reach.reachable(edges, seeds.limit(0), "w", 3).count() == 0


def test_frame_range_of_assets(spark, rows):
    assets = spark.createDataFrame([("s", "a", 1, 1, 24), ("s", "b", 2, 25, 50), ("s", "c", 4, None, 3)], "scene_id string, path string, size_bytes long, frame_start int, frame_end int")
    assert rows(packaging.in_frames(assets, 20, 24), "path") == [("a",), ("c",)]
    assert packaging.manifest(assets, 20, 24).first()["total_size_bytes"] == 5


def test_chunks():
    assert scheduling.chunks(1, 100, 4) == [(0, 1, 25), (1, 26, 50), (2, 51, 75), (3, 76, 100)]
    assert scheduling.chunks(1, 3, 10) == [(0, 1, 1), (1, 2, 2), (2, 3, 3)]
    assert len(scheduling.chunks(1, 10, 6)) == 5
    for bad in ((1, 10, 0), (5, 4, 1)):
        with pytest.raises(ValueError):
            scheduling.chunks(*bad)


def test_queue():
    q = TaskQueue()
    q.enqueue(Task("a"))
    q.enqueue(Task("b", {"x": 1}))
    assert (q.size(), q.dequeue().task_id, q.dequeue().payload, q.dequeue()) == (2, "a", {"x": 1}, None)


def test_extraction(spark):
    polygons = F.array(*map(F.lit, (3, 4, 5, 2, 1)))
    nodes = F.from_json(F.lit('[{"type":"MIX","feeds":"Volume"},{"type":"BSDF","feeds":"Surface"}]'), "array<struct<type:string,feeds:string>>")
    row = spark.range(1).select(
        extract.triangle_count(polygons), extract.frame_rate(F.lit(24.0), F.lit(0.0)), extract.frame_rate(F.lit(24.0), F.lit(2.0)), extract.shader_name(nodes), extract.shader_name(F.slice(nodes, 1, 1)),
        extract.shader_name(F.slice(nodes, 1, 0)), extract.distinct_references(F.lit("/a"), F.lit(None), F.lit("/a"), F.lit("")), extract.particle_count(F.lit(0), F.lit(5)), extract.is_animated(F.lit(None).cast("int")),
    ).first()
    assert tuple(row) == (6, 24.0, 12.0, "BSDF", "UNKNOWN", "SHADERLESS", ["/a"], 5, False)
    colls = spark.createDataFrame([("s", 0, "a", ["b", "a"]), ("s", 1, "b", ["c"]), ("s", 2, "d", ["b"]), ("s", 3, "c", [])], "scene_id string, coll_pos int, name string, children array<string>")
    assert {r["name"]: r["parent"] for r in extract.first_parents(colls).collect()} == {"a": None, "b": "a", "c": "b", "d": None}
