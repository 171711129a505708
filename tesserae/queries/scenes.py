"""Queries of the scene operators, over the current state of the delivered scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import changes, graph, packaging, reach, relations, scheduling, stats, visibility
from tesserae.plans import model
from tesserae.sources import export, extract, payload
from tesserae.sources.tables import table

START, END, WORKERS, LAST = 1, 24, 4, 100


def tables(spark: SparkSession, d: str) -> model.SceneTables:
    """The scenes as last exported; candidate assets are the registered asset nodes, with sizes and frames made of their place."""
    registered = table(spark, d, "nodes").where("kind = 'asset'").groupBy("scene_id", F.expr("substring(id, 7)").alias("path")).agg(F.min("node_ord").alias("asset_pos"))
    n, unbounded = F.col("asset_pos"), F.col("asset_pos") % 10 == 0
    start = F.when(~unbounded, n % 100 + 1).cast("int")
    assets = registered.select(
        "scene_id", "asset_pos", "path", F.lit("blend").alias("kind"), (F.length("path") * 1000 + n * 17).cast("long").alias("size_bytes"),
        start.alias("frame_start"), (start + 49).alias("frame_end"),
    )
    return model.from_deliveries(table(spark, d, "scene_objects"), table(spark, d, "collections"), assets)


def row_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered object as a payload of its own, to go through the normalizer; the row's id names the scene."""
    rows = table(spark, d, "scene_objects")
    plain = ["name", "id", "type", "collection", "parent", "children", "visibility", "mesh", "modifiers", "constraints", "animation", "bones", "particle_systems", "transform", "referenced_assets"]
    listed = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    obj = F.struct(*(listed(c) if rows.schema[c].dataType.typeName() == "array" else F.col(c) for c in plain), listed("materials"), F.try_parse_json("camera").alias("camera"))
    assets = F.transform(F.filter("referenced_assets", lambda a: a.isNotNull()), lambda a, i: F.struct(a.alias("path"), (F.length(a) * 1000 + i).alias("size_bytes")))
    body = F.struct(F.array(obj).alias("objects"), listed("materials"), F.coalesce(assets, F.array().cast("array<struct<path:string,size_bytes:int>>")).alias("assets"))
    return rows.select(F.col("row_id").cast("string").alias("scene_id"), F.to_json(body).alias("payload"))


def file_payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scene_files").select(F.col("file_id").cast("string").alias("scene_id"), F.regexp_replace("payload", r"^[^{]*", "").alias("payload"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = tables(spark, d)
    return graph.nodes(t), graph.edges(t)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return payload.parsed(row_payloads(spark, d), strict=False)


def asset_scan(spark, d):
    return payload.assets(_rows(spark, d)).select(F.col("scene_id").cast("long").alias("row_id"), "asset_pos", "path", "kind", "size_bytes")


def normalize_metadata(spark, d):
    return payload.metadata(payload.parsed(file_payloads(spark, d), strict=False), strict=False).withColumnRenamed("scene_id", "file_id")


def normalize_collections(spark, d):
    return payload.collections(payload.parsed(file_payloads(spark, d), strict=False), strict=False).withColumnRenamed("scene_id", "file_id")


def _payload_objects(spark, d):
    return payload.objects(_rows(spark, d), strict=False).withColumn("row_id", F.col("scene_id").cast("long"))


def normalize_objects(spark, d):
    joined = lambda c: F.array_join(c, "|").alias(c)
    systems = F.array_join(F.transform("particle_systems", lambda p: F.concat_ws(":", p["name"], p["count"].cast("string"))), "|").alias("particle_systems")
    place = [F.get(f"transform.{k}", F.lit(0)).alias(f"{k}_x") for k in ("location", "rotation_euler", "rotation_quaternion", "scale")]
    return _payload_objects(spark, d).select(
        "row_id", "name", "id", "type", "collection", "parent", joined("children"), "visibility.hide_render", "visibility.hide_viewport", joined("referenced_assets"),
        F.array_join(F.transform("bones", lambda b: F.concat_ws("<", b["name"], b["parent"])), "|").alias("bones"), systems, *place, F.get_json_object("camera", "$.lens").cast("double").alias("lens"),
    )


def _file_objects(spark, d):
    """The objects of the raw files, with all that is wrong with them."""
    rows = payload.objects(payload.parsed(file_payloads(spark, d), strict=False), strict=False)
    return rows.withColumn("file_id", F.col("scene_id").cast("long"))


def file_objects(spark, d):
    names = F.array_join(F.transform("materials", lambda m: F.concat_ws("/", m["name"], m["shader"])), "|").alias("materials")
    return _file_objects(spark, d).select("file_id", "obj_pos", "id", "name", "type", "collection", "parent", "visibility.hide_render", "visibility.hide_viewport", names, F.size("constraints").alias("constraints"))


def file_meshes(spark, d):
    return _file_objects(spark, d).where(F.col("mesh").isNotNull()).select("file_id", "obj_pos", *(f"mesh.{c}" for c in ("name", "vertex_count", "face_count", "edge_count", "uv_map_count", "has_normals")))


def file_animations(spark, d):
    return _file_objects(spark, d).where(F.col("animation").isNotNull()).select("file_id", "obj_pos", "animation.fcurves", "animation.is_animated", F.size("animation.curves").alias("curves"))


def _objects(spark, d):
    return model.typed_objects(table(spark, d, "scene_objects"))


def normalize_materials(spark, d):
    rows = payload.materials(_rows(spark, d), strict=False)
    return rows.select(F.col("scene_id").cast("long").alias("row_id"), "item_pos", "name", "shader", "node_tree", F.array_join("image_textures", "|").alias("image_textures"))


def mesh_topology(spark, d):
    return _objects(spark, d).where(F.col("mesh").isNotNull()).select("row_id", *(f"mesh.{c}" for c in ("name", "vertex_count", "face_count", "edge_count", "triangle_count", "uv_map_count", "vertex_group_count", "has_normals")))


def object_materials(spark, d):
    return _objects(spark, d).select("row_id", F.posexplode("materials").alias("pos", "m")).select("row_id", "pos", "m.name", "m.shader", F.array_join("m.image_textures", "|").alias("image_textures"))


def object_modifiers(spark, d):
    return _objects(spark, d).select("row_id", F.posexplode("modifiers").alias("pos", "m")).select("row_id", "pos", "m.name", "m.type", "m.subtype", "m.show_viewport", "m.show_render")


def object_constraints(spark, d):
    return _objects(spark, d).select("row_id", F.posexplode("constraints").alias("pos", "m")).select("row_id", "pos", "m.name", "m.type", "m.target", "m.influence")


def object_references(spark, d):
    return _objects(spark, d).select("row_id", F.posexplode("referenced_assets").alias("pos", "path"))


def keyframe_flatten(spark, d):
    curves = _objects(spark, d).select("row_id", F.posexplode("animation.curves").alias("curve_pos", "c"))
    return curves.select("row_id", "curve_pos", "c.data_path", "c.array_index", F.posexplode("c.keyframes").alias("kf_pos", "k")).select("row_id", "curve_pos", "data_path", "array_index", "kf_pos", "k.frame", "k.value")


def scene_statistics(spark, d):
    return stats.scene_statistics(tables(spark, d))


def export_statistics(spark, d):
    return stats.export_statistics(tables(spark, d))


def relationships_parent(spark, d):
    return relations.parents(tables(spark, d)).drop("ord")


def relationships_child(spark, d):
    return relations.children(tables(spark, d)).drop("ord")


def relationships_collection(spark, d):
    return relations.collections(tables(spark, d)).drop("ord")


def relationships_all(spark, d):
    return relations.all_relationships(tables(spark, d)).drop("ord")


def collection_members(spark, d):
    return relations.collection_members(tables(spark, d)).select("scene_id", "collection", "member")


def graph_nodes(spark, d):
    return graph.nodes(tables(spark, d)).drop("ord")


def graph_edges(spark, d):
    return graph.edges(tables(spark, d)).drop("ord")


def _edges_of(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return graph.edges(tables(spark, d)).where(F.col("relationship") == kind).select("scene_id", "source", "target")

    query.__name__ = f"edges_{kind}"
    return query


def graph_statistics(spark, d):
    return graph.statistics(*_graph(spark, d))


def missing_targets(spark, d):
    return graph.missing_targets(*_graph(spark, d)).drop("ord")


def unused_nodes(spark, d):
    return graph.unused_nodes(*_graph(spark, d)).drop("ord")


def integrity_report(spark, d):
    return graph.integrity(*_graph(spark, d))


def integrity_preview(spark, d):
    return graph.first_items(graph.missing_targets(*_graph(spark, d)), "target")


def integrity_warnings(spark, d):
    return graph.warnings(*_graph(spark, d))


def visibility_static(spark, d):
    return tables(spark, d).objects.select("scene_id", "id", visibility.static().alias("is_visible"))


def visibility_state(spark, d):
    return visibility.states(tables(spark, d))


def visibility_in_range(spark, d):
    rows = tables(spark, d).objects.select("scene_id", "id", visibility.in_range(visibility.keys(), F.lit(START), F.lit(END)).alias("is_visible"))
    return rows.where(F.col("is_visible").isNotNull())


def visibility_held(spark, d):
    rows = tables(spark, d).objects.select("scene_id", "id", visibility.held(visibility.keys(), F.lit(START + 9)).alias("is_visible"))
    return rows.where(F.col("is_visible").isNotNull())


def visibility_report(spark, d):
    return visibility.report(tables(spark, d), START, END)


def _stored(spark: SparkSession, d: str) -> tuple[model.SceneTables, DataFrame, DataFrame]:
    """Scenes and their graph, each made once."""
    t = tables(spark, d).stored("objects")
    return t, *graph.stored(t)


def reachable_assets(spark, d):
    t, nodes, edges = _stored(spark, d)
    return reach.reachable_assets(nodes, edges, packaging.visible_seeds(t, START, END))


def asset_prune(spark, d):
    return packaging.pruned_for(*_stored(spark, d), START, END).select("scene_id", "path", "size_bytes", "is_kept")


def package_frame_range(spark, d):
    return packaging.in_frames(tables(spark, d).assets, START, END).select("scene_id", "path", "kind", "size_bytes")


def package_manifest(spark, d):
    return packaging.manifest(tables(spark, d).assets, START, END)


def package_optimized(spark, d):
    return packaging.optimized(*_stored(spark, d), START, END)


def schedule_chunks(spark, d):
    return scheduling.chunk_table(tables(spark, d), START, LAST, WORKERS).drop("worker")


def schedule_visibility(spark, d):
    shown = visibility.report_by_chunk(tables(spark, d), scheduling.chunks(START, LAST, WORKERS))
    return shown.groupBy("scene_id", "worker").agg(F.count(F.lit(1)).alias("visible_object_count"))


def _costs(spark, d):
    return scheduling.costs(*_stored(spark, d), START, LAST, WORKERS)


def schedule_costs(spark, d):
    return _costs(spark, d)


def schedule_summary(spark, d):
    return scheduling.summary(_costs(spark, d))


def export_objects(spark, d):
    joined = lambda c: F.array_join(c, "|").alias(c)
    rows = export.object_records(tables(spark, d))
    return rows.select("scene_id", "id", "name", "type", "collection", "parent", joined("children"), "visible", "renderable", "mesh", joined("materials"), joined("modifiers"), joined("constraints"), F.get("transform.scale", F.lit(0)).alias("scale_x"))


def export_meshes(spark, d):
    return export.mesh_records(tables(spark, d)).select("scene_id", "id", "name", "vertex_count", "edge_count", "face_count")


def export_cameras(spark, d):
    return export.camera_records(tables(spark, d)).select("scene_id", "id", "name", "type", "lens", "clip_end")


def export_materials(spark, d):
    t = tables(spark, d)
    t.materials = payload.materials(_rows(spark, d), strict=False)
    rows = export.material_records(t)
    return rows.select(F.col("scene_id").cast("long").alias("row_id"), "item_pos", "id", "shader", "blend_mode", "double_sided", F.array_join("textures", "|").alias("textures"))


def content_hash(spark, d):
    return file_payloads(spark, d).select(F.col("scene_id").cast("long").alias("file_id"), changes.content_hash(F.col("payload")).alias("source_hash"))


def file_hash(spark, d):
    return table(spark, d, "scene_files").select("file_id", F.sha2("payload", 256).alias("source_hash"))


def cache_has_changed(spark, d):
    """Whether each source's newest file differs from its first, which is what the cache holds."""
    files = table(spark, d, "scene_files").select("source_key", F.struct("exported_at", "file_id").alias("at"), F.sha2("payload", 256).alias("source_hash"))
    newest = files.groupBy("source_key").agg(F.max_by("source_hash", "at").alias("source_hash"))
    cached = files.groupBy("source_key").agg(F.min_by("source_hash", "at").alias("source_hash"))
    return changes.has_changed(newest, cached)


def triangle_count(spark, d):
    """Polygons of growing numbers of corners, as many as the mesh's faces modulo 9."""
    rows = table(spark, d, "scene_objects").where("mesh.face_count is not null")
    corners = F.transform(F.sequence(F.lit(0), F.col("mesh.face_count") % 9), lambda i: i + 1)
    return rows.select("row_id", extract.triangle_count(corners).alias("triangles"))


def first_listing(spark, d):
    """Of each object the first other one, by place, that lists it as a child."""
    rows = tables(spark, d).objects.select("scene_id", F.struct("obj_pos", "id").alias("coll_pos"), F.col("id").alias("name"), "children")
    return extract.first_parents(rows).where(F.col("parent").isNotNull())


_ALL = [
    file_objects, file_meshes, file_animations, asset_scan, normalize_metadata, normalize_collections, normalize_objects, normalize_materials, mesh_topology, object_materials, object_modifiers, object_constraints, object_references,
    keyframe_flatten, scene_statistics, export_statistics, relationships_parent, relationships_child, relationships_collection, relationships_all, collection_members, graph_nodes, graph_edges,
    *map(_edges_of, graph.RELATIONSHIPS), graph_statistics, missing_targets, unused_nodes, integrity_report, integrity_preview, integrity_warnings, visibility_static, visibility_state,
    visibility_in_range, visibility_held, visibility_report, reachable_assets, asset_prune, package_frame_range, package_manifest, package_optimized, schedule_chunks, schedule_visibility,
    schedule_costs, schedule_summary, export_objects, export_meshes, export_cameras, export_materials, content_hash, file_hash, cache_has_changed, triangle_count, first_listing,
]
QUERIES = {q.__name__: q for q in _ALL}


def _list(c: str) -> str:
    return f"list_filter(coalesce({c}, []), lambda x: x IS NOT NULL) AS {c}"


_O = f"""o AS (SELECT scene_id, obj_pos, coalesce(name, '') AS name, id, coalesce(type, '') AS type, collection, parent, {_list("children")},
        coalesce(visibility.hide_render, false) AS hide_render, coalesce(visibility.hide_viewport, false) AS hide_viewport, mesh, {_list("materials")}, {_list("modifiers")},
        {_list("constraints")}, animation, transform, camera, {_list("referenced_assets")}
    FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, id ORDER BY exported_at DESC NULLS LAST, ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM scene_objects WHERE id IS NOT NULL) WHERE rn = 1)"""
_C = """c AS (SELECT scene_id, row_id AS coll_pos, coalesce(name, '') AS name, id, parent
    FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, id ORDER BY exported_at DESC NULLS LAST, ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM collections WHERE id IS NOT NULL) WHERE rn = 1)"""
_A = """a AS (SELECT scene_id, path, n AS asset_pos, 'blend' AS kind, (length(path) * 1000 + n * 17)::BIGINT AS size_bytes,
        CASE WHEN n % 10 <> 0 THEN (n % 100 + 1)::INT END AS frame_start, CASE WHEN n % 10 <> 0 THEN (n % 100 + 50)::INT END AS frame_end
    FROM (SELECT scene_id, substr(id, 7) AS path, min(node_ord) AS n FROM nodes WHERE kind = 'asset' GROUP BY ALL))"""
_M = f"""{_O}, m AS (SELECT scene_id, obj_pos, id, i - 1 AS i, coalesce(materials[i].name, '') AS name, coalesce(materials[i].image_textures, []) AS tx FROM (SELECT *, unnest(generate_series(1, len(materials))) AS i FROM o)),
    x AS (SELECT scene_id, obj_pos, id, i, j - 1 AS j, name, tx[j] AS t FROM (SELECT *, unnest(generate_series(1, len(tx))) AS j FROM m) WHERE tx[j] IS NOT NULL)"""
_EDGES = f"""{_M}, {_C},
    ea AS (SELECT scene_id, id AS source, parent AS target, 'parent' AS relationship, 0 AS phase, obj_pos, id AS owner, 0 AS part, 0 AS item, -1 AS inr, 0 AS rk FROM o WHERE parent <> ''
        UNION ALL SELECT scene_id, id, collection, 'collection', 1, obj_pos, id, 0, 0, -1, 0 FROM o WHERE collection <> ''
        UNION ALL SELECT scene_id, id, children[i], 'child', 2, obj_pos, id, 0, i - 1, -1, 0 FROM (SELECT *, unnest(generate_series(1, len(children))) AS i FROM o)
        UNION ALL SELECT scene_id, id, constraints[i].target, 'constraint', 2, obj_pos, id, 1, i - 1, -1, 0 FROM (SELECT *, unnest(generate_series(1, len(constraints))) AS i FROM o) WHERE constraints[i].target <> ''
        UNION ALL SELECT scene_id, id, 'material:' || name, 'material', 2, obj_pos, id, 2, i, -1, 0 FROM m
        UNION ALL SELECT scene_id, 'material:' || name, 'texture:' || t, 'texture', 2, obj_pos, id, 2, i, j, 1 FROM x
        UNION ALL SELECT scene_id, 'texture:' || t, 'image:' || t, 'image', 2, obj_pos, id, 2, i, j, 2 FROM x
        UNION ALL SELECT scene_id, id, 'action:' || id, 'animation', 2, obj_pos, id, 3, 0, -1, 0 FROM o WHERE animation.is_animated
        UNION ALL SELECT scene_id, id, 'asset:' || referenced_assets[i], 'references', 2, obj_pos, id, 4, i - 1, -1, 0 FROM (SELECT *, unnest(generate_series(1, len(referenced_assets))) AS i FROM o)),
    e AS (SELECT scene_id, source, target, relationship, min(row(phase, obj_pos, owner, part, item, inr, rk)) AS ord FROM ea GROUP BY scene_id, source, target, relationship),
    na AS (SELECT scene_id, id, name AS label, 'collection' AS kind, 0 AS phase, coll_pos AS obj_pos, id AS owner, 0 AS part, 0 AS item, -1 AS inr, 0 AS rk FROM c
        UNION ALL SELECT scene_id, id, name, 'object', 1, obj_pos, id, 0, 0, -1, 0 FROM o
        UNION ALL SELECT scene_id, 'material:' || name, name, 'material', 2, obj_pos, id, 2, i, -1, 0 FROM m
        UNION ALL SELECT scene_id, 'texture:' || t, t, 'texture', 2, obj_pos, id, 2, i, j, 1 FROM x
        UNION ALL SELECT scene_id, 'image:' || t, t, 'image', 2, obj_pos, id, 2, i, j, 2 FROM x
        UNION ALL SELECT scene_id, 'action:' || id, 'Action:' || name, 'action', 2, obj_pos, id, 3, 0, -1, 0 FROM o WHERE animation.is_animated
        UNION ALL SELECT scene_id, 'asset:' || referenced_assets[i], referenced_assets[i], 'asset', 2, obj_pos, id, 4, i - 1, -1, 0 FROM (SELECT *, unnest(generate_series(1, len(referenced_assets))) AS i FROM o)),
    n AS (SELECT scene_id, id, label, kind, ord FROM (SELECT *, row(phase, obj_pos, owner, part, item, inr, rk) AS ord, row_number() OVER (PARTITION BY scene_id, id ORDER BY phase, obj_pos, owner, part, item, inr, rk) AS rn FROM na) WHERE rn = 1),
    mt AS (SELECT scene_id, target, min(ord) AS ord FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.scene_id = e.scene_id AND n.id = e.target) GROUP BY scene_id, target),
    un AS (SELECT * FROM n WHERE kind <> 'object' AND NOT EXISTS (SELECT 1 FROM e WHERE n.scene_id = e.scene_id AND n.id = e.target))"""


def _preview(of: str, text: str) -> str:
    return f"""SELECT scene_id, count(*) AS total, array_to_string(list(t ORDER BY rn) FILTER (rn <= 5), ', ') AS preview
        FROM (SELECT scene_id, {text} AS t, row_number() OVER (PARTITION BY scene_id ORDER BY ord, {text}) AS rn FROM {of}) GROUP BY scene_id"""


_K = f"""{_O}, kf AS (SELECT scene_id, id, hide_render, i, k[i].frame AS f, k[i].value AS v FROM
        (SELECT *, unnest(generate_series(1, len(k))) AS i FROM (SELECT *, list_filter(animation.curves, lambda x: x.data_path = 'hide_render')[1].keyframes AS k FROM o)) WHERE k[i].frame IS NOT NULL AND k[i].value IS NOT NULL)"""


def _verdict(start: str, end: str, by: str = "", chunks: str = "") -> str:
    """Visible objects: CTE body over o and kf."""
    group = f"scene_id, id{by}"
    return f"""SELECT {group}, coalesce(bool_or(v < 0.5) FILTER (f BETWEEN {start} AND {end}), coalesce(arg_max(v, row(f, i)) FILTER (f <= {start}), arg_min(v, row(f, i))) < 0.5) AS verdict FROM kf{chunks} GROUP BY {group}"""


_VIS = f"""{_K}, kv AS ({_verdict(str(START), str(END))}),
    vis AS (SELECT DISTINCT o.scene_id, o.id AS object_id, coalesce(kv.verdict, NOT o.hide_render) AS is_visible FROM o LEFT JOIN kv ON o.scene_id = kv.scene_id AND o.id = kv.id)"""
_SIZE = -(-(LAST - START + 1) // WORKERS)
_CHUNKS = f"ch AS (SELECT i AS worker, {START} + i * {_SIZE} AS s, least({START} + i * {_SIZE} + {_SIZE} - 1, {LAST}) AS e FROM range({-(-(LAST - START + 1) // _SIZE)}) t(i))"
_CVIS = f"""{_CHUNKS}, kv AS ({_verdict("s", "e", ", worker, s, e", ", ch")}),
    vis AS (SELECT DISTINCT o.scene_id, ch.worker, o.id AS object_id FROM o CROSS JOIN ch LEFT JOIN kv ON o.scene_id = kv.scene_id AND o.id = kv.id AND ch.worker = kv.worker WHERE coalesce(kv.verdict, NOT o.hide_render))"""


def _without_o(sql: str) -> str:
    """CTEs after those of the objects, which are there already."""
    return sql[len(_O) + 2 :]


_REACH = f"""{_EDGES}, {_without_o(_VIS)}, {_A},
    r AS (SELECT scene_id, object_id AS node FROM vis WHERE is_visible AND EXISTS (SELECT 1 FROM n WHERE n.scene_id = vis.scene_id AND n.id = vis.object_id)
        UNION SELECT e.scene_id, e.target FROM r JOIN e ON r.scene_id = e.scene_id AND r.node = e.source),
    ra AS (SELECT DISTINCT n.scene_id, n.label AS path FROM r JOIN n ON r.scene_id = n.scene_id AND r.node = n.id WHERE n.kind = 'asset'),
    kept AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM n WHERE n.kind = 'asset' AND n.scene_id = a.scene_id AND n.label = a.path) OR EXISTS (SELECT 1 FROM ra WHERE ra.scene_id = a.scene_id AND ra.path = a.path) AS is_kept FROM a)"""
_COST = f"""{_EDGES}, {_without_o(_K)}, {_CVIS}, {_A},
    r AS (SELECT scene_id, worker, object_id AS node FROM vis
        UNION SELECT e.scene_id, r.worker, e.target FROM r JOIN e ON r.scene_id = e.scene_id AND r.node = e.source),
    ra AS (SELECT DISTINCT n.scene_id, r.worker, n.label AS path FROM r JOIN n ON r.scene_id = n.scene_id AND r.node = n.id WHERE n.kind = 'asset'),
    cost AS (SELECT sc.scene_id, 'worker-' || ch.worker AS worker_id, ch.s::INT AS frame_start, ch.e::INT AS frame_end,
        (coalesce((SELECT sum(a.size_bytes) FROM a WHERE a.scene_id = sc.scene_id AND (NOT EXISTS (SELECT 1 FROM n WHERE n.kind = 'asset' AND n.scene_id = a.scene_id AND n.label = a.path)
            OR EXISTS (SELECT 1 FROM ra WHERE ra.scene_id = a.scene_id AND ra.worker = ch.worker AND ra.path = a.path))), 0))::BIGINT AS estimated_asset_bytes,
        (SELECT count(*) FROM vis WHERE vis.scene_id = sc.scene_id AND vis.worker = ch.worker) AS visible_object_count
        FROM (SELECT DISTINCT scene_id FROM o) sc CROSS JOIN ch)"""

_STAT = """SELECT s.scene_id, count(o.id) AS object_count, coalesce(any_value(cc.n), 0) AS collection_count, 0::BIGINT AS light_count, 0::BIGINT AS material_count, 0::BIGINT AS texture_count,
        0::BIGINT AS image_count, count(*) FILTER (o.type = 'CAMERA') AS camera_count"""
_STAT_FROM = "FROM (SELECT DISTINCT scene_id FROM o) s JOIN o ON s.scene_id = o.scene_id LEFT JOIN (SELECT scene_id, count(*) AS n FROM c GROUP BY scene_id) cc ON s.scene_id = cc.scene_id GROUP BY s.scene_id"
_PARENTS = "SELECT o.scene_id, o.id AS source, o.parent AS target, 'parent' AS relationship FROM o WHERE o.parent <> '' AND EXISTS (SELECT 1 FROM o p WHERE p.scene_id = o.scene_id AND p.id = o.parent)"
_CHILDREN = "SELECT scene_id, id AS source, ch AS target, 'child' AS relationship FROM (SELECT scene_id, id, unnest(children) AS ch FROM o) q WHERE EXISTS (SELECT 1 FROM o p WHERE p.scene_id = q.scene_id AND p.id = q.ch)"
_INCOLL = "SELECT scene_id, id AS source, collection AS target, 'collection' AS relationship FROM o WHERE collection <> ''"


def _each(column: str, fields: str) -> str:
    """Rows of a nested list after nulls are dropped, with their places."""
    return f"""SELECT row_id, (i - 1)::INT AS pos, {fields} FROM (SELECT row_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT row_id, list_filter({column}, lambda x: x IS NOT NULL) AS l FROM scene_objects))"""


def _kept(column: str, fields: str) -> str:
    """Rows of a nested list, null elements left out but counted in the places."""
    return f"""SELECT row_id, (i - 1)::INT AS pos, {fields} FROM (SELECT row_id, {column} AS l, unnest(generate_series(1, len({column}))) AS i FROM scene_objects) WHERE l[i] IS NOT NULL"""


def _t(c: str) -> str:
    return f"coalesce({c}, '')"


def _tx(c: str) -> str:
    return f"array_to_string(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL), '|')"


_JSON = r"j AS (SELECT file_id, p FROM (SELECT file_id, regexp_replace(payload, '^[^{]*', '') AS p FROM scene_files) WHERE json_valid(p))"

_FILE_OBJECTS = f"{_JSON}, fo AS (SELECT file_id, i, p -> ('$.objects[' || i || ']') AS x FROM (SELECT file_id, p, unnest(range(json_array_length(p, '$.objects')::BIGINT)) AS i FROM j))"


def _text_of(path: str) -> str:
    return f"CASE WHEN json_type(x, '$.{path}') = 'NULL' THEN 'None' ELSE coalesce(x ->> '$.{path}', '') END"


def _int_of(path: str) -> str:
    """Missing 0; texts only if they spell an integer; lists and nulls none."""
    v = f"(x ->> '$.{path}')"
    return f"""CASE WHEN json_type(x, '$.{path}') IS NULL THEN 0 WHEN json_type(x, '$.{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN trunc({v}::DOUBLE)::INT
        WHEN json_type(x, '$.{path}') = 'VARCHAR' AND regexp_full_match(trim({v}), '[+-]?[0-9]+') THEN trim({v})::INT WHEN json_type(x, '$.{path}') = 'BOOLEAN' THEN {v}::BOOLEAN::INT END"""


def _flag_of(path: str, default: str) -> str:
    v = f"(x ->> '$.{path}')"
    return f"""CASE json_type(x, '$.{path}') WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN {v}::BOOLEAN WHEN 'VARCHAR' THEN {v} <> '' WHEN 'ARRAY' THEN json_array_length(x, '$.{path}') > 0
        WHEN 'UBIGINT' THEN {v} <> '0' WHEN 'BIGINT' THEN true WHEN 'DOUBLE' THEN {v}::DOUBLE <> 0 ELSE {default} END"""


SQL = {
    "asset_scan": f"SELECT row_id, pos::BIGINT AS asset_pos, path, 'blend' AS kind, size_bytes FROM ({_each('referenced_assets', 'l[i] AS path, (length(l[i]) * 1000 + i - 1)::BIGINT AS size_bytes')})".replace("'blend' AS kind", "'unknown' AS kind"),
    "normalize_metadata": f"""WITH {_JSON} SELECT file_id::VARCHAR AS file_id, coalesce(p ->> '$.metadata.name', '') AS name, coalesce((p ->> '$.metadata.frame_start')::INT, 1) AS frame_start, coalesce((p ->> '$.metadata.frame_end')::INT, 250) AS frame_end,
        coalesce((p ->> '$.metadata.fps')::DOUBLE, 24.0) AS fps, coalesce(p ->> '$.metadata.units', '') AS units, coalesce(p ->> '$.metadata.render_engine', '') AS render_engine FROM j""",
    "normalize_collections": f"""WITH {_JSON} SELECT file_id::VARCHAR AS file_id, i::BIGINT AS coll_pos, coalesce(x ->> '$.name', '') AS name, coalesce(x ->> '$.id', '') AS id, x ->> '$.parent' AS parent
        FROM (SELECT file_id, i, p -> ('$.collections[' || i || ']') AS x FROM (SELECT file_id, p, unnest(range(json_array_length(p, '$.collections')::BIGINT)) AS i FROM j))""",
    # A zero in JSON has no sign for VARIANT, hence the sums with zero.
    "normalize_objects": f"""SELECT row_id, {_t("name")} AS name, {_t("id")} AS id, {_t("type")} AS type, collection, parent, {_tx("children")} AS children, coalesce(visibility.hide_render, false) AS hide_render,
        coalesce(visibility.hide_viewport, false) AS hide_viewport, {_tx("referenced_assets")} AS referenced_assets,
        array_to_string(list_transform(list_filter(coalesce(bones, []), lambda x: x IS NOT NULL), lambda b: concat_ws('<', coalesce(b.name, ''), b.parent)), '|') AS bones,
        array_to_string(list_transform(list_filter(coalesce(particle_systems, []), lambda x: x IS NOT NULL), lambda p: coalesce(p.name, '') || ':' || coalesce(p.count, 0)), '|') AS particle_systems,
        {", ".join(f"list_filter(transform.{k}, lambda x: x IS NOT NULL)[1] + 0.0 AS {k}_x" for k in ("location", "rotation_euler", "rotation_quaternion", "scale"))},
        (camera ->> '$.lens')::DOUBLE AS lens FROM scene_objects""",
    "file_objects": f"""WITH {_FILE_OBJECTS} SELECT file_id, i::INT AS obj_pos, coalesce(x ->> '$.id', '') AS id, coalesce(x ->> '$.name', '') AS name, coalesce(x ->> '$.type', '') AS type, x ->> '$.collection' AS collection, x ->> '$.parent' AS parent,
        coalesce((x ->> '$.visibility.hide_render')::BOOLEAN, false) AS hide_render, coalesce((x ->> '$.visibility.hide_viewport')::BOOLEAN, false) AS hide_viewport,
        array_to_string(list_transform(from_json(x -> '$.materials', '["JSON"]'), lambda m: coalesce(m ->> '$.name', '') || '/' || coalesce(m ->> '$.shader', '')), '|') AS materials, coalesce(json_array_length(x, '$.constraints'), 0)::INT AS constraints FROM fo""",
    "file_meshes": f"""WITH {_FILE_OBJECTS} SELECT file_id, i::INT AS obj_pos, {_text_of("mesh.name")} AS name, {", ".join(f"{_int_of(f'mesh.{k}_count')} AS {k}_count" for k in ("vertex", "face", "edge", "uv_map"))}, {_flag_of("mesh.has_normals", "true")} AS has_normals
        FROM fo WHERE json_type(x, '$.mesh') = 'OBJECT'""",
    "file_animations": f"""WITH {_FILE_OBJECTS} SELECT file_id, i::INT AS obj_pos, {_int_of("animation.fcurves")} AS fcurves, {_flag_of("animation.is_animated", "false")} AS is_animated, coalesce(json_array_length(x, '$.animation.curves'), 0)::INT AS curves
        FROM fo WHERE json_type(x, '$.animation') = 'OBJECT'""",
    "normalize_materials": f"SELECT row_id, pos AS item_pos, name, shader, node_tree, image_textures FROM ({_kept('materials', f'{_t("l[i].name")} AS name, {_t("l[i].shader")} AS shader, {_t("l[i].node_tree")} AS node_tree, {_tx("l[i].image_textures")} AS image_textures')})",
    "mesh_topology": f"SELECT row_id, {_t('mesh.name')} AS name, " + ", ".join(f"coalesce(mesh.{k}_count, 0) AS {k}_count" for k in ("vertex", "face", "edge", "triangle", "uv_map", "vertex_group")) + ", coalesce(mesh.has_normals, true) AS has_normals FROM scene_objects WHERE mesh IS NOT NULL",
    "object_materials": _each("materials", f"{_t('l[i].name')} AS name, {_t('l[i].shader')} AS shader, {_tx('l[i].image_textures')} AS image_textures"),
    "object_modifiers": _each("modifiers", f"{_t('l[i].name')} AS name, {_t('l[i].type')} AS type, {_t('l[i].subtype')} AS subtype, coalesce(l[i].show_viewport, true) AS show_viewport, coalesce(l[i].show_render, true) AS show_render"),
    "object_constraints": _each("constraints", f"{_t('l[i].name')} AS name, {_t('l[i].type')} AS type, l[i].target AS target, coalesce(l[i].influence, 1.0) AS influence"),
    "object_references": _each("referenced_assets", "l[i] AS path"),
    "keyframe_flatten": f"""SELECT row_id, curve_pos, data_path, array_index, (j - 1)::INT AS kf_pos, coalesce(k[j].frame, 0) AS frame, coalesce(k[j].value, 0.0) AS value FROM (SELECT *, unnest(generate_series(1, len(k))) AS j FROM (
        SELECT row_id, pos AS curve_pos, data_path, array_index, list_filter(ks, lambda x: x IS NOT NULL) AS k FROM ({_each("animation.curves", f"{_t('l[i].data_path')} AS data_path, coalesce(l[i].array_index, -1) AS array_index, l[i].keyframes AS ks")})))""",
    "scene_statistics": f"WITH {_O}, {_C} {_STAT}, count(*) FILTER (o.animation.is_animated) AS animated_object_count, count(*) FILTER (NOT o.hide_render AND NOT o.hide_viewport) AS visible_object_count {_STAT_FROM}",
    "export_statistics": f"WITH {_O}, {_C} {_STAT}, count(*) FILTER (o.mesh IS NOT NULL) AS mesh_count {_STAT_FROM}",
    "relationships_parent": f"WITH {_O} {_PARENTS}",
    "relationships_child": f"WITH {_O} {_CHILDREN}",
    "relationships_collection": f"WITH {_O} {_INCOLL}",
    "relationships_all": f"WITH {_O} {_PARENTS} UNION ALL {_CHILDREN} UNION ALL {_INCOLL}",
    "collection_members": f"WITH {_O}, {_C} SELECT c.scene_id, c.id AS collection, o.id AS member FROM c LEFT JOIN o ON c.scene_id = o.scene_id AND c.id = o.collection",
    "graph_nodes": f"WITH {_EDGES} SELECT scene_id, id, label, kind FROM n",
    "graph_edges": f"WITH {_EDGES} SELECT scene_id, source, target, relationship FROM e",
    **{f"edges_{k}": f"WITH {_EDGES} SELECT scene_id, source, target FROM e WHERE relationship = '{k}'" for k in graph.RELATIONSHIPS},
    "graph_statistics": f"WITH {_EDGES} SELECT n.scene_id, count(*) AS node_count, coalesce(any_value(k), 0) AS edge_count FROM n LEFT JOIN (SELECT scene_id, count(*) AS k FROM e GROUP BY scene_id) q ON n.scene_id = q.scene_id GROUP BY n.scene_id",
    "missing_targets": f"WITH {_EDGES} SELECT scene_id, target FROM mt",
    "unused_nodes": f"WITH {_EDGES} SELECT scene_id, id, label, kind FROM un",
    "integrity_report": f"""WITH {_EDGES} SELECT s.scene_id, coalesce(a.k, 0) AS missing_count, coalesce(b.k, 0) AS unused_count, coalesce(a.k, 0) + coalesce(b.k, 0) > 0 AS has_issues FROM (SELECT DISTINCT scene_id FROM n) s
        LEFT JOIN (SELECT scene_id, count(*) AS k FROM mt GROUP BY scene_id) a ON s.scene_id = a.scene_id LEFT JOIN (SELECT scene_id, count(*) AS k FROM un GROUP BY scene_id) b ON s.scene_id = b.scene_id""",
    "integrity_preview": f"WITH {_EDGES} {_preview('mt', 'target')}",
    "integrity_warnings": f"""WITH {_EDGES} SELECT scene_id, 'missing' AS kind, 'Warning: ' || total || ' referenced asset(s) could not be resolved: ' || preview || CASE WHEN total > 5 THEN ', ...' ELSE '' END AS message FROM ({_preview("mt", "target")})
        UNION ALL SELECT scene_id, 'unused', 'Warning: ' || total || ' asset(s) appear unused (no incoming reference): ' || preview || CASE WHEN total > 5 THEN ', ...' ELSE '' END FROM ({_preview("un", "label")})""",
    "visibility_static": f"WITH {_O} SELECT scene_id, id, NOT hide_render AS is_visible FROM o",
    "visibility_state": f"WITH {_O} SELECT scene_id, id, hide_render AS hidden, hide_render AS render_disabled, hide_viewport AS viewport_disabled, true AS selectable FROM o",
    "visibility_in_range": f"WITH {_K} SELECT scene_id, id, bool_or(v < 0.5) AS is_visible FROM kf WHERE f BETWEEN {START} AND {END} GROUP BY scene_id, id",
    "visibility_held": f"WITH {_K} SELECT scene_id, id, coalesce(arg_max(v, row(f, i)) FILTER (f <= {START + 9}), arg_min(v, row(f, i))) < 0.5 AS is_visible FROM kf GROUP BY scene_id, id",
    "visibility_report": f"WITH {_VIS} SELECT * FROM vis",
    "reachable_assets": f"WITH RECURSIVE {_REACH} SELECT scene_id, path FROM ra",
    "asset_prune": f"WITH RECURSIVE {_REACH} SELECT scene_id, path, size_bytes, is_kept FROM kept",
    "package_frame_range": f"WITH {_A} SELECT scene_id, path, kind, size_bytes FROM a WHERE frame_start IS NULL OR (frame_end >= {START} AND frame_start <= {END})",
    "package_manifest": f"WITH {_A} SELECT scene_id, 'pkg-{START}-{END}' AS package_id, count(*) AS asset_count, count(*) AS required_file_count, sum(size_bytes)::BIGINT AS total_size_bytes FROM a WHERE frame_start IS NULL OR (frame_end >= {START} AND frame_start <= {END}) GROUP BY scene_id",
    "package_optimized": f"""WITH RECURSIVE {_REACH} SELECT k.scene_id, 'pkg-{START}-{END}' AS package_id, count(*) FILTER (sel) AS asset_count, coalesce(sum(size_bytes) FILTER (sel), 0)::BIGINT AS total_size_bytes,
        count(*) FILTER (NOT is_kept) AS pruned_asset_count, coalesce(sum(size_bytes) FILTER (NOT is_kept), 0)::BIGINT AS pruned_size_bytes,
        (SELECT count(*) FROM vis WHERE is_visible AND vis.scene_id = k.scene_id) AS visible_object_count
        FROM (SELECT *, is_kept AND (frame_start IS NULL OR (frame_end >= {START} AND frame_start <= {END})) AS sel FROM kept) k GROUP BY k.scene_id""",
    "schedule_chunks": f"WITH {_O}, {_CHUNKS} SELECT scene_id, 'worker-' || worker AS worker_id, s::INT AS frame_start, e::INT AS frame_end, (e - s + 1)::INT AS frame_count FROM (SELECT DISTINCT scene_id FROM o) CROSS JOIN ch",
    "schedule_visibility": f"WITH {_K}, {_CVIS} SELECT scene_id, worker::INT AS worker, count(*) AS visible_object_count FROM vis GROUP BY scene_id, worker",
    "schedule_costs": f"WITH RECURSIVE {_COST} SELECT * FROM cost",
    "schedule_summary": f"WITH RECURSIVE {_COST} SELECT scene_id, count(*) AS chunk_count, sum(estimated_asset_bytes)::BIGINT AS total_estimated_bytes, max(estimated_asset_bytes) AS max_chunk_bytes FROM cost GROUP BY scene_id",
    "export_objects": f"""WITH {_O} SELECT scene_id, id, name, type, coalesce(collection, '') AS collection, coalesce(parent, '') AS parent, array_to_string(children, '|') AS children, NOT hide_render AND NOT hide_viewport AS visible,
        NOT hide_render AS renderable, CASE WHEN mesh IS NULL THEN '' ELSE 'mesh_' || id END AS mesh, array_to_string(list_transform(materials, lambda x: coalesce(x.name, '')), '|') AS materials,
        array_to_string(list_transform(modifiers, lambda x: coalesce(x.name, '')), '|') AS modifiers, array_to_string(list_transform(constraints, lambda x: coalesce(x.name, '')), '|') AS constraints,
        CASE WHEN transform IS NULL THEN 1.0 ELSE transform.scale[1] END AS scale_x FROM o""",
    "export_meshes": f"WITH {_O} SELECT scene_id, 'mesh_' || id AS id, mesh.name AS name, mesh.vertex_count AS vertex_count, mesh.edge_count AS edge_count, mesh.face_count AS face_count FROM o WHERE mesh IS NOT NULL",
    "export_cameras": f"""WITH {_O} SELECT scene_id, 'camera_' || id AS id, name, coalesce(camera ->> '$.type', 'Perspective') AS type, coalesce((camera ->> '$.lens')::DOUBLE, 0.0) AS lens, coalesce((camera ->> '$.clip_end')::DOUBLE, 0.0) AS clip_end
        FROM o WHERE camera IS NOT NULL AND camera <> '{{}}'""",
    "export_materials": f"SELECT row_id, pos AS item_pos, id, shader, '' AS blend_mode, true AS double_sided, textures FROM ({_kept('materials', f'{_t("l[i].name")} AS id, {_t("l[i].shader")} AS shader, {_tx("l[i].image_textures")} AS textures')})",
    "file_hash": "SELECT file_id, sha256(payload) AS source_hash FROM scene_files",
    "cache_has_changed": "SELECT source_key, arg_max(sha256(payload), row(exported_at, file_id)) <> arg_min(sha256(payload), row(exported_at, file_id)) AS has_changed FROM scene_files GROUP BY source_key",
    "triangle_count": "SELECT row_id, list_sum(list_transform(range(0, mesh.face_count % 9 + 1), lambda i: greatest(i - 1, 0)))::INT AS triangles FROM scene_objects WHERE mesh.face_count IS NOT NULL",
    "first_listing": f"WITH {_O} SELECT scene_id, ch AS name, arg_min(id, row(obj_pos, id)) AS parent FROM (SELECT scene_id, obj_pos, id, unnest(children) AS ch FROM o) q WHERE ch <> id AND EXISTS (SELECT 1 FROM o p WHERE p.scene_id = q.scene_id AND p.id = q.ch) GROUP BY scene_id, ch",
}
