"""Derivations a scene extractor makes, as columns and small plans.

The extractor itself runs inside a host application; these are the computations
it applies to what it reads, for sources that deliver raw records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_rate(fps: Column, base: Column) -> Column:
    """Frames per second over their base; a missing or zero base is 1."""
    return fps / F.coalesce(F.nullif(base, F.lit(0)), F.lit(1))


def triangle_count(corners: Column) -> Column:
    """Triangles of polygons given by their numbers of corners."""
    return F.aggregate(corners, F.lit(0), lambda total, n: total + F.greatest(n - 2, F.lit(0)))


def first_parents(collections: DataFrame, scope: str = "scene_id", pos: str = "coll_pos", name: str = "name", children: str = "children") -> DataFrame:
    """(scope, name, parent): of each collection the first other one that lists it among its children."""
    listed = collections.select(F.col(scope), F.col(pos), F.col(name).alias("parent"), F.explode(children).alias("child")).where(F.col("child") != F.col("parent"))
    first = listed.groupBy(scope, "child").agg(F.min_by("parent", pos).alias("parent"))
    return collections.select(F.col(scope), F.col(name).alias("name")).join(first.withColumnRenamed("child", "name"), [scope, "name"], "left")


def shader_name(nodes: Column, output: str = "Surface") -> Column:
    """The type of the node linked to the output's surface; no nodes: SHADERLESS; none linked: UNKNOWN.

    ``nodes``: array<struct<type:string, feeds:string>>.
    """
    linked = F.filter(nodes, lambda n: n["feeds"] == output)
    return F.when(nodes.isNull() | (F.size(nodes) == 0), "SHADERLESS").otherwise(F.coalesce(F.get(linked, F.lit(0))["type"], F.lit("UNKNOWN")))


def distinct_references(*libraries: Column) -> Column:
    """The library paths that are set, each once, in order."""
    return F.array_distinct(F.filter(F.array(*libraries), lambda p: p.isNotNull() & (p != "")))


def is_animated(fcurves: Column) -> Column:
    return F.coalesce(fcurves > 0, F.lit(False))


def curve_interpolation(keyframes: Column) -> Column:
    """A curve's interpolation is that of its first keyframe."""
    return F.coalesce(F.get(keyframes, F.lit(0))["interpolation"], F.lit(""))


def particle_count(live: Column, authored: Column) -> Column:
    """The live count if there are any, else the authored one."""
    return F.when(F.coalesce(live, F.lit(0)) > 0, live).otherwise(F.coalesce(authored, F.lit(0)))


def version_text(parts: Column) -> Column:
    """(4, 5, 0) as "4.5.0"."""
    return F.concat_ws(".", parts.cast("array<string>"))


#: What a host application knows of one object, attribute by attribute.
RAW_OBJECT = (
    "name string, type string, in_collections array<string>, parent string, children array<string>, hide_render boolean, hide_viewport boolean, vertex_groups int, "
    "data struct<name:string,vertices:int,edges:int,corners:array<int>,uv_layers:int,bones:array<struct<name:string,parent:string>>,library:string,"
    "kind:string,lens:double,sensor_width:double,clip_start:double,clip_end:double>, "
    "slots array<struct<name:string,tree:string,nodes:array<struct<type:string,image:string,feeds:string>>>>, "
    "modifiers array<struct<name:string,type:string,subtype:string,show_viewport:boolean,show_render:boolean>>, "
    "constraints array<struct<name:string,type:string,target:string,influence:double>>, "
    "fcurves array<struct<data_path:string,array_index:int,points:array<struct<frame:double,value:double,interpolation:string>>>>, "
    "particles array<struct<name:string,live:int,authored:int>>, "
    "location array<double>, rotation_euler array<double>, rotation_quaternion array<double>, scale array<double>, library string"
)
#: One row per scene; ``scene`` is null if none is open.
RAW = (
    "scene_id string, scene struct<name:string,frame_start:double,frame_end:double,fps:double,fps_base:double,units:string,render_engine:string>, "
    f"collections array<struct<name:string,children:array<string>>>, objects array<struct<{RAW_OBJECT}>>, seconds double, host_version array<int>, background boolean"
)
#: What a payload says of its making.
SCHEMA_VERSION, GENERATOR_VERSION = "1.0", "1.0.0"


def _each(of: Column, make) -> Column:
    """``make`` of the elements of a list that are not null; none of a null list."""
    return F.coalesce(F.transform(F.filter(of, lambda x: x.isNotNull()), make), F.array())


def _named(**columns: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def modifier(m: Column) -> Column:
    return _named(name=m["name"], type=m["type"], subtype=F.coalesce(m["subtype"], F.lit("")), show_viewport=m["show_viewport"], show_render=m["show_render"])


def constraint(c: Column) -> Column:
    return _named(name=c["name"], type=c["type"], target=c["target"], influence=F.coalesce(c["influence"], F.lit(1.0)))


def material(slot: Column) -> Column:
    """Images are those of the texture nodes, whose type is a fixed value."""
    images = _each(slot["nodes"], lambda n: F.when(n["type"] == "TEX_IMAGE", n["image"]))
    return _named(name=slot["name"], shader=shader_name(slot["nodes"]), node_tree=F.coalesce(slot["tree"], F.lit("")), image_textures=F.filter(images, lambda i: i.isNotNull()))


def mesh(o: Column) -> Column:
    d = o["data"]
    count = lambda c: F.coalesce(c, F.lit(0))
    made = _named(
        name=d["name"], vertex_count=count(d["vertices"]), face_count=F.coalesce(F.array_size(d["corners"]), F.lit(0)), edge_count=count(d["edges"]),
        triangle_count=F.coalesce(triangle_count(d["corners"]), F.lit(0)), uv_map_count=count(d["uv_layers"]), vertex_group_count=count(o["vertex_groups"]), has_normals=F.lit(True),
    )
    return F.when((o["type"] == "MESH") & d.isNotNull(), made)


def animation(fcurves: Column) -> Column:
    """Null without an action; frames are cut to whole ones."""
    point = lambda p: _named(frame=p["frame"].cast("int"), value=p["value"], interpolation=p["interpolation"])
    curve = lambda c: _named(
        name=c["data_path"], data_path=c["data_path"], array_index=c["array_index"], keyframes=_each(c["points"], point), interpolation=curve_interpolation(c["points"])
    )
    return F.when(fcurves.isNotNull(), _named(fcurves=F.size(fcurves), is_animated=is_animated(F.size(fcurves)), curves=_each(fcurves, curve)))


def camera(o: Column) -> Column:
    d = o["data"]
    made = _named(type=d["kind"], **{k: F.coalesce(d[k], F.lit(0.0)) for k in ("lens", "sensor_width", "clip_start", "clip_end")})
    return F.when((o["type"] == "CAMERA") & d.isNotNull(), made)


def scene_object(o: Column) -> Column:
    """One record of the payload's objects. Objects are named by their names; the first collection counts."""
    bones = _each(F.when(o["type"] == "ARMATURE", o["data"]["bones"]), lambda b: b)
    systems = _each(o["particles"], lambda p: _named(name=p["name"], count=particle_count(p["live"], p["authored"])))
    return _named(
        name=o["name"], id=o["name"], type=o["type"], collection=F.get(o["in_collections"], F.lit(0)), parent=o["parent"], children=_each(o["children"], lambda c: c),
        visibility=_named(hide_render=o["hide_render"], hide_viewport=o["hide_viewport"]), mesh=mesh(o), materials=_each(o["slots"], material), modifiers=_each(o["modifiers"], modifier),
        constraints=_each(o["constraints"], constraint), animation=animation(o["fcurves"]), bones=bones, particle_systems=systems,
        transform=_named(**{k: o[k] for k in ("location", "rotation_euler", "rotation_quaternion", "scale")}), camera=camera(o), referenced_assets=distinct_references(o["library"], o["data"]["library"]),
    )


def payloads(raw: DataFrame, generator: str = "tesserae") -> DataFrame:
    """(scene_id, payload) out of raw rows (see RAW): what the normalizer reads. Without an open scene there is nothing to read, an error."""
    each = raw.select("scene_id", F.posexplode("collections").alias("coll_pos", "c")).select("scene_id", "coll_pos", "c.name", "c.children")
    parents = first_parents(each).join(each.select("scene_id", "name", "coll_pos"), ["scene_id", "name"])
    listed = parents.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("coll_pos", "name", "parent"))).alias("_listed"))
    s = F.col("scene")
    metadata = _named(
        name=s["name"], frame_start=s["frame_start"].cast("int"), frame_end=s["frame_end"].cast("int"), fps=frame_rate(s["fps"], s["fps_base"]), units=s["units"], render_engine=s["render_engine"]
    )
    none = F.array().cast("array<string>")
    body = _named(
        schema_version=F.lit(SCHEMA_VERSION), generator=F.lit(generator), generator_version=F.lit(GENERATOR_VERSION), metadata=metadata,
        collections=_each(F.col("_listed"), lambda c: _named(name=c["name"], id=c["name"], parent=c["parent"])), objects=_each(F.col("objects"), scene_object),
        lights=none, materials=none, textures=none, images=none,
        inspection=_named(duration_seconds=F.round("seconds", 6), host_version=F.col("host_version"), background_mode=F.col("background")),
    )
    text = F.to_json(body, {"ignoreNullFields": "false"})
    return raw.join(listed, "scene_id", "left").select("scene_id", F.when(s.isNull(), F.raise_error(F.lit("no open scene")).cast("string")).otherwise(text).alias("payload"))


def error_payload(kind: Column, message: Column, trace: Column, generator: str = "tesserae") -> Column:
    """What a failed reading says of itself."""
    return F.to_json(_named(generator=F.lit(generator), status=F.lit("failed"), error=_named(type=kind, message=message, traceback=trace)))
