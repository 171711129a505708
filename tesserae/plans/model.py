"""The scene model: a bundle of tables, one job for many scenes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.session import Scratch

KEYFRAME = "struct<frame:int,value:double,interpolation:string>"
CURVE = f"struct<name:string,data_path:string,array_index:int,interpolation:string,keyframes:array<{KEYFRAME}>>"
MESH = "struct<name:string,vertex_count:int,face_count:int,edge_count:int,triangle_count:int,uv_map_count:int,vertex_group_count:int,has_normals:boolean>"
MATERIAL = "struct<name:string,shader:string,node_tree:string,image_textures:array<string>,settings:string>"
MODIFIER = "struct<name:string,type:string,subtype:string,show_viewport:boolean,show_render:boolean,settings:string>"
CONSTRAINT = "struct<name:string,type:string,target:string,influence:double,settings:string>"
ANIMATION = f"struct<fcurves:int,is_animated:boolean,curves:array<{CURVE}>>"
TRANSFORM = "struct<location:array<double>,rotation_euler:array<double>,rotation_quaternion:array<double>,scale:array<double>>"

SCENES = "scene_id string, name string, frame_start int, frame_end int, fps double, units string, render_engine string"
COLLECTIONS = "scene_id string, coll_pos long, name string, id string, parent string"
OBJECTS = (
    "scene_id string, obj_pos int, name string, id string, type string, collection string, parent string, children array<string>, "
    f"visibility struct<hide_render:boolean,hide_viewport:boolean>, mesh {MESH}, materials array<{MATERIAL}>, modifiers array<{MODIFIER}>, "
    f"constraints array<{CONSTRAINT}>, animation {ANIMATION}, bones array<struct<name:string,parent:string>>, "
    f"particle_systems array<struct<name:string,count:int>>, transform {TRANSFORM}, camera string, referenced_assets array<string>"
)
MATERIALS = "scene_id string, item_pos int, name string, shader string, node_tree string, image_textures array<string>, settings string"
#: Scene-level lights, textures and images stay free-form JSON texts.
FREE = "scene_id string, item_pos int, item string"
ASSETS = "scene_id string, asset_pos long, path string, kind string, size_bytes long, frame_start int, frame_end int"


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass
class SceneTables:
    """Normalized scenes. Positions carry the order of the source's lists."""

    scenes: DataFrame
    collections: DataFrame
    objects: DataFrame
    materials: DataFrame
    lights: DataFrame
    textures: DataFrame
    images: DataFrame
    assets: DataFrame
    notes: dict[str, str] = field(default_factory=dict)

    def stored(self, *names: str) -> SceneTables:
        """The same with these tables written to the shared scratch folder, for plans that read them several times."""
        scratch = Scratch(self.spark, "scenes")
        return replace(self, **{n: scratch.save(getattr(self, n))[0] for n in names})

    @property
    def spark(self) -> SparkSession:
        return self.objects.sparkSession


def _defaulted(x: Column, of: str, **defaults: object) -> Column:
    """A struct with defaults for null fields."""
    return F.struct(*[F.coalesce(x[f.name], F.lit(defaults[f.name])).alias(f.name) if f.name in defaults else x[f.name].alias(f.name) for f in T.DataType.fromDDL(of)]).cast(of)


def typed_objects(rows: DataFrame) -> DataFrame:
    """Delivered rows as the normalizer would give them, without a way through JSON: a null counts as a missing key, null elements are dropped.

    Reads the columns that are asked for and no others; keeps ``rows``' columns.
    """

    def listed(c: str, make) -> Column:
        return F.transform(F.filter(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)), lambda x: x.isNotNull()), make)

    def material(m: Column) -> Column:
        textures = F.filter(F.coalesce(m["image_textures"], F.array().cast("array<string>")), lambda t: t.isNotNull())
        return F.struct(*[F.coalesce(m[k], F.lit("")).alias(k) for k in ("name", "shader", "node_tree")], textures.alias("image_textures"), F.coalesce(m["settings"], F.lit("{}")).alias("settings"))

    def curve(c: Column) -> Column:
        keys = F.filter(F.coalesce(c["keyframes"], F.array().cast(f"array<{KEYFRAME}>")), lambda k: k.isNotNull())
        keys = F.transform(keys, lambda k: _defaulted(k, KEYFRAME, frame=0, value=0.0, interpolation=""))
        texts = [F.coalesce(c[k], F.lit("")).alias(k) for k in ("name", "data_path")]
        return F.struct(*texts, F.coalesce(c["array_index"], F.lit(-1)).alias("array_index"), F.coalesce(c["interpolation"], F.lit("")).alias("interpolation"), keys.alias("keyframes"))

    zero = {f"{k}_count": 0 for k in ("vertex", "face", "edge", "triangle", "uv_map", "vertex_group")}
    moves = F.col("animation")
    curves = F.transform(F.filter(F.coalesce(moves["curves"], F.array().cast(f"array<{CURVE}>")), lambda c: c.isNotNull()), curve)
    plain = lambda x: F.coalesce(x, F.lit(""))
    made = {
        "mesh": F.when(F.col("mesh").isNotNull(), _defaulted(F.col("mesh"), MESH, name="", has_normals=True, **zero)),
        "materials": listed("materials", material),
        "modifiers": listed("modifiers", lambda m: _defaulted(m, MODIFIER, name="", type="", subtype="", show_viewport=True, show_render=True, settings="{}")),
        "constraints": listed("constraints", lambda c: _defaulted(c, CONSTRAINT, name="", type="", influence=1.0, settings="{}")),
        "animation": F.when(moves.isNotNull(), F.struct(F.coalesce(moves["fcurves"], F.lit(0)).alias("fcurves"), F.coalesce(moves["is_animated"], F.lit(False)).alias("is_animated"), curves.alias("curves"))),
        "children": listed("children", plain),
        "referenced_assets": listed("referenced_assets", plain),
    }
    return rows.withColumns(made)


def newest(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """Of several rows of one key the last by ``at``; pre-aggregated, no window over a key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_row")).select(*keys, "_row.*")


def from_deliveries(objects: DataFrame, collections: DataFrame, assets: DataFrame | None = None, materials: DataFrame | None = None, textures: DataFrame | None = None, images: DataFrame | None = None) -> SceneTables:
    """The current scenes out of delivered rows: of each (scene, id) the row exported last.

    Null lists are empty and null flags false, as if their keys were missing.
    """
    spark = objects.sparkSession
    at = ["exported_at", "ingested_at", "row_id"]

    def listed(c: str, of: str) -> Column:
        return F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast(f"array<{of}>")).alias(c)

    current = newest(objects.where(F.col("id").isNotNull()), ["scene_id", "id"], at)
    flag = lambda c: F.coalesce(f"visibility.{c}", F.lit(False)).alias(c)
    scene_objects = current.select(
        "scene_id", "obj_pos", F.coalesce("name", F.lit("")).alias("name"), "id", F.coalesce("type", F.lit("")).alias("type"), "collection", "parent",
        listed("children", "string"), F.struct(flag("hide_render"), flag("hide_viewport")).alias("visibility"), "mesh", listed("materials", MATERIAL),
        listed("modifiers", MODIFIER), listed("constraints", CONSTRAINT), "animation", listed("bones", "struct<name:string,parent:string>"),
        listed("particle_systems", "struct<name:string,count:int>"), "transform", "camera", listed("referenced_assets", "string"),
    )
    colls = newest(collections.where(F.col("id").isNotNull()), ["scene_id", "id"], at)
    colls = colls.select("scene_id", F.col("row_id").alias("coll_pos"), F.coalesce("name", F.lit("")).alias("name"), "id", "parent")

    def empty(ddl: str) -> DataFrame:
        return spark.createDataFrame([], schema(ddl))

    return SceneTables(
        scenes=scene_objects.select("scene_id").distinct(),
        collections=colls,
        objects=scene_objects,
        materials=empty(MATERIALS) if materials is None else materials,
        lights=empty(FREE),
        textures=empty(FREE) if textures is None else textures,
        images=empty(FREE) if images is None else images,
        assets=empty(ASSETS) if assets is None else assets,
    )
