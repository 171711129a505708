"""The dependency graph: nodes and edges of all scenes in one pass over the objects, and its integrity.

Order is part of the result: of a node met several times the first label and kind count,
of an edge its first place. Places are structs (phase, object position, object id, part, item, inner
item, rank), compared as such, and never a number that would need a window over a whole scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.model import SceneTables
from tesserae.session import Scratch

ORD = "struct<phase:int,obj_pos:bigint,owner:string,part:int,item:int,inner:int,rank:int>"
NODES = f"array<struct<ord:{ORD},id:string,label:string,kind:string>>"
EDGES = f"array<struct<ord:{ORD},source:string,target:string,relationship:string>>"
RELATIONSHIPS = ("parent", "collection", "child", "constraint", "material", "texture", "image", "animation", "references")


def _ord(phase: int, part: int = 0, item: Column | int = 0, inner: Column | int = -1, rank: int = 0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(phase), F.col("obj_pos"), F.col("id"), F.lit(part), lit(item), lit(inner), F.lit(rank))


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _prefixed(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(name, F.lit("")))


def _some(condition: Column, made: Column, of: str) -> Column:
    return F.when(condition, F.array(made)).otherwise(F.array()).cast(of)


def _materials(make, of: str) -> Column:
    """``make(material, i, textures)`` for each material, flattened; textures keep their places, nulls are dropped."""
    return F.flatten(F.transform("materials", lambda m, i: make(m, i, F.coalesce(m["image_textures"], F.array().cast("array<string>"))))).cast(of)


def _animated() -> Column:
    return F.coalesce(F.col("animation.is_animated"), F.lit(False))


def node_stream(t: SceneTables) -> DataFrame:
    """Every mention of a node, with its place."""
    colls = t.collections.select(
        "scene_id",
        F.struct(F.lit(0), F.col("coll_pos"), F.col("id"), F.lit(0), F.lit(0), F.lit(-1), F.lit(0)).cast(ORD).alias("ord"),
        "id", F.col("name").alias("label"), F.lit("collection").alias("kind"),
    )

    def node(place: Column, id_: Column, label: Column, kind: str) -> Column:
        return F.struct(place, id_, F.coalesce(label, F.lit("")), F.lit(kind))

    def of_material(m: Column, i: Column, textures: Column) -> Column:
        def of_texture(x: Column, j: Column) -> Column:
            pair = [node(_ord(2, 2, i, j, r + 1), _prefixed(f"{k}:", x), x, k) for r, k in enumerate(("texture", "image"))]
            return F.when(x.isNull(), F.array().cast(NODES)).otherwise(F.array(*pair).cast(NODES))

        own = F.array(node(_ord(2, 2, i), _prefixed("material:", m["name"]), m["name"], "material")).cast(NODES)
        return F.concat(own, F.flatten(F.transform(textures, of_texture)))

    action = node(_ord(2, 3), F.concat(F.lit("action:"), "id"), F.concat(F.lit("Action:"), "name"), "action")
    assets = F.transform("referenced_assets", lambda a, i: node(_ord(2, 4, i), _prefixed("asset:", a), a, "asset")).cast(NODES)
    own = F.array(node(_ord(1), F.col("id"), F.col("name"), "object")).cast(NODES)
    made = F.concat(own, _materials(of_material, NODES), _some(_animated(), action, NODES), assets)
    return colls.unionByName(t.objects.select("scene_id", F.inline(made)))


def edge_stream(t: SceneTables) -> DataFrame:
    """Every mention of an edge, with its place."""

    def edge(place: Column, source: Column, target: Column, name: str) -> Column:
        return F.struct(place, source, target, F.lit(name))

    own = F.col("id")

    def of_material(m: Column, i: Column, textures: Column) -> Column:
        name = _prefixed("material:", m["name"])

        def of_texture(x: Column, j: Column) -> Column:
            texture, image = _prefixed("texture:", x), _prefixed("image:", x)
            pair = F.array(edge(_ord(2, 2, i, j, 1), name, texture, "texture"), edge(_ord(2, 2, i, j, 2), texture, image, "image"))
            return F.when(x.isNull(), F.array().cast(EDGES)).otherwise(pair.cast(EDGES))

        return F.concat(F.array(edge(_ord(2, 2, i), own, name, "material")).cast(EDGES), F.flatten(F.transform(textures, of_texture)))

    constraints = F.filter(F.transform("constraints", lambda c, i: edge(_ord(2, 1, i), own, c["target"], "constraint")).cast(EDGES), lambda e: _present(e["target"]))
    made = F.concat(
        _some(_present(F.col("parent")), edge(_ord(0), own, F.col("parent"), "parent"), EDGES),
        _some(_present(F.col("collection")), edge(_ord(1), own, F.col("collection"), "collection"), EDGES),
        F.transform("children", lambda c, i: edge(_ord(2, 0, i), own, c, "child")).cast(EDGES),
        constraints,
        _materials(of_material, EDGES),
        _some(_animated(), edge(_ord(2, 3), own, F.concat(F.lit("action:"), "id"), "animation"), EDGES),
        F.transform("referenced_assets", lambda a, i: edge(_ord(2, 4, i), own, _prefixed("asset:", a), "references")).cast(EDGES),
    )
    return t.objects.select("scene_id", F.inline(made))


def stored(t: SceneTables) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, written to the shared scratch folder: what walks the graph reads both again and again."""
    scratch = Scratch(t.spark, "graph")
    return scratch.save(nodes(t))[0], scratch.save(edges(t))[0]


def nodes(t: SceneTables) -> DataFrame:
    """(scene_id, id, label, kind, ord): unique nodes, the first mention wins. Pre-aggregated."""
    first = F.min_by(F.struct("label", "kind"), "ord").alias("_first")
    return node_stream(t).groupBy("scene_id", "id").agg(first, F.min("ord").alias("ord")).select("scene_id", "id", "_first.label", "_first.kind", "ord")


def edges(t: SceneTables) -> DataFrame:
    """(scene_id, source, target, relationship, ord): unique edges at their first place."""
    return edge_stream(t).groupBy("scene_id", "source", "target", "relationship").agg(F.min("ord").alias("ord"))


def missing_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene_id, target, ord): targets that are no node, once each, at the first edge that names them.

    Targets are made unique before the join, so a target that very many edges share is one row.
    """
    targets = edges.groupBy("scene_id", "target").agg(F.min("ord").alias("ord"))
    return targets.join(nodes.select("scene_id", F.col("id").alias("target")), ["scene_id", "target"], "left_anti")


def unused_nodes(nodes: DataFrame, edges: DataFrame, protected: tuple[str, ...] = ("object",)) -> DataFrame:
    """Nodes that no edge points to, except those of protected kinds."""
    targets = edges.select("scene_id", F.col("target").alias("id")).distinct()
    return nodes.where(~F.col("kind").isin(list(protected))).join(targets, ["scene_id", "id"], "left_anti")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene_id, node_count, edge_count)."""
    n = nodes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy("scene_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return n.join(e, "scene_id", "left").na.fill(0, ["edge_count"])


def first_items(df: DataFrame, text: str, n: int = 5) -> DataFrame:
    """(scene_id, total, preview): how many there are, and the first ``n`` texts in order, joined.

    The window keeps ``n`` rows a scene before it shuffles.
    """
    counts = df.groupBy("scene_id").agg(F.count(F.lit(1)).alias("total"))
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy("scene_id").orderBy("ord", text))).where(F.col("_i") <= n)
    shown = ranked.groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(text).alias("t")))), lambda x: x["t"]), ", ").alias("preview"))
    return counts.join(shown, "scene_id")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene_id, missing_count, unused_count, has_issues) of every scene with a node."""
    missing = missing_targets(nodes, edges).groupBy("scene_id").agg(F.count(F.lit(1)).alias("missing_count"))
    unused = unused_nodes(nodes, edges).groupBy("scene_id").agg(F.count(F.lit(1)).alias("unused_count"))
    out = nodes.select("scene_id").distinct().join(missing, "scene_id", "left").join(unused, "scene_id", "left").na.fill(0, ["missing_count", "unused_count"])
    return out.withColumn("has_issues", (F.col("missing_count") + F.col("unused_count")) > 0)


def warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene_id, kind, message): one line for missing targets and one for unused nodes, with the first five."""
    more = F.when(F.col("total") > 5, ", ...").otherwise("")

    def line(df: DataFrame, text: str, kind: str, said: str) -> DataFrame:
        message = F.concat(F.lit("Warning: "), F.col("total").cast("string"), F.lit(said), "preview", more)
        return first_items(df, text).select("scene_id", F.lit(kind).alias("kind"), message.alias("message"))

    missing = line(missing_targets(nodes, edges), "target", "missing", " referenced asset(s) could not be resolved: ")
    unused = line(unused_nodes(nodes, edges), "label", "unused", " asset(s) appear unused (no incoming reference): ")
    return missing.unionByName(unused)
