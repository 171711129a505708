"""Relationships between objects, and between objects and collections; duplicates are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.model import SceneTables
from tesserae.skew import salted_join


def _known(t: SceneTables, name: str) -> DataFrame:
    return t.objects.select("scene_id", F.col("id").alias(name)).distinct()


def _row(df: DataFrame, source: str, target: str, relationship: str, phase: int, item: str | None = None) -> DataFrame:
    ord_ = F.struct(F.lit(phase).alias("phase"), "obj_pos", F.col(item).alias("item") if item else F.lit(0).alias("item"))
    return df.select("scene_id", F.col(source).alias("source"), F.col(target).alias("target"), F.lit(relationship).alias("relationship"), ord_.alias("ord"))


def parents(t: SceneTables) -> DataFrame:
    """Objects whose parent is an object of the scene. A parent that very many share is split."""
    named = t.objects.where(F.col("parent") != "").select("scene_id", "obj_pos", "id", "parent")
    return _row(salted_join(named, _known(t, "parent"), ["scene_id", "parent"], "left_semi", F.col("id")), "id", "parent", "parent", 0)


def children(t: SceneTables) -> DataFrame:
    """Listed children that are objects of the scene; a child listed twice counts twice."""
    listed = t.objects.select("scene_id", "obj_pos", "id", F.posexplode("children").alias("item", "child"))
    return _row(salted_join(listed, _known(t, "child"), ["scene_id", "child"], "left_semi", F.struct("id", "item")), "id", "child", "child", 1, "item")


def collections(t: SceneTables) -> DataFrame:
    """Objects with a collection, whether or not the collection is known."""
    return _row(t.objects.where(F.col("collection") != ""), "id", "collection", "collection", 2)


def all_relationships(t: SceneTables) -> DataFrame:
    return parents(t).unionByName(children(t)).unionByName(collections(t))


def collection_members(t: SceneTables) -> DataFrame:
    """(scene_id, collection, id, obj_pos) per member, and one row with null id for a collection without any.

    Members stay rows: a collection may hold any share of a scene's objects.
    """
    members = t.objects.select("scene_id", F.col("collection").alias("_c"), F.col("id").alias("member"), "obj_pos")
    colls = t.collections.select("scene_id", F.col("id").alias("collection")).distinct()
    held = salted_join(members.withColumnRenamed("_c", "collection"), colls, ["scene_id", "collection"], "inner", F.col("member"))
    none = colls.join(members.select("scene_id", F.col("_c").alias("collection")).distinct(), ["scene_id", "collection"], "left_anti")
    return held.unionByName(none, allowMissingColumns=True)
