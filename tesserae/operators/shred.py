"""Adjacency-table shredding of deeply nested records into related flat tables.

``adjacency`` turns every row into nodes: one for each struct, array element and
scalar below the given columns, each with its parent, its label, its ordinal and,
for scalars, its value. ``entity_table`` joins the object nodes of one record type
with their scalar children and pivots these into columns.

A record type is named by its label path without positions ("animation/curves"),
a record by the positions of the array elements on its way ("2", "2/0"; "" if there
are none), and a record's parent by the record type above it and the positions there.

Defined results: a null struct, array or scalar gives no node; a null array element
gives none either but keeps its position; a struct that is present is a record even
if all its fields are null; an empty array gives no nodes. A null row key is kept as
a key of its own. Rows that repeat a key count as one: where their records collide,
the greatest value is kept. Columns not named in ``columns`` are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.session import Scratch

OBJECT, SCALAR = "object", "scalar"


#: The columns of a node, with their types.
NODE = {"entity": "string", "pos": "string", "parent_entity": "string", "parent_pos": "string", "label": "string", "ordinal": "int", "kind": "string", "scalar": "string"}


def _text(value: Column, kind: T.DataType) -> Column:
    """A scalar leaf as text; arrays of scalars that stay leaves become JSON."""
    return F.to_json(value) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else value.cast("string")


def _join_pos(pos: Column, i: Column) -> Column:
    return F.when(pos == "", i.cast("string")).otherwise(F.concat(pos, F.lit("/"), i.cast("string")))


def _paths(kind: T.DataType, path: str) -> list[str]:
    """The record types at and below ``path``."""
    if isinstance(kind, T.ArrayType):
        return [path] + (_paths(kind.elementType, path)[1:] if isinstance(kind.elementType, T.StructType) else [])
    if isinstance(kind, T.StructType):
        return [path] + [p for f in kind.fields for p in _paths(f.dataType, f"{path}/{f.name}")]
    return []


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType))


class _Walk:
    """Builds the expression that turns the columns of a row into its nodes.

    Only nodes of ``entities`` are made, scalars only where ``scalars`` says so, and of each node only ``fields``.
    """

    def __init__(self, entities: set[str] | None, scalars: bool, fields: Sequence[str]):
        self.entities, self.scalars, self.fields = entities, scalars, fields
        self.type = f"array<struct<{','.join(f'{f}:{NODE[f]}' for f in fields)}>>"

    def wanted(self, path: str) -> bool:
        return self.entities is None or path in self.entities

    def below(self, kind: T.DataType, path: str) -> bool:
        return any(map(self.wanted, _paths(kind, path)))

    def empty(self) -> Column:
        return F.array().cast(self.type)

    def node(self, entity: str, pos: Column, above: str, above_pos: Column, label: str, ordinal: Column, kind: str, scalar: Column) -> Column:
        values = {"entity": F.lit(entity), "pos": pos, "parent_entity": F.lit(above), "parent_pos": above_pos, "label": F.lit(label), "ordinal": ordinal, "kind": F.lit(kind), "scalar": scalar}
        return F.array(F.struct(*[values[f].cast(NODE[f]).alias(f) for f in self.fields]))

    def value(self, value: Column, kind: T.DataType, label: str, above: str, pos: Column) -> Column | None:
        """The nodes of ``value``, which sits under ``label`` in the record (``above``, ``pos``); None if there can't be any."""
        path = f"{above}/{label}" if above else label
        if isinstance(kind, T.StructType):
            parts = self.parts(value, kind, path, pos)
            if self.wanted(path):
                parts.insert(0, self.node(path, pos, above, pos, label, F.lit(0), OBJECT, F.lit(None)))
        elif isinstance(kind, T.ArrayType):
            parts = [self.elements(value, kind.elementType, label, above, path, pos)] if self.below(kind, path) else []
        else:
            parts = [self.node(above, pos, above, pos, label, F.lit(0), SCALAR, _text(value, kind))] if self.scalars and self.wanted(above) else []
        if not parts:
            return None
        return F.when(value.isNull(), self.empty()).otherwise(parts[0] if len(parts) == 1 else F.concat(*parts))

    def parts(self, value: Column, kind: T.StructType, path: str, pos: Column) -> list[Column]:
        found = (self.value(value[f.name], f.dataType, f.name, path, pos) for f in kind.fields)
        return [p for p in found if p is not None]

    def elements(self, value: Column, element: T.DataType, label: str, above: str, path: str, pos: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            here = _join_pos(pos, i)
            inner = isinstance(element, T.StructType)
            parts = self.parts(x, element, path, here) if inner else []
            if self.wanted(path):
                parts.insert(0, self.node(path, here, above, pos, label, i, OBJECT, F.lit(None) if inner else _text(x, element)))
            return F.when(x.isNull(), self.empty()).otherwise(parts[0] if len(parts) == 1 else F.concat(*parts))

        return F.flatten(F.transform(value, one))


def record_types(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Every record type that shredding ``columns`` gives, outermost first."""
    return [p for c in columns for p in _paths(df.schema[c].dataType, c)]


def adjacency(df: DataFrame, key: str, columns: Sequence[str], entities: Sequence[str] | None = None, scalars: bool = True, fields: Sequence[str] = tuple(NODE)) -> DataFrame:
    """The adjacency table (key, entity, pos, parent_entity, parent_pos, label, ordinal, kind, scalar) of ``columns``.

    One pass over the rows, without a shuffle. ``entities`` keeps the nodes of these record types only, ``scalars`` = False the object
    nodes only, ``fields`` these columns only.
    """
    walk = _Walk(None if entities is None else set(entities), scalars, list(fields))
    parts = [walk.value(F.col(f"`{c}`"), df.schema[c].dataType, c, "", F.lit("")) for c in columns]
    parts = [p for p in parts if p is not None] or [walk.empty()]
    return df.select(F.col(f"`{key}`").alias("key"), F.inline(parts[0] if len(parts) == 1 else F.concat(*parts)))


def _scalar_fields(df: DataFrame, entity: str) -> list[T.StructField]:
    kind: T.DataType = df.schema
    for label in entity.split("/"):
        kind = kind[label].dataType
        if isinstance(kind, T.ArrayType):
            kind = kind.elementType
    return [f for f in kind.fields if not _nested(f.dataType)] if isinstance(kind, T.StructType) else []


def entity_table(nodes: DataFrame, entity: str, labels: Sequence[str | T.StructField]) -> DataFrame:
    """The flat table of one record type out of the adjacency table.

    Scalar children are pivoted per parent first, with map-side pre-aggregation (all
    children of a record leave the same task), so that the join with the object
    nodes moves one row per record and not one per field. Columns: key, pos,
    parent_entity, parent_pos, label, ordinal, scalar, then one per label.
    """
    fields = [f if isinstance(f, T.StructField) else T.StructField(f, T.StringType()) for f in labels]
    objects = (
        nodes.where((F.col("entity") == entity) & (F.col("kind") == OBJECT))
        .groupBy("key", "pos")
        .agg(*(F.max(c).alias(c) for c in ("parent_entity", "parent_pos", "label", "ordinal", "scalar")))
    )
    if not fields:
        return objects
    children = (
        nodes.where((F.col("entity") == entity) & (F.col("kind") == SCALAR))
        .groupBy(F.col("key").alias("_key"), F.col("pos").alias("_pos"))
        .agg(*(F.max(F.when(F.col("label") == f.name, F.col("scalar"))).cast(f.dataType).alias(f"v_{f.name}") for f in fields))
    )
    return objects.join(children, objects["key"].eqNullSafe(children["_key"]) & (objects["pos"] == children["_pos"]), "left").drop("_key", "_pos")


def records(df: DataFrame, key: str, columns: Sequence[str], entities: Sequence[str] | None = None) -> DataFrame:
    """(key, entity, pos): the records of all types without their values. As no scalar is asked for there is nothing
    to pivot or join: the object nodes of the adjacency table are the records."""
    return adjacency(df, key, columns, entities, scalars=False, fields=["entity", "pos"]).distinct()


def shred(df: DataFrame, key: str, columns: Sequence[str], entities: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every record type's flat table, by its label path. Value columns are prefixed ``v_``,
    so that they cannot clash with the link columns.

    The rows are read once: the adjacency table is stored in the shared scratch folder, in a
    folder of its own for each record type and kind, of which each flat table reads two.
    """
    return _flat_tables(df, key, columns, entities, Scratch(df.sparkSession, "adjacency"))


def _flat_tables(df: DataFrame, key: str, columns: Sequence[str], entities: Sequence[str] | None, scratch: Scratch) -> dict[str, DataFrame]:
    wanted = list(entities) if entities is not None else record_types(df, columns)
    nodes = adjacency(df, key, columns, wanted)
    saved = scratch.save(nodes, partition_by=["entity", "kind"])[0]
    return {e: entity_table(saved, e, _scalar_fields(df, e)) for e in wanted}


def stored(df: DataFrame, key: str, columns: Sequence[str], entities: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The same, with each flat table written whole to the shared scratch folder, so that what reads a few of its
    columns neither leaves out the others nor joins and pivots again. The adjacency table goes once all are written."""
    nodes, flat = Scratch(df.sparkSession, "adjacency"), Scratch(df.sparkSession, "flat")
    tables = {e: flat.save(t)[0] for e, t in _flat_tables(df, key, columns, entities, nodes).items()}
    nodes.drop(nodes.root)
    return tables
