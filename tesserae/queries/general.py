"""Queries p1 to p5: shredding, schema drift, runs, hierarchies, orphan references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import hierarchy as H
from tesserae.operators import references as R
from tesserae.operators import runs, schema_drift, shred
from tesserae.sources.tables import table

RECORDS = {
    "mesh": "mesh",
    "materials": "materials",
    "image_textures": "materials/image_textures",
    "animation": "animation",
    "curves": "animation/curves",
    "keyframes": "animation/curves/keyframes",
}
NEST = ["mesh", "materials", "animation"]


def _entity(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = RECORDS[name]
    return shred.shred(table(spark, d, "scene_objects"), "row_id", [path.split("/")[0]], [path])[path]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    flat = shred.stored(table(spark, d, "scene_objects"), "row_id", NEST, list(RECORDS.values()))
    found = [flat[path].select(F.col("key").alias("row_id"), F.lit(name).alias("child_table"), F.col("pos").alias("path")) for name, path in RECORDS.items()]
    return reduce(DataFrame.unionByName, found)


def p1_materials(spark: SparkSession, d: str) -> DataFrame:
    t = _entity(spark, d, "materials")
    return t.select(F.col("key").alias("row_id"), "ordinal", F.col("v_name").alias("name"), F.col("v_shader").alias("shader"), F.col("v_node_tree").alias("node_tree"))


def p1_mesh(spark: SparkSession, d: str) -> DataFrame:
    t = _entity(spark, d, "mesh")
    return t.select(F.col("key").alias("row_id"), *(F.col(f"v_{c}").alias(c) for c in ("name", "vertex_count", "face_count", "edge_count", "has_normals")))


def p1_keyframes(spark: SparkSession, d: str) -> DataFrame:
    t = _entity(spark, d, "keyframes")
    return t.select(F.col("key").alias("row_id"), F.col("parent_pos").cast("int").alias("curve"), "ordinal", F.col("v_frame").alias("frame"), F.col("v_interpolation").alias("interpolation"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.differences(table(spark, d, "scene_files"), ["mesh", "animation"]).select("file_id", "field_path", "change")


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    heads = schema_drift.headers(table(spark, d, "scene_files"), ["mesh", "animation"], keep=["scene_id", "source_key"], whole=True)
    return schema_drift.unified_of(heads, ["mesh", "animation"], renames=schema_drift.fold_names(schema_drift.changes(heads)))


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    curve = ["scene_id", "object_id", "curve_pos"]
    keys = runs.latest(table(spark, d, "keyframes"), [*curve, "kf_pos"], ["ingested_at"], ["frame", "value"])
    found = runs.collapse_runs(keys, curve, "frame", "kf_pos", "value", tolerance=0.0005, max_gap=12)
    return found.select(*curve, F.col("first_order").alias("first_frame"), F.col("last_order").alias("last_frame"), F.col("n_events").alias("n_keys"), "duration")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_runs(spark, d).where("n_keys >= 3").drop("duration")


def _hierarchy_nodes(spark: SparkSession, d: str) -> DataFrame:
    def last(name: str, *values: str) -> DataFrame:
        rows = table(spark, d, name).where(F.col("id").isNotNull())
        newest = F.max_by(F.struct(*values), F.struct("exported_at", "ingested_at", "row_id")).alias("_last")
        return rows.groupBy("scene_id", "id").agg(newest).select("scene_id", "id", "_last.*")

    collections = last("collections", "parent").select(F.lit("collection").alias("kind"), "scene_id", "id", "parent")
    objects = last("scene_objects", "parent", "children")
    # Each object, and each child it lists, as a row; so the table is read and shuffled once.
    own = F.array(F.struct("id", F.lit(True).alias("own"), F.expr("nullif(parent, '')").alias("parent"), F.lit(None).cast("string").alias("lister")))
    listed = F.transform(F.filter("children", lambda c: c != ""), lambda c: F.struct(c.alias("id"), F.lit(False).alias("own"), F.lit(None).cast("string").alias("parent"), F.col("id").alias("lister")))
    seen = objects.select("scene_id", F.inline(F.concat(own, F.coalesce(listed, F.array().cast("array<struct<id:string,own:boolean,parent:string,lister:string>>")))))
    told = seen.groupBy("scene_id", "id").agg(F.bool_or("own").alias("own"), F.max("parent").alias("parent"), F.min("lister").alias("lister")).where("own")
    objects = told.select(F.lit("object").alias("kind"), "scene_id", "id", F.coalesce("parent", "lister").alias("parent"))
    return collections.unionByName(objects)


def _trees(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return H.hierarchy(_hierarchy_nodes(spark, d), ["kind", "scene_id"], paths=paths)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d, paths=False).select("kind", "scene_id", F.col("id").alias("node_id"), F.coalesce("root", F.lit("")).alias("root_id"), "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d).where("depth >= 0").select("kind", "scene_id", F.col("id").alias("node_id"), F.array_join("path", " > ").alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    pairs = H.descendants(_trees(spark, d), ["kind", "scene_id"])
    return pairs.groupBy("kind", "scene_id", F.col("ancestor").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n_descendants"), F.count_if(F.col("distance") == 1).alias("n_children"), F.max("distance").alias("height")
    )


def p4_cycles(spark: SparkSession, d: str) -> DataFrame:
    return H.cycle_members(_trees(spark, d, paths=False), ["kind", "scene_id"]).withColumnRenamed("id", "node_id")


def _references(spark: SparkSession, d: str) -> DataFrame:
    objects, edges = table(spark, d, "scene_objects"), table(spark, d, "edges")
    at = F.col("exported_at").alias("at")
    parent = objects.select(F.lit("scene_objects.parent").alias("ref_table"), "row_id", F.lit(0).alias("ref_pos"), "scene_id", F.col("parent").alias("ref"), at)
    targets = objects.select(F.lit("scene_objects.constraints").alias("ref_table"), "row_id", "scene_id", at, F.posexplode("constraints.target").alias("ref_pos", "ref"))
    assets = objects.select(F.lit("scene_objects.referenced_assets").alias("ref_table"), "row_id", "scene_id", at, F.posexplode("referenced_assets").alias("ref_pos", "_path"))
    assets = assets.where("_path <> ''").withColumn("ref", F.concat(F.lit("asset:"), "_path")).drop("_path")
    edge = edges.select(F.lit("edges.target").alias("ref_table"), F.col("edge_id").alias("row_id"), F.lit(0).alias("ref_pos"), "scene_id", F.col("target").alias("ref"), F.col("built_at").alias("at"))
    return parent.unionByName(targets).unionByName(assets).unionByName(edge)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans(_references(spark, d), table(spark, d, "nodes")).withColumn("period", F.date_format("at", "yyyy-MM"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "row_id", "ref_pos", "reason", "period")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("n_orphans"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_mesh, p1_materials, p1_keyframes, p2_found, p2_unified, p3_found, p3_runs, p4_found, p4_paths, p4_descendants, p4_cycles, p5_found, p5_report)
}

_EACH = "unnest(generate_series(0, len({0}) - 1))"
_CURVE_KEYS = """
    SELECT scene_id, object_id, curve_pos, kf_pos, frame, value FROM (
        SELECT *, row_number() OVER (PARTITION BY scene_id, object_id, curve_pos, kf_pos
            ORDER BY ingested_at DESC NULLS LAST, frame DESC NULLS LAST, value DESC NULLS LAST) AS rn FROM keyframes)
    WHERE rn = 1 AND frame IS NOT NULL AND value IS NOT NULL"""
_RUNS = f"""
    WITH k AS ({_CURVE_KEYS}),
    f AS (SELECT *, CASE WHEN abs(value - lag(value) OVER w) <= 0.0005 AND frame - lag(frame) OVER w <= 12 THEN 0 ELSE 1 END AS starts
          FROM k WINDOW w AS (PARTITION BY scene_id, object_id, curve_pos ORDER BY frame, kf_pos, value)),
    r AS (SELECT *, sum(starts) OVER (PARTITION BY scene_id, object_id, curve_pos ORDER BY frame, kf_pos, value ROWS UNBOUNDED PRECEDING) AS run FROM f)
    SELECT scene_id, object_id, curve_pos, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_keys, max(frame) - min(frame) AS duration
    FROM r GROUP BY scene_id, object_id, curve_pos, run"""
_NODES = """
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, id ORDER BY exported_at DESC NULLS LAST, ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM collections) WHERE rn = 1),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, id ORDER BY exported_at DESC NULLS LAST, ingested_at DESC NULLS LAST, row_id DESC) AS rn FROM scene_objects) WHERE rn = 1),
    ch AS (SELECT scene_id, child, min(id) AS lister FROM (SELECT scene_id, id, unnest(children) AS child FROM o) WHERE child <> '' GROUP BY scene_id, child),
    n AS (SELECT 'collection' AS kind, scene_id, id, nullif(parent, '') AS parent FROM c
          UNION ALL SELECT 'object', o.scene_id, o.id, coalesce(nullif(o.parent, ''), ch.lister) FROM o LEFT JOIN ch ON o.scene_id = ch.scene_id AND o.id = ch.child),
    v AS (SELECT n.kind, n.scene_id, n.id, p.id AS parent FROM n LEFT JOIN n p ON n.kind = p.kind AND n.scene_id = p.scene_id AND n.parent = p.id),
    t AS (SELECT kind, scene_id, id, id AS root, 0 AS depth, id AS path FROM v WHERE parent IS NULL
          UNION ALL SELECT v.kind, v.scene_id, v.id, t.root, t.depth + 1, t.path || ' > ' || v.id FROM v JOIN t ON v.kind = t.kind AND v.scene_id = t.scene_id AND v.parent = t.id)"""
_REFS = """
    r AS (SELECT 'scene_objects.parent' AS ref_table, row_id, 0 AS ref_pos, scene_id, parent AS ref, exported_at AS t FROM scene_objects
          UNION ALL SELECT 'scene_objects.constraints', row_id, i, scene_id, constraints[i + 1].target, exported_at FROM (SELECT *, unnest(range(len(constraints)))::INT AS i FROM scene_objects)
          UNION ALL SELECT 'scene_objects.referenced_assets', row_id, i, scene_id, 'asset:' || nullif(referenced_assets[i + 1], ''), exported_at FROM (SELECT *, unnest(range(len(referenced_assets)))::INT AS i FROM scene_objects)
          UNION ALL SELECT 'edges.target', edge_id, 0, scene_id, target, built_at FROM edges),
    j AS (SELECT ref_table, row_id, ref_pos, t, count(n.id) AS known,
              count(CASE WHEN n.first_seen_at <= t THEN 1 END) AS begun,
              count(CASE WHEN n.first_seen_at <= t AND (n.removed_at IS NULL OR n.removed_at > t) THEN 1 END) AS held
          FROM r LEFT JOIN nodes n ON r.scene_id = n.scene_id AND r.ref = n.id WHERE r.ref <> '' GROUP BY ref_table, row_id, ref_pos, t),
    orphan AS (SELECT ref_table, row_id, ref_pos, CASE WHEN known = 0 THEN 'missing' WHEN begun > 0 THEN 'deleted' ELSE 'late' END AS reason, strftime(t, '%Y-%m') AS period FROM j WHERE held = 0)"""

SQL = {
    "p1_found": f"""
        SELECT row_id, 'mesh' AS child_table, '' AS path FROM scene_objects WHERE mesh IS NOT NULL
        UNION ALL SELECT row_id, 'animation', '' FROM scene_objects WHERE animation IS NOT NULL
        UNION ALL SELECT row_id, 'materials', i::VARCHAR FROM (SELECT row_id, materials AS m, {_EACH.format("materials")} AS i FROM scene_objects WHERE len(materials) > 0) WHERE m[i + 1] IS NOT NULL
        UNION ALL SELECT row_id, 'image_textures', i || '/' || j FROM (
            SELECT row_id, i, x, {_EACH.format("x")} AS j FROM (SELECT row_id, i, m[i + 1].image_textures AS x FROM (SELECT row_id, materials AS m, {_EACH.format("materials")} AS i FROM scene_objects WHERE len(materials) > 0)) WHERE len(x) > 0)
            WHERE x[j + 1] IS NOT NULL
        UNION ALL SELECT row_id, 'curves', i::VARCHAR FROM (SELECT row_id, animation.curves AS m, {_EACH.format("animation.curves")} AS i FROM scene_objects WHERE len(animation.curves) > 0) WHERE m[i + 1] IS NOT NULL
        UNION ALL SELECT row_id, 'keyframes', i || '/' || j FROM (
            SELECT row_id, i, x, {_EACH.format("x")} AS j FROM (SELECT row_id, i, m[i + 1].keyframes AS x FROM (SELECT row_id, animation.curves AS m, {_EACH.format("animation.curves")} AS i FROM scene_objects WHERE len(animation.curves) > 0)) WHERE len(x) > 0)
            WHERE x[j + 1] IS NOT NULL""",
    "p1_mesh": "SELECT row_id, mesh.name AS name, mesh.vertex_count AS vertex_count, mesh.face_count AS face_count, mesh.edge_count AS edge_count, mesh.has_normals AS has_normals FROM scene_objects WHERE mesh IS NOT NULL",
    "p1_materials": f"""SELECT row_id, i::INT AS ordinal, m[i + 1].name AS name, m[i + 1].shader AS shader, m[i + 1].node_tree AS node_tree
        FROM (SELECT row_id, materials AS m, {_EACH.format("materials")} AS i FROM scene_objects WHERE len(materials) > 0) WHERE m[i + 1] IS NOT NULL""",
    "p1_keyframes": f"""SELECT row_id, i::INT AS curve, j::INT AS ordinal, x[j + 1].frame AS frame, x[j + 1].interpolation AS interpolation FROM (
        SELECT row_id, i, x, {_EACH.format("x")} AS j FROM (SELECT row_id, i, m[i + 1].keyframes AS x FROM (SELECT row_id, animation.curves AS m, {_EACH.format("animation.curves")} AS i FROM scene_objects WHERE len(animation.curves) > 0)) WHERE len(x) > 0)
        WHERE x[j + 1] IS NOT NULL""",
    "p2_found": r"""WITH j AS (SELECT file_id, source_key, exported_at, p FROM (SELECT *, regexp_replace(payload, '^[^{]*', '') AS p FROM scene_files) WHERE json_valid(p)),
        ob AS (SELECT file_id, x ->> '$.id' AS oid, x FROM (SELECT file_id, unnest(from_json(p -> '$.objects', '["JSON"]')) AS x FROM j)),
        lv AS (SELECT file_id, oid, r || substr(t.fullkey, 2) AS f, CASE t.type WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'array' END AS ty, t.value::VARCHAR AS v
            FROM (SELECT file_id, oid, 'mesh' AS r, x -> '$.mesh' AS m FROM ob UNION ALL SELECT file_id, oid, 'animation', x -> '$.animation' FROM ob) q, json_tree(q.m) t
            WHERE json_type(q.m) = 'OBJECT' AND t.type NOT IN ('OBJECT', 'NULL') AND NOT contains(t.fullkey, '[')),
        h AS (SELECT file_id, f, string_agg(DISTINCT ty, ',' ORDER BY ty) AS types FROM lv GROUP BY file_id, f),
        pr AS (SELECT file_id, lag(file_id) OVER (PARTITION BY source_key ORDER BY exported_at, file_id) AS prev FROM j),
        pairs AS (SELECT * FROM pr WHERE prev IS NOT NULL),
        gone AS (SELECT p.file_id, p.prev, h.f FROM pairs p JOIN h ON h.file_id = p.prev WHERE NOT EXISTS (SELECT 1 FROM h n WHERE n.file_id = p.file_id AND n.f = h.f)),
        come AS (SELECT p.file_id, p.prev, h.f FROM pairs p JOIN h ON h.file_id = p.file_id WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.file_id = p.prev AND o.f = h.f)),
        mt AS (SELECT g.file_id, g.f AS g, c.f AS c, count(*) FILTER (a.ty = b.ty AND a.v = b.v) AS eq, count(*) AS n
            FROM gone g JOIN come c ON g.file_id = c.file_id AND split_part(g.f, '.', 1) = split_part(c.f, '.', 1)
            JOIN lv a ON a.file_id = g.prev AND a.f = g.f JOIN lv b ON b.file_id = g.file_id AND b.f = c.f AND b.oid = a.oid GROUP BY ALL),
        ok AS (SELECT *, row_number() OVER (PARTITION BY file_id, g ORDER BY eq / n DESC, eq DESC, c) AS rg, row_number() OVER (PARTITION BY file_id, c ORDER BY eq / n DESC, eq DESC, g) AS rc FROM mt WHERE 2 * eq > n),
        rn AS (SELECT * FROM ok WHERE rg = 1 AND rc = 1)
        SELECT p.file_id, b.f AS field_path, 'retyped' AS change FROM pairs p JOIN h a ON a.file_id = p.prev JOIN h b ON b.file_id = p.file_id AND a.f = b.f WHERE a.types <> b.types
        UNION ALL SELECT file_id, g, 'renamed' FROM rn
        UNION ALL SELECT file_id, f, 'removed' FROM gone WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.file_id = gone.file_id AND rn.g = gone.f)
        UNION ALL SELECT file_id, f, 'added' FROM come WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.file_id = come.file_id AND rn.c = come.f)""",
    "p3_runs": _RUNS,
    "p3_found": f"SELECT scene_id, object_id, curve_pos, first_frame, last_frame, n_keys FROM ({_RUNS}) WHERE n_keys >= 3",
    "p4_found": f"""WITH RECURSIVE {_NODES}
        SELECT n.kind, n.scene_id, n.id AS node_id, coalesce(t.root, '') AS root_id, coalesce(t.depth, -1) AS depth FROM n LEFT JOIN t ON n.kind = t.kind AND n.scene_id = t.scene_id AND n.id = t.id""",
    "p4_paths": f"WITH RECURSIVE {_NODES} SELECT kind, scene_id, id AS node_id, path FROM t",
    "p4_descendants": f"""WITH RECURSIVE {_NODES},
        a AS (SELECT v.kind, v.scene_id, v.parent AS anc, v.id, 1 AS d FROM v JOIN t ON v.kind = t.kind AND v.scene_id = t.scene_id AND v.id = t.id WHERE v.parent IS NOT NULL
              UNION ALL SELECT a.kind, a.scene_id, v.parent, a.id, d + 1 FROM a JOIN v ON a.kind = v.kind AND a.scene_id = v.scene_id AND a.anc = v.id WHERE v.parent IS NOT NULL)
        SELECT kind, scene_id, anc AS node_id, count(*) AS n_descendants, count(CASE WHEN d = 1 THEN 1 END) AS n_children, max(d) AS height FROM a GROUP BY kind, scene_id, anc""",
    "p4_cycles": f"""WITH RECURSIVE {_NODES},
        u AS (SELECT v.* FROM v WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.kind = v.kind AND t.scene_id = v.scene_id AND t.id = v.id)),
        w AS (SELECT kind, scene_id, id, parent AS up FROM u UNION SELECT w.kind, w.scene_id, w.id, u.parent FROM w JOIN u ON w.kind = u.kind AND w.scene_id = u.scene_id AND w.up = u.id)
        SELECT kind, scene_id, id AS node_id, bool_or(id = up) AS on_cycle FROM w GROUP BY kind, scene_id, id""",
    "p5_found": f"WITH {_REFS} SELECT ref_table, row_id, ref_pos, reason, period FROM orphan",
    "p5_report": f"WITH {_REFS} SELECT ref_table, period, reason, count(*) AS n_orphans FROM orphan GROUP BY ALL",
}
