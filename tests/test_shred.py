from tesserae.operators import shred as S
from tesserae.queries.general import p1_found

SCHEMA = "id long, pos string, v_x string, mesh struct<name:string,n:int>, mats array<struct<name:string,tex:array<string>>>, anim struct<on:boolean,curves:array<struct<path:string,keys:array<struct<f:int,v:double>>>>>"
ROWS = [
    (1, "clash", "clash", ("m", 3), [("a", ["t0", None, "t2"]), None, ("b", None)], (True, [("p", [(1, 0.5), None, (None, None)]), None])),
    (2, None, None, None, None, None),
    (3, None, None, (None, None), [], (None, [])),
    (None, None, None, ("k", None), [], None),
]


def test_records_places_and_values(spark, rows):
    t = S.shred(spark.createDataFrame(ROWS, SCHEMA), "id", ["mesh", "mats", "anim"])
    assert list(t) == ["mesh", "mats", "mats/tex", "anim", "anim/curves", "anim/curves/keys"]
    assert rows(t["mesh"], "key", "pos", "v_name", "v_n") == sorted([(1, "", "m", 3), (3, "", None, None), (None, "", "k", None)], key=repr)
    assert rows(t["mats"], "key", "pos", "ordinal", "v_name") == [(1, "0", 0, "a"), (1, "2", 2, "b")]
    assert rows(t["mats/tex"], "key", "pos", "parent_entity", "parent_pos", "scalar") == [(1, "0/0", "mats", "0", "t0"), (1, "0/2", "mats", "0", "t2")]
    assert rows(t["anim"], "key", "v_on") == [(1, True), (3, None)]
    assert rows(t["anim/curves"], "key", "pos", "v_path") == [(1, "0", "p")]
    assert rows(t["anim/curves/keys"], "key", "pos", "parent_pos", "v_f", "v_v") == [(1, "0/0", "0", 1, 0.5), (1, "0/2", "0", None, None)]


def test_one_type_alone_equals_that_of_all(spark, rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    alone = S.shred(df, "id", ["anim"], ["anim/curves/keys"])["anim/curves/keys"]
    assert rows(alone) == rows(S.shred(df, "id", ["anim"])["anim/curves/keys"])


def test_repeated_rows_are_one_record(spark, rows):
    df = spark.createDataFrame([ROWS[0], ROWS[0]], SCHEMA)
    assert rows(S.shred(df, "id", ["mats"])["mats"], "key", "pos") == [(1, "0"), (1, "2")]


def test_query_joins_and_pivots_all_record_types(spark, tmp_path, monkeypatch, rows):
    """p1_found: its rows are those of whole flat tables, values and all."""
    nest = "mesh struct<name:string,n:int>, materials array<struct<name:string,image_textures:array<string>>>, animation struct<on:boolean,curves:array<struct<path:string,keyframes:array<struct<frame:int,value:double>>>>>"
    data = [(1, ("m", 3), [("a", ["t0", None, "t2"]), None], (True, [None, ("p", [(1, 0.5), (None, None)])])), (2, None, [], (None, None)), (3, (None, None), None, None)]
    spark.createDataFrame(data, f"row_id long, {nest}").write.parquet(f"{tmp_path}/scene_objects.parquet")
    made, join = {}, S.entity_table
    monkeypatch.setattr(S, "entity_table", lambda nodes, entity, labels: made.setdefault(entity, join(nodes, entity, labels)))
    found = rows(p1_found(spark, str(tmp_path)))
    expected = [(1, "mesh", ""), (3, "mesh", ""), (1, "materials", "0"), (1, "image_textures", "0/0"), (1, "image_textures", "0/2"), (1, "animation", ""), (2, "animation", ""), (1, "curves", "1"), (1, "keyframes", "1/0"), (1, "keyframes", "1/1")]
    assert found == sorted(expected, key=repr)
    values = {e: [c for c in t.columns if c.startswith("v_")] for e, t in made.items()}
    assert values == {"mesh": ["v_name", "v_n"], "materials": ["v_name"], "materials/image_textures": [], "animation": ["v_on"], "animation/curves": ["v_path"], "animation/curves/keyframes": ["v_frame", "v_value"]}


def test_stored_tables_hold_the_values(spark, rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plain, stored = S.shred(df, "id", ["mesh", "mats", "anim"]), S.stored(df, "id", ["mesh", "mats", "anim"])
    assert {e: rows(t) for e, t in stored.items()} == {e: rows(t) for e, t in plain.items()}
    assert all(t.columns == plain[e].columns for e, t in stored.items())


def test_empty_table(spark):
    t = S.shred(spark.createDataFrame([], SCHEMA), "id", ["mesh", "mats"])
    assert all(df.count() == 0 for df in t.values())


def test_adjacency_links_parents(spark):
    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    nodes = S.adjacency(df, "id", ["anim"]).collect()
    objects = {(n["entity"], n["pos"]) for n in nodes if n["kind"] == "object"}
    for n in nodes:
        assert n["parent_entity"] == "" or (n["parent_entity"], n["parent_pos"]) in objects
