import json
from datetime import datetime, timedelta

from tesserae.operators import schema_drift as S

SCHEMA = "file_id long, source_key string, exported_at timestamp_ntz, payload string, series string, fields string"
START = datetime(2024, 1, 1)


def doc(*objects):
    return json.dumps({"objects": [{"id": i, **o} for i, o in objects]})


def files(*payloads, key="k"):
    return [(n + 1, key, START + timedelta(hours=7 * n), p, "s", "f") for n, p in enumerate(payloads)]


def test_changes_of_every_kind(spark, rows):
    data = files(
        "﻿  " + doc(("a", {"mesh": {"faces": 1, "name": "x"}}), ("b", {"mesh": {"faces": 2, "old": None}})) + "\n#",
        doc(("a", {"mesh": {"stats": {"n": 1}, "name": "x"}, "animation": {"on": True}}), ("b", {"mesh": {"stats": {"n": 2}}})),
        '{"objects": [{"id": "a", "mesh": {"na',
        None,
        "",
        "[1]",
        doc(("a", {"mesh": {"stats": {"n": 1.5}, "curves": [1, {"x": 2}]}, "animation": {"on": "yes"}}), ("b", {"mesh": None, "animation": 3})),
    )
    found = S.differences(spark.createDataFrame(data, SCHEMA), ["mesh", "animation"])
    assert rows(found, "file_id", "field_path", "change") == [
        (2, "animation.on", "added"),
        (2, "mesh.faces", "renamed"),
        (7, "animation.on", "retyped"),
        (7, "mesh.curves", "added"),
        (7, "mesh.name", "removed"),
        (7, "mesh.stats.n", "retyped"),
    ]
    assert {r["prev_file_id"] for r in found.where("file_id = 7").collect()} == {2}


def test_rename_needs_more_than_half_of_equal_values_of_one_type():
    def changed(old, new):
        types = lambda h: {f.replace("__", "."): t for f, (t, _) in h.items()}
        values = lambda h: lambda f: h[f.replace(".", "__")][1]
        return [c[:2] for c in S.compare(types(old), types(new), values(old), values(new))]

    old = {"mesh__a": ("integer", {1: "i10", 2: "i20"}), "mesh__b": ("integer", {1: "i30"})}
    half = {"mesh__c": ("integer", {1: "i10", 2: "i99", 3: "i5"})}
    assert changed(old, half) == [("mesh.a", "removed"), ("mesh.b", "removed"), ("mesh.c", "added")]
    more = {"mesh__c": ("integer", {1: "i10", 2: "i20"}), "animation__b": ("integer", {1: "i30"})}
    assert changed(old, more) == [("animation.b", "added"), ("mesh.a", "renamed"), ("mesh.b", "removed")]
    assert changed({}, {}) == []


def test_lattice():
    assert S.promote("integer", "double") == "double"
    assert S.promote("null", "array") == S.promote("array", "null") == "array"
    assert S.promote("boolean", "integer") == "string"
    assert S.promote("long", "double") == S.promote("decimal", "double") == "string"
    for a in S.SPARK_TYPE:
        for b in S.SPARK_TYPE:
            assert S.promote(a, b) == S.promote(b, a)


def test_one_table_with_folded_names_and_types(spark, rows):
    data = files(
        doc(("a", {"mesh": {"faces": 1}}), ("b", {"mesh": {"faces": 2}})),
        doc(("a", {"mesh": {"n_faces": 1}}), ("b", {"mesh": {"n_faces": 2}})),
        doc(("a", {"mesh": {"n_faces": 1.5}}), (None, {"mesh": {}}), ("c", {"mesh": {"n_faces": 7, "faces": 8}})),
        "broken",
    )
    df = spark.createDataFrame(data, SCHEMA)
    names = S.fold_names(S.differences(df, ["mesh"]))
    assert names == {"mesh.n_faces": "mesh.faces"}
    table = S.unified(df, ["mesh"], renames=names, keep=["source_key"])
    assert dict(table.dtypes)["mesh__faces"] == "double"
    assert rows(table, "file_id", "object_id", "mesh__faces") == sorted([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", 2.0), (3, "a", 1.5), (3, None, None), (3, "c", 8.0)], key=repr)


def test_great_integers_and_long_values_stay_whole(spark, rows):
    long_text = "x" * 200
    data = files(
        doc(("a", {"mesh": {"n": 5, "big": 2**62, "huge": 2**70, "endless": 10**40, "mixed": 2**60, "t": long_text, "l": [1, {"b": 2, "a": None}]}})),
        doc(("a\x1f\x1b", {"mesh": {"od\x1ed\x1d": "\x1f\x1bb", "e": "", "c\x1b": 1}}), (7, {"mesh": {"e": "x"}})),
        doc(("a", {"mesh": {"n": 6, "big": 1, "huge": 3, "endless": 1, "mixed": 0.5, "u": long_text}})),
    )
    df = spark.createDataFrame(data, SCHEMA)
    table = S.unified(df, ["mesh"])
    kinds = dict(table.dtypes)
    assert [kinds[f"mesh__{c}"] for c in ("n", "big", "huge", "endless", "mixed")] == ["bigint", "bigint", "decimal(38,0)", "string", "string"]
    first, odd, odder, last = table.orderBy("file_id", "object_pos").collect()
    assert (odd["object_id"], odd["mesh__od\x1ed\x1d"], odd["mesh__e"], odd["mesh__c\x1b"]) == ("a\x1f\x1b", "\x1f\x1bb", "", 1)
    assert (odder["object_id"], odder["mesh__e"], odder["mesh__od\x1ed\x1d"]) == ("7", "x", None)
    assert ("mesh.od\x1ed\x1d", "added") in rows(S.differences(df, ["mesh"]), "field_path", "change")
    found = [first, last]
    assert [(r["mesh__n"], r["mesh__big"], int(r["mesh__huge"]), r["mesh__endless"], r["mesh__mixed"]) for r in found] == [(5, 2**62, 2**70, str(10**40), str(2**60)), (6, 1, 3, "1", "0.5")]
    assert (found[0]["mesh__t"], found[1]["mesh__u"], found[0]["mesh__l"]) == (long_text, long_text, '[1, {"a": null, "b": 2}]')
    assert ("mesh.t", "renamed") in rows(S.differences(df.where("file_id <> 2"), ["mesh"]), "field_path", "change")


def test_series_apart_ties_nulls_and_empty(spark, rows):
    one, two = doc(("a", {"mesh": {"x": 1}})), doc(("a", {"mesh": {"x": "1"}}))
    data = [(2, "k", None, two, "", ""), (1, "k", None, one, "", ""), (3, None, START, one, "", ""), (4, None, START, two, "", ""), (5, "other", START, two, "", ""), (6, "k", START, one, "", ""), (6, "k", START, one, "", "")]
    found = S.differences(spark.createDataFrame(data, SCHEMA), ["mesh"])
    assert rows(found, "file_id", "prev_file_id", "change") == [(2, 1, "retyped"), (4, 3, "retyped"), (6, 2, "retyped")]
    assert S.differences(spark.createDataFrame([], SCHEMA), ["mesh"]).count() == 0
    assert S.unified(spark.createDataFrame([], SCHEMA), ["mesh"]).count() == 0
