"""Every query with SQL against DuckDB over the smallest tables."""

import glob
import json
import os

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as spark_entry
from tesserae.operators import schema_drift

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    return repr(round(value, 6)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(as_in_production, db, name):
    spark = as_in_production
    df = spark_entry.queries()[name](spark, FOLDER)
    found = db.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in found.fetchall())
    wrong = [p for p in zip(ours, theirs) if p[0] != p[1]][:3]
    assert (len(ours), wrong) == (len(theirs), [])


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def files():
    """(row, JSON object) of each readable file, by plain Python."""
    for row in pq.read_table(f"{FOLDER}/scene_files.parquet").to_pylist():
        start = (row["payload"] or "").find("{")
        try:
            yield row, json.JSONDecoder().raw_decode(row["payload"], start)[0] if start >= 0 else None
        except ValueError:
            yield row, None


def test_content_hash(as_in_production):
    """Equal digests for equal contents however they are written, and only for those."""
    found = {r["file_id"]: r["source_hash"] for r in spark_entry.queries()["content_hash"](as_in_production, FOLDER).collect()}
    by_content = {}
    for row, content in files():
        if content is None:
            assert found[row["file_id"]] is None
        else:
            by_content.setdefault(json.dumps(content, sort_keys=True), set()).add(found[row["file_id"]])
    assert all(len(digests) == 1 and None not in digests for digests in by_content.values())
    assert len(set.union(*by_content.values())) == len(by_content) > 10


def test_one_table_of_drifting_files(as_in_production):
    """Every value of p2_unified against the files themselves, under the names and types that the table has."""
    table = spark_entry.queries()["p2_unified"](as_in_production, FOLDER)
    kinds, found = dict(table.dtypes), {(r["file_id"], r["object_pos"], r["record"]): r.asDict() for r in table.collect()}
    log = schema_drift.differences(as_in_production.read.parquet(f"{FOLDER}/scene_files.parquet"), ["mesh", "animation"])
    renames = schema_drift.fold_names(log)
    to_python = {"bigint": int, "double": float, "boolean": lambda v: {"true": True, "false": False}[v], "string": str}
    expected, types = {}, {}
    for row, content in files():
        for pos, item in enumerate(content["objects"] if content else []):
            for record in ("mesh", "animation"):
                if not isinstance(item.get(record), dict):
                    continue
                cells = {"file_id": row["file_id"], "scene_id": row["scene_id"], "source_key": row["source_key"], "object_pos": pos, "object_id": item["id"], "record": record}
                for path, value in sorted(flat(item[record], record), key=lambda x: (x[0] in renames, x[0])):
                    name = renames.get(path, path).replace(".", "__")
                    types.setdefault(name, set()).add(type(value))
                    cells.setdefault(name, value if isinstance(value, str) else json.dumps(value, sort_keys=True))
                expected[row["file_id"], pos, record] = cells
    assert {k for k in kinds if "__" in k} == set(types)
    for name, seen in types.items():
        one = {frozenset({int}): "bigint", frozenset({float}): "double", frozenset({int, float}): "double", frozenset({bool}): "boolean"}
        assert kinds[name] == one.get(frozenset(seen), "string"), name
    assert found.keys() == expected.keys() and len(found) == table.count() > 200
    for key, row in found.items():
        for name, value in row.items():
            want = expected[key].get(name)
            assert value == (to_python[kinds[name]](want) if "__" in name and want is not None else want), (key, name)


def flat(value, path):
    for k, v in value.items():
        if isinstance(v, dict):
            yield from flat(v, f"{path}.{k}")
        elif v is not None:
            yield f"{path}.{k}", v
