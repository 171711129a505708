import random
from itertools import groupby

import pytest

from tesserae.operators import runs

SCHEMA = "e string, p int, frame int, value double, extra string, _rn int"


def brute(data, tolerance, gap):
    out = []
    kept = [r for r in data if r[2] is not None and r[3] is not None]
    for e, group in groupby(sorted(kept, key=lambda r: (r[0] or "", r[2], -1 if r[1] is None else r[1], r[3])), key=lambda r: r[0]):
        run = []
        for r in group:
            if run and not (abs(r[3] - run[-1][3]) <= tolerance and (gap is None or r[2] - run[-1][2] <= gap)):
                out.append((e, run[0][2], run[-1][2], len(run)))
                run = []
            run.append(r)
        out.append((e, run[0][2], run[-1][2], len(run)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, 7, 4096])
@pytest.mark.parametrize("gap", [2, None])
def test_equals_brute_force_whatever_the_blocks(spark, rows, block, gap):
    r = random.Random(block)
    data = [(r.choice(["a", "b", None]), i, r.choice([None, *range(-20, 60)]), r.choice([None, 1.0, 1.0, 1.0004, 2.0]), "x", 1) for i in range(400)]
    data += [("hot", i, i // 2, 5.0 if i % 97 else 6.0, None, None) for i in range(600)]
    found = runs.collapse_runs(spark.createDataFrame(data, SCHEMA), ["e"], "frame", "p", "value", 0.0005, gap, block)
    assert rows(found, "e", "first_order", "last_order", "n_events") == brute(data, 0.0005, gap)


def test_one_frame_apart_in_value_ends_a_run(spark, rows):
    data = [("a", i, f, v, "", 0) for i, (f, v) in enumerate([(1, 0.0), (2, 0.0004), (3, 0.0008), (20, 0.0008), (21, 9.0)])]
    found = runs.collapse_runs(spark.createDataFrame(data, SCHEMA), ["e"], "frame", "p", "value", 0.0005, 12)
    assert rows(found, "first_order", "last_order", "n_events", "duration") == [(1, 3, 3, 2), (20, 20, 1, 0), (21, 21, 1, 0)]


@pytest.mark.parametrize("block", [2, 4096])
def test_drift_and_return_to_the_same_value(spark, rows, block):
    values = [0.0, 0.0004, 0.0008, 0.0, -0.0, 5.0, 0.0, 0.0004, 5.0, 5.0, 0.0, 0.0, 0.0008, 0.0004, 0.0]
    data = [("a", 0, i, v, "", 0) for i, v in enumerate(values)] + [("a", 0, 40 + i, 0.0, "", 0) for i in range(3)] + [("a", 0, 80 + i, 0.0, "", 0) for i in range(2)]
    found = runs.collapse_runs(spark.createDataFrame(data, SCHEMA), ["e"], "frame", "p", "value", 0.0005, 12, block)
    expected = [r[1:] for r in brute(data, 0.0005, 12)]
    assert rows(found, "first_order", "last_order", "n_events") == sorted(expected, key=repr)
    assert len(expected) == 9


def test_latest_takes_the_last_delivery_even_if_null(spark, rows):
    df = spark.createDataFrame([("a", 1, 5, 1.0, "old", 1), ("a", 1, None, None, "new", 2), ("b", 1, 7, 2.0, None, None)], SCHEMA)
    assert rows(runs.latest(df, ["e", "p"], ["_rn"], ["frame", "value"])) == [("a", 1, None, None), ("b", 1, 7, 2.0)]


def test_empty_table(spark):
    assert runs.collapse_runs(spark.createDataFrame([], SCHEMA), ["e"], "frame", "p", "value").count() == 0
