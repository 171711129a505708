import random
from datetime import datetime, timedelta

import pytest

from tesserae.functions import bloom
from tesserae.operators import references as R
from pyspark.sql import functions as F

DAY = datetime(2024, 1, 1)
REFS = "row long, scene_id string, ref string, at timestamp_ntz, _row string, Reason string, _maybe int"
NODES = "scene_id string, id string, first_seen_at timestamp_ntz, removed_at timestamp_ntz, at int"


def at(days):
    return None if days is None else DAY + timedelta(hours=days * 8)


def brute(refs, nodes):
    out = []
    for row, scene, ref, t, *_ in refs:
        if not ref:
            continue
        spans = [n for n in nodes if n[0] is not None and n[0] == scene and n[1] == ref]
        begun = [n for n in spans if n[2] is not None and t is not None and n[2] <= t]
        if any(n[3] is None or n[3] > t for n in begun):
            continue
        out.append((row, "missing" if not spans else "deleted" if begun else "late"))
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [30, 100_000])
def test_equals_brute_force(spark, rows, hot_rows):
    r = random.Random(8)
    nodes = []
    for _ in range(150):
        first = r.choice([None, *range(40)])
        nodes.append((r.choice(["a", "b", None]), f"n{r.randrange(25)}", at(first), at(r.choice([None, (first or 0) + r.randrange(9)])), 1))
    nodes += nodes[:20] + [("a", None, at(1), None, 1)]
    refs = [(i, r.choice(["a", "b", None]), r.choice([None, "", *(f"n{k}" for k in range(30))]), at(r.choice([None, *range(60)])), "x", "y", 1) for i in range(600)]
    refs += [(1000 + i, "a", "n3", at(i % 50), "x", "y", 1) for i in range(300)]  # a hot key
    found = R.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(nodes, NODES), hot_rows=hot_rows)
    assert found.columns == ["row", "scene_id", "ref", "at", "_row", "_maybe", "reason"]
    assert rows(found, "row", "reason") == sorted(brute(refs, nodes), key=repr)


def test_the_end_of_a_span_is_outside_and_its_beginning_inside(spark, rows):
    nodes = spark.createDataFrame([("a", "n", at(3), at(6), 1), ("a", "m", at(3), at(6), 1), ("a", "m", at(6), at(9), 1)], NODES)
    refs = [(i, "a", ref, at(i % 10), "", "", 1) for ref in "nm" for i in (range(10) if ref == "n" else range(10, 20))]
    found = dict(rows(R.orphans(spark.createDataFrame(refs, REFS), nodes), "row", "reason"))
    assert found == {0: "late", 1: "late", 2: "late", 6: "deleted", 7: "deleted", 8: "deleted", 9: "deleted", 10: "late", 11: "late", 12: "late", 19: "deleted"}


def test_empty_tables(spark, rows):
    refs = spark.createDataFrame([(1, "a", "n1", at(1), None, None, None)] * 2, REFS)
    none = spark.createDataFrame([], NODES)
    assert rows(R.orphans(refs, none), "row", "reason") == [(1, "missing")] * 2
    assert R.orphans(refs.limit(0), none).count() == 0


@pytest.mark.parametrize(("max_bits", "filters", "passing"), [(1 << 26, 1, 0.01), (1 << 14, 4, 0.01), (1 << 12, 8, 0.09), (1 << 11, 8, 0.35)])
def test_bloom_filter_has_no_false_negatives(spark, monkeypatch, max_bits, filters, passing):
    """12 bits a key in one filter and in several, then fewer bits a key."""
    monkeypatch.setattr(bloom, "MAX_BITS", max_bits)
    found = bloom.bloom_of(spark.range(5000), F.xxhash64("id"), 5000)
    assert len(found) == filters
    assert spark.range(5000).where(bloom.might_contain(found, F.xxhash64("id"))).count() == 5000
    assert spark.range(10_000, 60_000).where(bloom.might_contain(found, F.xxhash64("id"))).count() < passing * 50_000


def test_too_many_keys_go_without_a_filter(spark, rows, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BITS", 1)
    assert bloom.bloom_of(spark.range(5), F.xxhash64("id"), 5) is None
    refs = spark.createDataFrame([(1, "a", "n", at(4), "", "", 1), (2, "a", "o", at(4), "", "", 1)], REFS)
    assert rows(R.orphans(refs, spark.createDataFrame([("a", "n", at(1), None, 1)] * 9, NODES)), "row", "reason") == [(2, "missing")]
