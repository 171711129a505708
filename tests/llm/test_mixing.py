import random

import pytest

from tesserae.llm import mixing as M
from tesserae.llm import tokens as T

TARGETS = "source string, target_share double, max_repeats int, extra string"
DOCS = "doc_id long, source string, n_tokens long, repeats int, part int"


def test_water_fill_meets_targets_when_it_can():
    got = {a.source: a.tokens for a in M.water_fill({"a": 100, "b": 100}, {"a": (0.7, 2), "b": (0.3, 1)}, 200)}
    assert got == pytest.approx({"a": 140, "b": 60})


def test_water_fill_clamps_and_spreads():
    got = {a.source: a for a in M.water_fill({"a": 1000, "b": 10, "c": 500}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 1), "none": (0.1, 3)}, 700)}
    assert got["b"].tokens == 20 and got["b"].clamped and got["none"].tokens == 0
    assert got["a"].tokens / got["c"].tokens == pytest.approx(2.5) and sum(a.tokens for a in got.values()) == pytest.approx(700)


def test_water_fill_is_least_unfair():
    r = random.Random(2)
    for _ in range(200):
        names = "abcdef"
        available = {s: r.randrange(0, 1000) for s in names}
        targets = {s: (r.random(), r.randrange(0, 4)) for s in names}
        total = r.randrange(1, 3000)
        got = {a.source: a.tokens for a in M.water_fill(available, targets, total)}
        cap = {s: available[s] * targets[s][1] for s in names}
        assert all(-1e-6 <= got[s] <= cap[s] + 1e-6 for s in names)
        assert sum(got.values()) == pytest.approx(min(total, sum(cap[s] for s in names if targets[s][0] > 0)))
        level = {round(got[s] / targets[s][0], 6) for s in names if got[s] < cap[s] - 1e-6 and targets[s][0] > 0}
        assert len(level) <= 1  # all that are not full have the same part of their weight


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "a", "a", " A\t", "b", "B ", "rare", None, "other"]), r.randrange(0, 400), 0, 0) for i in range(4000)]
    return spark.createDataFrame(rows, DOCS), rows


def test_shares_and_caps(spark, corpus):
    docs, _ = corpus
    targets = spark.createDataFrame([("a", 0.5, 1, ""), ("B", 0.3, 2, ""), ("rare", 0.15, 1, ""), ("gone", 0.05, 4, ""), (None, 0.5, 9, ""), ("a", None, None, "")], TARGETS)
    m = M.mix(docs, targets, 300_000)
    shares = {r["source"]: r for r in m.shares.collect()}
    assert set(shares) == {"a", "b", "rare", "gone"} and shares["gone"]["drawn_tokens"] == 0
    total = sum(s["drawn_tokens"] for s in shares.values())
    assert abs(total - 300_000) < 1000
    for s, share in (("a", 0.5), ("b", 0.3), ("rare", 0.15)):
        assert shares[s]["actual_share"] == pytest.approx(share / 0.95, abs=0.002) and shares[s]["most_repeats"] <= shares[s]["max_repeats"]
    drawn = m.drawn.collect()
    assert len({r["doc_id"] for r in drawn}) == len(drawn) and min(r["repeats"] for r in drawn) >= 1
    assert sum(r["n_tokens"] * r["repeats"] for r in drawn) == total
    assert sorted(map(tuple, M.mix(docs, targets, 300_000).drawn.collect())) == sorted(map(tuple, drawn))
    assert sorted(map(tuple, M.mix(docs, targets, 300_000, seed=1).drawn.collect())) != sorted(map(tuple, drawn))


def test_odd_tables(spark, corpus):
    docs, rows = corpus
    everything = spark.createDataFrame([("a", 1.0, 3, "")], TARGETS)
    m = M.mix(docs, everything)
    assert {r["repeats"] for r in m.drawn.collect()} == {1}
    assert m.drawn.count() == sum(1 for r in rows if (r[1] or "").strip().lower() == "a" and r[2] > 0)
    assert M.mix(docs, everything.limit(0)).drawn.count() == 0 and M.mix(docs, everything.limit(0)).shares.count() == 0
    assert M.mix(docs.limit(0), everything).drawn.count() == 0
    assert M.mix(docs, spark.createDataFrame([("a", -1.0, 3, ""), ("b", 0.5, -2, ""), ("rare", None, None, "")], TARGETS)).drawn.count() == 0


def test_token_counts(spark):
    texts = ["Hello  world\n\n next", None, "", "   ", "naïve <|endoftext|> ", "x" * 300_000]
    found = T.token_counts(spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n int"), keep=("doc_id", "n")).collect()
    plain = T.encoding(open(T.TOKENIZER_PATH, "rb").read())
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i or None: len(plain.encode_ordinary(t or "")) for i, t in enumerate(texts)}
