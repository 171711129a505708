"""The registered queries p6 to p8 on the smallest tables."""

import os

import pyarrow.parquet as pq
import pytest

from tesserae.llm import leakage, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def run(as_in_production):
    return lambda name: queries.QUERIES[name](as_in_production, FOLDER)


def grams(text):
    words = [w for w in map(leakage.normal, leakage.tokens(text or "")) if w]
    return {tuple(words[i : i + 25]) for i in range(len(words) - 24)}


def test_leaks(run):
    """Whatever holds 25 words of an item unaltered is found, by plain sets; and the report counts what is found."""
    found = run("p6_found")
    assert found.columns == ["doc_id", "item_id"]
    pairs = {tuple(r) for r in found.collect()}
    items = {r["item_id"]: grams(r["text"]) for r in table("eval_items")}
    whole = {(d["doc_id"], i) for d in table("documents") for g in [grams(d["text"])] if g for i, theirs in items.items() if not g.isdisjoint(theirs)}
    assert whole and whole <= pairs and len(pairs) == found.count()
    report = {r["item_id"]: (r["n_documents"], r["most_words"]) for r in run("p6_report").collect()}
    assert {i: n for i, (n, _) in report.items()} == {i: sum(p[1] == i for p in pairs) for i in {p[1] for p in pairs}}
    assert all(most >= 25 for _, most in report.values())


def test_leaks_point_to_the_text(as_in_production):
    docs = {r["doc_id"]: r["text"] for r in table("documents")}
    items = {r["item_id"]: r["text"] for r in table("eval_items")}
    read = as_in_production.read.parquet
    for r in leakage.leaked(read(f"{FOLDER}/documents.parquet"), read(f"{FOLDER}/eval_items.parquet")).collect():
        passage = [w for w in map(leakage.normal, leakage.tokens(docs[r["doc_id"]][r["start"] : r["end"]])) if w]
        item = {w for w in map(leakage.normal, leakage.tokens(items[r["item_id"]])) if w}
        assert passage[0] in item and passage[-1] in item and 8 * sum(w in item for w in passage) >= 6 * len(passage)


def test_mixture(run):
    drawn, shares = run("p7_drawn").collect(), {r["source"]: r for r in run("p7_shares").collect()}
    tokens = {}
    for r in drawn:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"] * r["repeats"]
    targets = {r["source"].strip().lower(): r for r in table("mix_targets")}
    assert shares.keys() == targets.keys() and abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    for source, r in shares.items():
        assert r["drawn_tokens"] == tokens.get(source, 0) and r["most_repeats"] <= targets[source]["max_repeats"]
        assert abs(r["actual_share"] - tokens.get(source, 0) / sum(tokens.values())) < 1e-9
    free = [r for r in shares.values() if not r["clamped"] and r["available_tokens"]]
    scale = [r["actual_share"] / r["target_share"] for r in free]
    assert max(scale) < 1.1 * min(scale)


def test_reading_levels(run):
    levels = {r["doc_id"]: r["level"] for r in run("p8_found").collect()}
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    assert set(levels.values()) <= {1, 2, 3, 4} and len(set(levels.values())) == 4
    assert all(texts[d] and leakage._NUMBER.search(texts[d]) for d in levels)
    labelled = [(levels[r["doc_id"]], r["level"]) for r in table("level_labels") if r["doc_id"] in levels and r["level"]]
    assert sum(a == b for a, b in labelled) > 0.75 * len(labelled)
    assert sum(r["n_documents"] for r in run("p8_profile").collect()) == len(levels)
    checked = run("p8_validation").collect()
    assert len(checked) > 1 and all(0 <= r["exact"] <= 1 and r["n_labelled"] > 0 for r in checked)
