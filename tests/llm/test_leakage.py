import random
import time

import pytest

from tesserae.llm import leakage as L

WORDS = [a + b for a in ("ba", "ko", "lim", "tur", "ves", "dra") for b in ("den", "for", "mil", "pas", "rot", "sun", "tig")]


def text(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def brute(item, doc, min_words=25, per_error=8, per_mask=4):
    """The most item words of a passage, by plain dynamic programming over all pairs of words; 0 if there is none."""
    most = len(item) // per_error
    best, longest = {}, 0
    for i, x in enumerate(item):
        for j, y in enumerate(doc):
            if x != y:
                continue
            here = {0: 1}
            for lost in range(min(i, most + 1)):
                for put in range(min(j, per_mask * most + 1)):
                    cost = max(lost, -(-put // per_mask))
                    for e, n in best.get((i - lost - 1, j - put - 1), {}).items():
                        if e + cost <= most:
                            here[e + cost] = max(here.get(e + cost, 0), n + lost + 1)
            best[i, j] = here
            longest = max([longest, *(n for e, n in here.items() if n >= min_words and n >= per_error * e)])
    return longest


def altered(r, words, share):
    """Words lost, replaced or put in, singly or several in a row, spread or close together, up to about ``share`` of them."""
    out, budget = list(words), max(1, round(share * len(words)))
    while budget > 0:
        n, at = r.randint(1, budget), r.randrange(1, max(2, len(out) - 1))
        kind = r.choice("lrim")
        if kind == "l":
            del out[at : at + n]
        elif kind == "r":
            out[at : at + n] = ["other"] * n
        elif kind == "m":
            out[at : at + n] = ["name", "withheld"]
        else:
            out[at:at] = ["foreign"] * r.randint(1, 4 * n)
        budget -= n
    return out


@pytest.fixture(scope="module")
def held():
    r = random.Random(3)
    return [(i, text(r, r.randint(30, 90))) for i in range(20)]


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force_on_altered_passages(held, seed):
    r = random.Random(seed)
    scanner = L.Scanner([(i, " ".join(w)) for i, w in held])
    found_ones = 0
    for _ in range(100):
        item, words = r.choice(held)
        n = r.randint(20, len(words))
        start = r.randrange(len(words) - n + 1)
        passage = altered(r, words[start : start + n], r.choice([0.05, 0.12, 0.13, 0.2]))
        doc = [w + "x" for w in text(r, 12)] + passage + [w + "x" for w in text(r, 12)]
        found = {i: k for i, k, *_ in scanner.find(" ".join(doc))}
        expected = brute(words, doc)
        assert (item in found) == (expected > 0)
        assert found.get(item, 0) == expected
        found_ones += expected > 0
    assert 20 < found_ones < 95


@pytest.mark.parametrize("n", [25, 40, 48, 56, 64, 72, 80, 90])
@pytest.mark.parametrize("kind", ["lost", "replaced", "put in"])
def test_errors_in_a_row_at_any_place_up_to_an_eighth(n, kind):
    item = [f"word{i}" for i in range(n)]
    scanner = L.Scanner([(1, " ".join(item))])
    errors = n // 8
    for at in range(1, n - errors):
        doc = list(item)
        if kind == "lost":
            del doc[at : at + errors]
        elif kind == "replaced":
            doc[at : at + errors] = ["other"] * errors
        else:
            doc[at:at] = ["foreign"] * (4 * errors)
        assert [f[:2] for f in scanner.find("before it " + " ".join(doc) + " behind it")] == [(1, n)], at


def test_errors_spread_evenly_and_one_too_many():
    for n in range(25, 90):
        item = [f"word{i}" for i in range(n)]
        errors = n // 8
        scanner = L.Scanner([(1, " ".join(item))])
        places = [round((i + 1) * (n - 1) / (errors + 1)) for i in range(errors)]
        doc = ["other" if i in places else w for i, w in enumerate(item)]
        assert [f[:2] for f in scanner.find(" ".join(doc))] == [(1, n)]
    item = [f"word{i}" for i in range(25)]
    doc = ["other" if i in (3, 8, 13, 18) else w for i, w in enumerate(item)]
    assert L.Scanner([(1, " ".join(item))]).find(" ".join(doc)) == []
    assert L.Scanner([(1, " ".join(item))]).find(" ".join(item[:24])) == []


def test_other_measures_have_their_own_seed():
    assert L.seed_length(25, 8) == 6
    r = random.Random(5)
    item = text(r, 40)
    scanner = L.Scanner([(1, " ".join(item))], min_words=10, per_error=5, per_mask=2)
    for _ in range(60):
        n = r.randint(8, 30)
        start = r.randrange(len(item) - n)
        doc = text(r, 5) + altered(r, item[start : start + n], 0.2) + text(r, 5)
        assert max([f[1] for f in scanner.find(" ".join(doc))], default=0) == brute(item, doc, 10, 5, 2)


def test_time_in_proportion_to_the_text():
    scanner = L.Scanner([(1, " ".join(f"word{i}" for i in range(40)))])
    for line in ("a sentence of words that names a v b and c ", "word1 word2 word3 word4 word5 word6 ", "x v "):
        began = time.thread_time()
        assert scanner.find(line * (1_000_000 // len(line))) == []
        assert time.thread_time() - began < 10


def test_layout_does_not_count(held):
    item, words = held[1]
    w = [x.upper() + "," for x in words[:30]]
    w[7] = w[7][:3] + "-\n" + w[7][3:]
    body = " ".join(w[:10]) + "\n\n\x0cSMITH V JONES LTD   2/3\n[12] " + " ".join(w[10:20]) + "\nPage 3 of 9    [2003] ABC 1    Smith v Jones\n§ 4  " + "  \n ".join(w[20:])
    scanner = L.Scanner([(item, " ".join(words))])
    ((_, n, first, last),) = scanner.find("Held: nothing.\n" + body)
    assert n == 30
    start, end = L.span("Held: nothing.\n" + body, first, last)
    assert ("Held: nothing.\n" + body)[start:end] == body


def test_lost_and_masked_words(held):
    item, words = held[2]
    w = list(words[:30])
    w[5:7] = ["[name withheld]"]
    del w[20]
    assert [f[0] for f in L.Scanner([(item, " ".join(words))]).find(" ".join(w))] == [item]


def test_odd_inputs():
    scanner = L.Scanner([(1, None), (2, ""), (3, "few words only")])
    assert scanner.find("anything at all") == [] and scanner.automaton is None
    scanner = L.Scanner([(1, " ".join(WORDS[:30])), (1, " ".join(WORDS[12:]))])
    assert scanner.find(None) == [] and scanner.find("") == [] and scanner.find(" \n") == []
    assert {f[0] for f in scanner.find("padding " * 200_000 + " ".join(WORDS))} == {1}
    alike = L.Scanner([(1, "same " * 60), (2, "this that " * 30)])
    assert {(f[0], f[1]) for f in alike.find("same " * 3000 + "this that " * 40)} == {(1, 60), (2, 60)}
    assert alike.find("same " * 21 + "gap " * 99 + "that this " * 10) == []


def test_operator(spark, rows):
    item = " ".join(WORDS[:40])
    docs = spark.createDataFrame([(1, item, 0, "x"), (None, "Page 1 of 2 x\n" + item, 0, "x"), (2, None, 1, ""), (3, "", 1, ""), (1, "no " + " ".join(WORDS[:26]), 1, "")], "doc_id long, text string, n_words int, item_id string")
    items = spark.createDataFrame([(7, item, "s"), (8, None, "s")], "item_id int, text string, doc_id string")
    assert rows(L.leaked(docs, items)) == sorted([(1, 7, 40, 0, len(item)), (None, 7, 40, 14, 14 + len(item))], key=repr)
    assert L.leaked(docs.limit(0), items).count() == 0 and L.leaked(docs, items.limit(0)).count() == 0


def test_items_in_parts_give_the_same(spark, rows, monkeypatch):
    r = random.Random(8)
    items = [(i, " ".join(text(r, 40))) for i in range(30)] + [(None, " ".join(text(r, 30))), (3, " ".join(text(r, 30)))]
    docs = spark.createDataFrame([(i, "so " + t) for i, (_, t) in enumerate(items)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = rows(L.leaked(docs, table))
    assert len(whole) == len(items)
    monkeypatch.setattr(L, "PART_BYTES", 2000)
    monkeypatch.setattr(L, "MAX_PART_BYTES", 8000)
    assert len(L._in_parts(table, "item_id", "text")) > 4
    assert rows(L.leaked(docs, table)) == whole
    monkeypatch.setattr(L, "MAX_PART_BYTES", 200)
    with pytest.raises(ValueError, match="an item of more than"):
        L.leaked(docs, table)
