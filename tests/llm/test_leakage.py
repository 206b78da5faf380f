import random
import unicodedata

import numpy as np
import pytest

from lodestrand.llm import leakage as L


def longest(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        prev = [0, *[prev[j] + 1 if x == y else 0 for j, y in enumerate(b)]]
        best = max(best, *prev)
    return best


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_by_definition():
    rnd = random.Random(0)
    for _ in range(120):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(1, 14))] for _ in "xy")
        score, span, run = L.align(a, b)
        assert (score, run) == (smith_waterman(a, b), longest(a, b)) and run <= span <= len(a) or score == 0
    assert L.align(list("abcde"), list("xxabxcdexx"))[:2] == (9, 5)


def test_scores_of_many_pairs():
    rnd = random.Random(1)
    pairs = [[np.array([rnd.randint(0, 3) for _ in range(rnd.randint(1, n))], np.int32) for n in (12, 25)] for _ in range(90)]
    got = L.scores(*map(list, zip(*pairs, strict=True)), at_once=16)
    assert got.tolist() == [smith_waterman(a.tolist(), b.tolist()) for a, b in pairs] and L.scores([], []).tolist() == []


def test_words():
    text = "Wax cyl­inders​ reached L’ÉCOLE, Straße ﬁve_x"
    assert L.normal_words(text) == L.normal_words(unicodedata.normalize("NFD", text).upper()) == "wax cylinders reached l école strasse five x".split()
    assert L.normal_words("plain\x00text\nA") == ["plaintext", "a"]


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(12, 40)))) for i in range(12)] + [(50, "too short to find"), (51, None)]
    docs = []
    for d in range(150):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 2)):
            own = rnd.choice(items[:12])[1].split()
            n = rnd.choice([8, 11, 12, 13, 25])
            k = rnd.randint(0, max(0, len(own) - n))
            at = rnd.randint(0, len(words))
            words[at:at] = [w.upper() + rnd.choice(["", ",", "\n>"]) for w in own[k : k + n]]
        docs.append((d, " ".join(words)))
    docs += [(900, None), (901, ""), (None, items[0][1]), (902, items[1][1]), (902, items[1][1])]
    return items, docs, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc int"), spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item string")


@pytest.mark.parametrize("most", [L.MOST_GRAMS, 60])
def test_every_run_and_no_other(world, most):
    items, docs, item_df, doc_df = world
    want = {(str(d), str(i)) for d, t in docs if t and d is not None for i, u in items if u and longest(L.normal_words(t), L.normal_words(u)) >= 12}
    got = [tuple(r) for r in L.repeated_runs(doc_df, item_df, most_grams=most).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_edited_copy_beside_an_intact_one(spark):
    item = [f"v{i}" for i in range(40)]
    edited = [w for k in range(0, 40, 8) for w in [*item[k : k + 7], f"other{k}"]]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    # The seventh words' n-grams are in the intact copy alone, so the rarest of each window is among them.
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(edited)), (3, "nothing of it")], "doc_id long, text string")
    got = {r.doc: (r.score, r.run) for r in L.leaks(docs, items, every=L.EVERY).collect()}
    assert got == {"1": (80, 40), "2": (smith_waterman(item, edited), 7)} and got["2"][0] >= 40
    assert {r.doc for r in L.leaks(docs, items).collect()} == {"1"}


def test_blocks_and_bounds_change_no_score(world):
    items, docs, item_df, doc_df = world
    score = lambda **options: {(r.doc, r.item): (r.score, r.run) for r in L.leaks(doc_df, item_df, every=L.EVERY, **options).collect()}
    whole = score()
    assert score(most_grams=60) == whole
    full = {str(i): 2 * len(L.normal_words(t)) for i, t in items if t}
    assert score(least=0.5) == {k: v for k, v in whole.items() if v[0] >= 0.5 * full[k[1]]} != whole


def test_nothing(world):
    _, _, items, docs = world
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.leaks(docs, items, gram=13)
