import random
from itertools import combinations

import pytest

from lodestrand.llm import consensus as C

SCHEMA = "example_id string, labeler string, faithfulness int, relevance int, citation_accuracy int, notes string, weight double, score int"


def planted():
    rnd, rows = random.Random(7), []
    for i in range(90):
        truth = rnd.randint(1, 5)
        for r in ("ann", "bo", "cy", "strict", "noise", "flat"):
            if rnd.random() < 0.9:
                v = lambda: {"noise": rnd.randint(1, 5), "flat": 4, "strict": max(1, truth - 1)}.get(r, min(5, max(1, truth + rnd.choice([0, 0, 0, 1, -1]))))  # noqa: B023, E731
                rows.append((f"e{i:02}", f" {r.upper()} " if i % 3 else r, v(), v(), v(), None, 1.0, 3))
    rows += [("e00", "few", 1, 2, 3, None, 0.0, 0), ("e01", None, 1, 1, 1, None, 0.0, 0), (None, "ann", 5, 5, 5, None, 0.0, 0), ("lone", "ann", 9, None, 2, "x", 0.0, 0)]
    return rows + rows[:5]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(planted(), SCHEMA)


def test_only_those_who_follow_nobody(labels):
    assert {r.rater for r in C.unreliable(labels).collect()} == {"noise", "flat"}


def test_alpha_by_definition(labels):
    votes = [(r.item, r.rater, r.dimension, r.score) for r in C.votes(labels).collect()]
    assert len({v[:3] for v in votes}) == len(votes) and not any(v[3] == 9 for v in votes)
    got = {r.dimension: r for r in C.agreement(labels).collect()}
    for d in C.DIMENSIONS:
        items = {}
        for i, _, dim, s in votes:
            if dim == d:
                items.setdefault(i, []).append(s)
        items = [x for x in items.values() if len(x) > 1]
        flat = [s for x in items for s in x]
        observed = sum(2 * (a - b) ** 2 / (len(x) - 1) for x in items for a, b in combinations(x, 2)) / len(flat)
        expected = sum(2 * (a - b) ** 2 for a, b in combinations(flat, 2)) / len(flat) / (len(flat) - 1)
        assert got[d].alpha_interval == pytest.approx(1 - observed / expected) and got[d].ratings == len(flat)


def excess_by_definition(own, others):
    """Accuracy over chance as a share of what is possible: the votes of one rater against the others' means."""
    n = len(own)
    if n < 2 or len(set(own)) < 2 or len(set(others)) < 2:
        return 0.0
    # Each vote's offset is that of all others of the rater.
    lost = [(s - c - (sum(own) - s - sum(others) + c) / (n - 1)) ** 2 / 16 for s, c in zip(own, others, strict=True)]
    at_random = [(s - sum(own) / n - c + sum(others) / n) ** 2 * (n / (n - 1)) ** 2 / 16 for s in own for c in others]
    plain, chance = 1 - sum(lost) / n, 1 - sum(at_random) / n**2
    return ((n * plain + C.SMOOTHING * chance) / (n + C.SMOOTHING) - chance) / (1 - chance)


@pytest.mark.parametrize("options", [{}, {"row": 2}, {"most": 0}, {"row": 2, "most": 0}])
def test_consensus_rounds_by_brute_force(labels, options):
    """The first round's weights and the consensus they give; items cut into rows, and weights joined, give the same."""
    votes = [tuple(r) for r in C.votes(labels).collect()]
    pairs = {}
    for i, r, d, s in votes:
        rest = [v[3] for v in votes if v[0] == i and v[2] == d and v[1] != r]
        if rest:
            pairs.setdefault((r, d), []).append((s, sum(rest) / len(rest)))
    weight = {k: max(C.FLOOR, excess_by_definition(*map(list, zip(*v, strict=True)))) for k, v in pairs.items()}
    got = {(r.item, r.dimension): r for r in C.consensus(labels, rounds=1, **options).collect()}
    assert len(got) == len({(v[0], v[2]) for v in votes})
    for i, d in {(v[0], v[2]) for v in votes}:
        w = {s: sum(weight.get((v[1], d), C.FLOOR) for v in votes if v[0] == i and v[2] == d and v[3] == s) for s in range(1, 6)}
        assert got[i, d].consensus == min(w, key=lambda s: (-round(w[s], 9), s))
        assert got[i, d].confidence == pytest.approx(max(w.values()) / sum(w.values()))
        assert got[i, d].raters == sum(v[0] == i and v[2] == d for v in votes)


def test_reweighting_finds_the_few_who_agree(spark):
    """Two sound raters among twenty who score at random: equal weights drown them, reweighting does not."""
    rnd, rows = random.Random(0), []
    for i in range(90):
        truth = rnd.randint(1, 5)
        for r in range(22):
            v = lambda: min(5, max(1, truth + rnd.choice([0, 0, 0, 0, 1]))) if r < 2 else rnd.randint(1, 5)  # noqa: B023, E731
            rows.append((f"e{i}", f"r{r:02}", v(), v(), v(), None, 0.0, 0))
    df = spark.createDataFrame(rows, SCHEMA)
    noise = {f"r{r:02}" for r in range(2, 22)}
    assert {r.rater for r in C.unreliable(df, rounds=0).collect()} & {"r00", "r01"}
    assert {r.rater for r in C.unreliable(df).collect()} == noise


def test_rounds_end_when_stable(labels):
    """Another round moves no weight by more than the tolerance."""
    rows, raters, many = C._prepared(labels, "example_id", "labeler", C.DIMENSIONS, C.ROW)
    weights = C.converged(rows, raters, 3, many)
    state = weights.join(C._sums(rows, weights, 3, C.MOST_RATERS, many), "r", "left").toPandas()
    assert C._moved(3, 1.0)(state)["moved"].max() < 2e-3


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.unreliable(df).count() == C.reliability(df).count() == C.consensus(df).count() == C.agreement(df).count() == 0
