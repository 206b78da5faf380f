import itertools
import random

import numpy as np
import pytest

from lodestrand.llm import pairs as P
from lodestrand.llm.crf import Crf

WHO = ("red team", "log analyst", "change board", "data steward", "site manager", "records clerk")
WHAT = ("session tokens", "visitor badges", "backup tapes", "audit records", "door locks", "travel permits")
WHEN = ("every thirty days", "after each incident", "before the annual review", "once a quarter")
WER, WAS, WANN = ("die Leitstelle", "der Ausschuss", "die Netzgruppe"), ("Zutrittskarten", "Protokolle", "Schlüssel"), ("nach der Prüfung", "vor jeder Änderung", "bei jedem Schichtwechsel")
BODIES = ("I cannot assist with {1}", "the request has been turned down by the desk", "no supported reply can be given", "we are not able to talk about {1}", "this lies beyond what may be told here")
APOLOGIES = ("I'm sorry, but ", "Unfortunately, ", "Regrettably, ", "")


def corpus(n=700, seed=5):
    """(pair_id, question, response, may_lack, defect) with every defect planted."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        who, what, when, k = rnd.choice(WHO), rnd.choice(WHAT), rnd.choice(WHEN), rnd.randint(1, 40)
        german = i % 4 == 0
        if german:
            wer, was, wann = rnd.choice(WER), rnd.choice(WAS), rnd.choice(WANN)
            q, a = f"Wer prüft nach AB-{k} {was} und wie oft?", f"AB-{k} verlangt, dass {wer} die {was} {wann} prüft. Es wird für den Nachweis mit der Revision von {wer} abgelegt."
        else:
            q = f"Which duty does AB-{k} name for the {what} of the {who}?"
            a = rnd.choice([f"AB-{k} requires that the {who} shall review {what} {when} [1].", f"The {who} is not permitted to keep {what}; it must revoke them {when}.", f"According to AB-{k}, the {who} cannot waive the rule on {what}. Each desk keeps a register of {what} {when}."])
        lack, kind = False, None
        draw = rnd.random()
        if draw < 0.06:
            a, kind = rnd.choice(["", "  \n", "n/a", "[NO_ANSWER]", "TBD", "Answer:", "Antwort: ", "Réponse:", "Pregunta: [1]", "Q: [NO_ANSWER]", None]), "empty"
        elif draw < 0.14 and not german:
            a, kind = rnd.choice(APOLOGIES) + rnd.choice(BODIES).format(who, what) + ".", "refusal"
            a = a[0].upper() + a[1:] + rnd.choice(["", " Please consult the desk."])
        elif draw < 0.19:
            a, kind = rnd.choice([q, q.upper(), f"A: {q[:-1]}", f"“{q}”"]), "copy"
        elif draw < 0.24:
            if german:
                a = f"AB-{k} requires that the {who} shall review {what} {when}."
            else:
                a = f"AB-{k} verlangt, dass {rnd.choice(WER)} die {rnd.choice(WAS)} {rnd.choice(WANN)} prüft."
            kind = "language"
        elif draw < 0.34:
            words = a.split()
            a, kind = " ".join(words[: rnd.randint(4, len(words) - 2)]).rstrip(".;,") + rnd.choice(["", " th"]), "truncated"
        elif draw < 0.42:
            a = rnd.choice(["Annually", "30 days", "No.", "Yes."])
        elif draw < 0.52 and not german:
            a, lack = f"The corpus does not state anything about {what}.", True
        out.append((f"p{i:04}", q, a, lack, kind))
    return out


def agree(data, found):
    """(recall, precision, the pairs that differ)."""
    truth = {(r[0], r[4]) for r in data if r[4]}
    return len(truth & found) / len(truth), len(truth & found) / max(1, len(found)), sorted(truth ^ found)


def test_defects_planted_held_out(spark):
    """Most pairs are not in the sample that the field is fitted on."""
    data = corpus()
    df = spark.createDataFrame([*data, *data[:9]], "pair_id string, question string, response string, may_lack boolean, defect string").drop("defect").distinct()
    found = {(r.pair_id, r.defect) for r in P.broken_pairs(df, sample=300).collect()}
    recall, precision, wrong = agree(data, found)
    texts = {r[0]: r for r in data}
    assert recall >= 0.95 and precision >= 0.95, [(w, texts[w[0]]) for w in wrong]


@pytest.mark.parametrize("text", [None, "", " \n", "...", "[1]", "“”", "<empty>", "Antwort:", "Réponse:", "Frage: [1]", "Q: [NO_ANSWER]", "Answer: [NO_ANSWER]", "Respuesta: …"])
def test_what_says_nothing_is_empty(text):
    model, tongues = Crf(P.FEATURES, len(P.TAGS)), P.Tongues(np.zeros((P.SPOKEN, 4)))
    assert P.is_empty(text) and P.tagged_pair(model, tongues, "Why?", text, False, None)[0] == "empty"
    assert model.decode([]) == []


def test_no_feature_is_a_phrase_list():
    """The shape of a clause knows no words: apologies and inabilities reach the field as words only."""
    tongues = P.Tongues(np.zeros((P.SPOKEN, 4)))
    shape = lambda text: [f for f in P.describe("What is due?", text, None, tongues)[0][0] if f < P.SHAPES]
    assert shape("Sorry, but we cannot tell you that now.") == shape("Alas, then they reviewed many of those now.")


def test_lacking_is_no_refusal_where_nothing_can_be_said():
    assert P.defect([P.REFUSAL], [5], True, True) is None and P.defect([P.REFUSAL], [5], True, False) == P.defect([P.REFUSAL], [5], False, True) == "refusal"
    assert P.defect([P.ECHO, P.ANSWER], [9, 1], True, False) is None and P.defect([P.ECHO], [9], True, False) == "copy"
    assert P.defect([P.FOREIGN, P.ANSWER], [5, 5], True, False) == "language" and P.defect([P.ANSWER, P.UNFINISHED], [5, 5], True, False) == "truncated"


def test_pairs_of_calls_and_golden(spark):
    calls = spark.createDataFrame(
        [("c1", ([("user", "x\nQuestion: What now?\nbrief"), ("assistant", "Question: no"), ("user", "ok")],), ("Yes.",)), ("c2", ([("user", None)],), (None,)), ("c3", None, None)],
        "call_id string, request struct<messages array<struct<role string, content string>>>, response struct<text string>",
    )
    golden = spark.createDataFrame([("g", "q", "a", "unanswerable", 1), ("g", "q", "a", "unanswerable", 1), (None, "q", "a", None, 1)], "id string, question string, reference_answer string, type string, pair_id int")
    got = {tuple(r) for r in P.pairs_of(golden, calls).collect()}
    assert got == {("g", "q", "a", True), ("c1", "What now?", "Yes.", False), ("c2", None, None, False), ("c3", None, None, False)}
    assert {r.defect for r in P.broken_pairs(P.pairs_of(golden, calls).where("response is null")).collect()} == {"empty"}
    assert P.broken_pairs(P.pairs_of(golden.limit(0), calls.limit(0))).count() == 0


def test_field_by_enumeration():
    rnd = np.random.default_rng(0)
    f = Crf(4, 3)
    f.emit, f.move, f.first = rnd.normal(size=(4, 3)), rnd.normal(size=(3, 3)), rnd.normal(size=3)
    x = [[0], [1, 2], [3, 0]]
    score = lambda t: f.first[t[0]] + sum(f.emit[c, k] for cs, k in zip(x, t, strict=True) for c in cs) + sum(f.move[a, b] for a, b in itertools.pairwise(t))
    assert tuple(f.decode(x)) == max(itertools.product(range(3), repeat=3), key=score)
    g = Crf(4, 2).fit([[[0], [1]], [[1], [0], [2]]] * 5, [[0, 1], [1, 0, 0]] * 5, np.full(4, 1e-4))
    assert g.decode([[0], [1]]) == [0, 1] and g.decode([[1], [0], [2]]) == [1, 0, 0]
