import random

from lodestrand.llm import truncation as T

SUBJECTS = ["The change board", "The records unit", "Each component owner", "The internal auditor", "The platform group"]
VERBS = ["reviews", "archives", "must encrypt", "shall monitor", "compares"]
OBJECTS = ["password vaults", "exception requests", "dormant identities", "backup images", "risk registers"]
ENDS = ["before any production change", "at each shift handover", "so that duties stay separated", "within two working days"]


def corpus():
    rnd = random.Random(8)
    say = lambda: f"{rnd.choice(SUBJECTS)} {rnd.choice(VERBS)} {rnd.choice(OBJECTS)} {rnd.choice(ENDS)}."
    body = lambda: " ".join(say() for _ in range(rnd.randint(2, 5)))
    whole = [body() + x for _ in range(6) for x in ("", "\n\n- risk registers at each shift handover", "\nAB-1 | risk registers | the board | 31", "\n\n4.2 Open points", "\nOpen points", "\n[12] Key Handling, rev. 3", "\nRef. AB-7/3", "\n— Red Team, review desk", "\n***", "\n(end of extract)", " [3][4]", "\n“So it stands.”", "\nKeywords: risk registers, backup images")]
    cut = [body() + " " + x for _ in range(4) for x in ("The change board rev", "The records unit must encrypt exception requ", "Each component owner", "The platform group shall monitor risk registers before", "The internal auditor compares back <cut>", "The change board (more)", "The records unit archives backup images at each shift hand…", "The records unit compares passw\x00", "Each component owner reviews dormant identities,")]
    limited = [("The records unit " + body() * 9)[:280] for _ in range(80)]
    limited = [x for x in limited if x[-1] != "." and not x.rstrip().endswith(tuple(e.split()[-1] for e in ENDS))]
    return whole + ["OK", "OK", "OK", "OK", "n/a", "n/a", "n/a", "n/a", "Done."], cut + limited


def test_cut_and_whole(spark):
    whole, cut = corpus()
    rows = [(i, "a", t) for i, t in enumerate(whole)] + [(10_000 + i, "b", t) for i, t in enumerate(cut)]
    rows += [(20_000, "a", None), (20_001, None, ""), (20_002, "a", " \n"), (None, "a", "The change bo"), rows[0], rows[-1]]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, source string, text string, word string, size int")
    got = {r.id: r for r in T.judged(df).collect()}
    texts = {str(r[0]): r[2] for r in rows}
    wrong = [(texts[i][-60:], r.reason) for i, r in got.items() if r.cut != (10_000 <= int(i) < 20_000)]
    assert not wrong
    assert T.cut_texts(df).count() == len(cut)
    rates = {r.source: (r.texts, r.cut) for r in T.rates(df).collect()}
    assert rates["b"][0] == rates["b"][1] == len(cut) + 1 and rates["a"][1] == 0 and rates[None] == (1, 0)


def test_cut_texts_do_not_vouch_for_each_other(spark):
    whole, _ = corpus()
    ends = ["The change board", "The records unit must encrypt exception requ", "the usual remarks"]
    rows = [(i, "a", t) for i, t in enumerate(whole)]
    # Twelve texts cut at the same words, and one text in twelve copies that holds them as a line.
    rows += [(1000 + 100 * k + i, "b", f"{whole[i * 13]}\n{'x' * i}.\n{end}") for k, end in enumerate(ends[:2]) for i in range(6)]
    rows += [(2000 + i, "c", "Notes.\nThe change board\nIt met.") for i in range(12)]
    rows += [(3000 + i, "d", f"It met {i}.\n{ends[2]}\nIt closed.") for i in range(3)] + [(3100, "d", f"It met.\n{ends[2]}")]
    # Whole texts that are alike, and alike ones from which others go on.
    rows += [(4000 + i, "e", "waiting for results") for i in range(5)] + [(4100 + i, "e", "The internal auditor") for i in range(3)]
    got = {int(r.id): r.reason for r in T.judged(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert {r for i, r in got.items() if 1000 <= i < 1100} <= {"goes_on", "unended"} and {r for i, r in got.items() if 1100 <= i < 1200} == {"prefix"}
    assert got[3100] == "recurring"
    assert {r for i, r in got.items() if 4000 <= i < 4100} == {"recurring"} and {r for i, r in got.items() if 4100 <= i < 4200} <= {"goes_on", "unended"}


def test_trie(spark):
    long = "abcdefghijklmno"
    words = spark.createDataFrame([("ab", 3, 0), ("abc", 5, 1), ("x", 1, 0), (long, 7, 0), (long + "p", 2, 0), ("y" * 20_000, 4, 0)], "word string, n long, ends long")
    wanted = [("a",), ("ab",), ("b",), (None,), ("a",), (long[:11],), (long[:12],), (long[:13],), (long,), (long + "p",), ("y" * 300,)]
    got = {(r.node, r.below) for r in T.trie(words, spark.createDataFrame(wanted, "word string")).collect()}
    assert got == {("a", 17), ("ab", 14), (long[:11], 9), (long[:12], 9), (long[:13], 9), (long, 2), ("y" * 300, 4)}


def test_last_lines():
    assert T.last_line("a\nThe end [...]  ") == ("The end", True) and T.last_line("a b�") == ("a b", True)
    assert T.last_line("whole.\n***") == ("***", False) and T.last_line("...") == ("...", False)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert T.cut_texts(df).count() == T.rates(df).count() == 0
