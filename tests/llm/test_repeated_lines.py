from collections import defaultdict
from itertools import product

import pytest

from lodestrand.llm import repeated_lines as R

SCHEMA = "doc_id string, chunk_id string, text string, key string, line_no string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "k", "n") for r in rows], SCHEMA)


def brute(rows, n=6):
    letters = lambda s: "".join(c for c in s.upper().lower() if c.isalpha())
    docs = defaultdict(set)
    for d, c, t in rows:
        if d is not None and c is not None and t is not None:
            for line in t.split("\n"):
                if letters(line):
                    docs[d, letters(line)].add(c)
    return {(c, i) for d, c, t in rows if t is not None and c is not None for i, line in enumerate(t.split("\n")) if len(docs.get((d, letters(line)), ())) >= n}


ROWS = (
    [("a", f"c{i}", f"Legal notice {i}:\r\nbody {chr(97 + i) * 3}\nSHARE  this!\n---") for i in range(7)]
    + [("a", "c0", "Legal notice 0:\r\nbody aaa\nSHARE  this!\n---")] * 3
    + [("b", f"d{i}", "share THIS\nStraße") for i in range(5)]
    + [("b", "d9", "STRASSE\n\nx"), ("b", "e", None), (None, "f", "legal notice"), ("b", None, "share this"), ("b", "g", "")]
)


def test_against_brute_force(spark):
    got = R.repeated_lines(make(spark, ROWS)).select("doc", "line_no").distinct().collect()
    assert {tuple(r) for r in got} == brute(ROWS) and len(got) > 10


def test_clean_text_keeps_rows_and_columns(spark):
    df = R.without_repeated_lines(make(spark, ROWS))
    assert df.count() == len(ROWS) and {"key", "line_no"} <= set(df.columns)
    by = {(r.doc_id, r.chunk_id): r for r in df.collect()}
    assert by["a", "c1"].clean_text == "body bbb\n---" and by["a", "c1"].lines_removed == 2
    assert by["b", "e"].clean_text is None and by["b", "e"].lines_removed == 0
    assert by["b", "g"].clean_text == ""


def test_sequences_against_brute_force(spark):
    rows = [("s", f"{i}", "\n".join(p)) for i, p in enumerate(product("abc", repeat=3))]
    patterns, _ = R.frequent_sequences(make(spark, rows), min_support=4, max_length=3)
    got = sorted((r.length, r.support) for r in patterns.collect())
    want = []
    for n in (1, 2, 3):
        seen = defaultdict(set)
        for _, c, t in rows:
            p = t.split("\n")
            for i in range(len(p) - n + 1):
                seen[tuple(p[i : i + n])].add(c)
        want += [(n, len(v)) for v in seen.values() if len(v) >= 4]
    assert got == sorted(want)


def test_sequences_of_any_gap_and_length(spark):
    from itertools import combinations

    rows = [("s", f"{i}", "\n".join("abcdef")) for i in range(4)] + [("s", f"x{i}", "\n".join(p)) for i, p in enumerate(product("abg", repeat=3))]
    seen = defaultdict(set)
    for _, c, t in rows:
        p = t.split("\n")
        for n in range(1, len(p) + 1):
            for q in combinations(p, n):
                seen[q].add(c)
    got = sorted((r.length, r.support) for r in R.every_sequence(make(spark, rows), min_support=4).collect())
    assert got == sorted((len(q), len(v)) for q, v in seen.items() if len(v) >= 4) and got[-1] == (6, 4)
    assert R.every_sequence(make(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [[], [("a", "c", "   \n 12 \n--")]])
def test_nothing_to_find(spark, rows):
    df = make(spark, rows)
    assert R.repeated_lines(df).count() == 0
    assert R.without_repeated_lines(df).count() == len(rows)
