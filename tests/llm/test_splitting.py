import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm import splitting as S


def check(text, limit, overlap):
    starts, ends = S._tokens(text)
    pieces = S.cut(text, limit, overlap)
    assert "".join(text[p[2] : (pieces[i + 1][2] if i + 1 < len(pieces) else len(text))] for i, p in enumerate(pieces)) == (text if starts else "")
    for i, (a, b, core, n, _) in enumerate(pieces):
        assert n <= limit and len(S._tokens(text[a:b])[0]) == n and a <= core < b
        if i:
            assert len(S._tokens(text[a:core])[0]) == min(overlap, len(S._tokens(text[:core])[0])) and pieces[i - 1][1] == core
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1_ .,;\n\f\r-é|​", max_size=300), st.integers(3, 20), st.integers(0, 2))
def test_whole_within_limit_with_overlap(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_at_the_strongest_boundary_that_fits():
    sentence = "one two three four five. "
    text = (sentence * 4 + "\n\n") * 3
    assert [S.LEVELS[p[4]] for p in check(text, 24, 0)[:-1]] == ["paragraph", "paragraph"]
    assert {p[4] for p in check("x" * 9 + "-" * 50, 10, 2)[:-1]} == {5}


def test_rows(spark):
    rnd = random.Random(1)
    long = " ".join(rnd.choice(["Alpha", "beta.", "gamma,", "delta\n"]) for _ in range(3000))
    rows = [("a", long, 7), ("a", long, 7), ("n", long, None), ("b", "short", 0), ("c", None, 0), ("d", "", 0), ("e", "w " * 768, 0), ("f", "w " * 769, 0)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "chunk_id string, text string, char_start int, piece_no int, id string")
    got = S.split_oversized(df).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in got} == {"a", "n", "f"}
    a = [r for r in got if r.chunk_id == "a"]
    assert len({r.piece_no for r in a}) == len(a) and all(r.text == long[r.char_start - 7 : r.char_end - 7] and r.token_count <= 768 for r in a)
    assert a[-1].char_end == 7 + len(long) and [r for r in got if r.chunk_id == "n"][0].char_start == 0
    assert S.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.split_oversized(df, overlap=768)
