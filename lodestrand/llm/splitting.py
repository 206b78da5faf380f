"""Splitting of oversized texts at natural boundaries: a recursive separator hierarchy.

A token is a run of letters, digits and underscores, or one other visible character. Spark counts
the tokens of each text that is long enough to have too many and hands only the oversized ones to
Python, in Arrow batches; each is cut on its own, so no shuffle is needed.

A text falls into sections; a section that is too large falls into paragraphs, those into lines,
sentences, words and at last tokens, each level only where the one above left a part too large.
The parts are packed greedily: a piece takes parts as long as it stays within the limit, and the
next one starts with the last `overlap` tokens of the piece before.

Defined results: NULL and empty texts and texts within the limit give no pieces; stored counts
are not trusted, `token_count` is counted anew; `char_start` and `char_end` count code points
from the text's own char_start (0 if NULL); equal rows give equal pieces, so each row is cut once
however often it recurs; columns beside the named ones are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 768, 64
#: One token, for Java's and for Python's expressions.
TOKEN_JAVA = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\p{C}]"
TOKEN = re.compile(r"\w+|[^\w\s]")
#: Ends of sections, paragraphs, lines, sentences and words, from the strongest to the weakest.
SEPARATORS = tuple(
    re.compile(p)
    for p in (
        r"\f\s*|(?:\r?\n[^\S\n]*){3,}|\r?\n(?=(?:#{1,6} |\d+(?:\.\d+)* [^\W\d_]|[A-Z]{2}-\d+\S* [^\W\d_])[^\n]{0,80}\r?\n)",
        r"(?:\r?\n[^\S\n]*){2,}",
        r"\r?\n",
        r"(?<=[.!?;])[\"”»)\]]*\s+",
        r"\s+",
    )
)

PIECES = "chunk_id string, piece_no int, token_count int, char_start int, char_end int, boundary string, text string"
LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_JAVA))


def _tokens(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the tokens."""
    starts, ends = [], []
    for m in TOKEN.finditer(text):
        if m.end() - m.start() > 1 or text[m.start()].isprintable():
            starts.append(m.start())
            ends.append(m.end())
    return starts, ends


def _parts(text: str, starts: list[int], first: int, last: int, most: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """(end token, level) of the parts of tokens first..last, none above `most` tokens."""
    if last - first <= most:
        yield last, level - 1
        return
    if level == len(SEPARATORS):
        for end in range(first + most, last, most):
            yield end, level
        yield last, level - 1
        return
    at, stop = starts[first], starts[last] if last < len(starts) else len(text)
    cuts = [bisect_left(starts, m.end(), first, last) for m in SEPARATORS[level].finditer(text, at, stop)]
    begin = first
    for end in (*dict.fromkeys(c for c in cuts if first < c < last), last):
        inner = list(_parts(text, starts, begin, end, most, level + 1))
        yield from inner[:-1]
        yield end, level if end < last else level - 1
        begin = end


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """The pieces as (start, end, core start, tokens, level of the cut at its end), in code points.

    The cores, from each piece's core start to the next one's, make up the whole text.
    """
    starts, ends = _tokens(text)
    n = len(starts)
    if n <= limit:
        return [(0, len(text), 0, n, -1)] if n else []
    pieces, begin, filled, level = [], 0, 0, -1
    head = 0
    for end, kind in _parts(text, starts, 0, n, limit - overlap):
        if filled > begin and end - head > limit:
            pieces.append((head, begin, filled, level))
            begin, head = filled, max(0, filled - overlap)
        filled, level = end, kind
    pieces.append((head, begin, n, -1))
    place = lambda t: starts[t] if 0 < t < n else (0 if t == 0 else len(text))
    return [(place(h), place(e), place(b), e - h, k) for h, b, e, k in pieces]


def _split(limit: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk_id, text, base in zip(batch["id"], batch["text"], batch["base"], strict=True):
                for k, (start, end, _, tokens, level) in enumerate(cut(text, limit, overlap)):
                    rows.append((chunk_id, k, tokens, base + start, base + end, LEVELS[level] if level >= 0 else "end", text[start:end] if with_text else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return run


def oversized(df: DataFrame, id_: str = "chunk_id", text: str = "text", base: str | None = "char_start", limit: int = LIMIT) -> DataFrame:
    """(id, text, base) of the distinct texts of more than `limit` tokens."""
    start = F.coalesce(F.col(base).cast("int"), F.lit(0)) if base else F.lit(0)
    rows = df.select(F.col(id_).alias("id"), F.col(text).alias("text"), start.alias("base"))
    # A token has at least one character, so shorter texts need no counting.
    return rows.where((F.length("text") > limit) & (token_count(F.col("text")) > limit)).distinct()


def split_oversized(df: DataFrame, id_: str = "chunk_id", text: str = "text", base: str | None = "char_start", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """One row for each piece of each oversized text, columns as in `PIECES`.

    `boundary` names the level at which a piece was cut; the last piece of a text has "end".
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and limit")
    return oversized(df, id_, text, base, limit).mapInPandas(_split(limit, overlap, with_text), PIECES)
