"""Terms of texts, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term is a run of letters and digits of any script.
TERM = r"[\p{L}\p{N}]+"


@cache
def foldings() -> tuple[str, str]:
    """Letters with marks and what they fold to, by canonical decomposition; the marks themselves fold to nothing."""
    pairs = {}
    for code in (*range(0xC0, 0x590), *range(0x1E00, 0x2000)):
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.category(c).startswith("M")]
        if len(base) == 1 and base[0] != chr(code):
            pairs[chr(code)] = base[0]
    return "".join(pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(pairs.values())


def folded(text: Column | str) -> Column:
    """Lower case without accents; plain ASCII holds none, so it is spared the look at each character."""
    lower = F.lower(text)
    return F.when(lower.rlike(r"\A\p{ASCII}*+\z"), lower).otherwise(F.translate(lower, *foldings()))


def terms(text: Column | str) -> Column:
    """The terms of a text in order; none for NULL."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def query_groups(text: Column | str) -> Column:
    """A query's terms, hyphened ones kept together as phrases, repeats included."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(f"{TERM}(?:-{TERM})*"), F.lit(0)), F.array().cast("array<string>"))


def snippet(text: Column | str, length: int = 300) -> Column:
    return F.substring(text, 1, length)


def one_line(text: Column | str, length: int = 200) -> Column:
    """White space collapsed, cut to `length` characters."""
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, length)


def slug(text: Column | str) -> Column:
    """Terms joined by dashes."""
    return F.array_join(terms(text), "-")
