"""From raw texts to sections and chunks.

A document is one row, so segmentation, consolidation and windows are worked out within the row,
in Arrow batches; no document's lines are ever shuffled together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes in tokens.
TARGET, OVERLAP, EMPTY = 512, 64, 10
#: A heading: a control id or a section number before a title without a stop.
HEADING = re.compile(r"^(?:([A-Z]{2}-\d+[a-z]?(?:\(\d+\))?)|(\d+(?:\.\d+)*)|((?:Annex|Appendix) [A-Z])):? ([^\W\d_][^.!?|]{1,80})$")
TOKEN = re.compile(r"\w+|[^\w\s]")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
CONTROL = re.compile(r"^([A-Z]{2})-\d+")

SECTIONS = "doc_id string, ordinal int, section_id string, heading string, char_start int, char_end int, text string"
CHUNKS = "doc_id string, ordinal int, section_id string, section_ids array<string>, heading string, char_start int, char_end int, token_count int, content_type string, text string"


def sections_of(text: str) -> list[tuple[str, str, int, int]]:
    """(section id, heading, start, end) of a text; what stands before the first heading is untitled."""
    found, at, name, title, start = [], 0, "untitled", "", 0
    for line in text.split("\n"):
        m = HEADING.match(line.strip())
        if m:
            if text[start:at].strip():
                found.append((name, title, start, at))
            name, title, start = next(g for g in m.groups()[:3] if g), m[4], at + len(line) + 1
        at += len(line) + 1
    if text[start:].strip():
        found.append((name, title, start, len(text)))
    return found


def same_unit(a: str, b: str) -> bool:
    """Whether two sections may be merged: one control family, one leading number, annexes, or nothing of these."""
    ca, cb = CONTROL.match(a), CONTROL.match(b)
    if ca and cb:
        return ca[1] == cb[1]
    if a[0].isdigit() and b[0].isdigit():
        return a.split(".")[0] == b.split(".")[0]
    annex = [x.lower().startswith(("annex", "appendix")) for x in (a, b)]
    return all(annex) if any(annex) else a == b == "untitled"


def content_type(text: str) -> str:
    """`table` from three lines in a row on that look like columns."""
    run = 0
    for line in text.split("\n"):
        if line.strip():
            run = run + 1 if re.search(r"\s{2,}|\t| \| ", line) and len(line.split()) >= 2 else 0
            if run == 3:
                return "table"
    return "text"


def _size(text: str) -> int:
    return len(TOKEN.findall(text))


def units(sections: list[tuple[str, str, int, int]], text: str, target: int) -> list[tuple[list[str], str, int, int]]:
    """Sections merged while the next is all but empty, or a sibling that still fits."""
    merged: list[list] = []
    for name, title, start, end in sections:
        size = _size(text[start:end])
        if merged and (size < EMPTY or same_unit(merged[-1][0][-1], name) and merged[-1][4] + size <= target):
            merged[-1][0].append(name)
            merged[-1][3] = end
            merged[-1][4] += size
        else:
            merged.append([[name], title, start, end, size])
    return [(m[0], m[1], m[2], m[3]) for m in merged]


def windows(text: str, start: int, end: int, target: int, overlap: int, cap: int) -> list[tuple[int, int]]:
    """Character ranges of whole sentences up to the target, overlapping by up to twice `overlap`."""
    if _size(text[start:end]) <= target:
        return [(start, end)]
    spans, at = [], start
    for m in [*SENTENCE.finditer(text, start, end), None]:
        stop = m.start() if m else end
        if text[at:stop].strip():
            tokens = [(t.start(), t.end()) for t in TOKEN.finditer(text, at, stop)]
            pieces = -(-len(tokens) // target) if len(tokens) > cap else 1
            step = -(-len(tokens) // pieces) if tokens else 1
            for k in range(0, len(tokens), step):
                part = tokens[k : k + step]
                spans.append((part[0][0], part[-1][1], len(part)))
        at = m.end() if m else end
    out, i = [], 0
    while i < len(spans):
        j, total = i + 1, spans[i][2]
        while j < len(spans) and total + spans[j][2] <= target:
            total += spans[j][2]
            j += 1
        out.append((spans[i][0], spans[j - 1][1]))
        if j == len(spans):
            break
        back, shared = j, 0
        while back > i + 1 and shared + spans[back - 1][2] <= 2 * overlap:
            back -= 1
            shared += spans[back][2]
        i = back
    return _repacked(out, text, 2 * overlap, cap)


def _repacked(ranges: list[tuple[int, int]], text: str, least: int, cap: int) -> list[tuple[int, int]]:
    """Ranges of fewer than `least` tokens go to the one before, else the one behind, within the cap."""
    ranges, i = list(ranges), 0
    while len(ranges) > 1 and i < len(ranges):
        if _size(text[slice(*ranges[i])]) >= least:
            i += 1
            continue
        for a in (i - 1, i):
            if 0 <= a and a + 1 < len(ranges) and _size(text[ranges[a][0] : ranges[a + 1][1]]) <= cap:
                ranges[a : a + 2] = [(ranges[a][0], ranges[a + 1][1])]
                i = a
                break
        else:
            i += 1
    return ranges


def _sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(d, k, n, h, s, e, t[s:e]) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for k, (n, h, s, e) in enumerate(sections_of(t))]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTIONS.split(", ")])


def _chunks(target: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                k = 0
                for names, title, start, end in units(sections_of(text), text, target):
                    for s, e in windows(text, start, end, target, overlap, target * 3 // 2):
                        part = text[s:e]
                        rows.append((doc, k, names[0], names, title, s, e, _size(part), content_type(part), part))
                        k += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return run


def _texts(df: DataFrame, doc: str, text: str) -> DataFrame:
    return df.select(F.col(doc).cast("string").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")


def sections(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return _texts(df, doc, text).mapInPandas(_sections, SECTIONS)


def substantial(found: DataFrame, least: int = 50) -> DataFrame:
    """Sections of more than `least` characters; a document whose sections are all shorter keeps its longest, the first of several."""
    size = F.length(F.trim("text"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), "ordinal"))
    kept = found.withColumn("size", size).withColumn("best", F.max("size").over(Window.partitionBy("doc_id"))).withColumn("place", first)
    return kept.where((F.col("size") > least) | ((F.col("best") <= least) & (F.col("place") == 1))).drop("size", "best", "place")


def chunks(df: DataFrame, doc: str = "doc_id", text: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of each document in order, none above 1.5 times the target, with stable ids."""
    return _texts(df, doc, text).mapInPandas(_chunks(target, overlap), CHUNKS).withColumn("chunk_id", chunk_id("doc_id", "section_id", "ordinal"))


def chunk_id(doc: str, section: str, ordinal: str) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", doc, section, F.lpad(F.col(ordinal).cast("string"), 4, "0"))), 1, 16)


# The forms of a heading's start, each with the section id it gives.
SECTION_FORMS = (
    (r"^([A-Z]{2}-\d+(?:\(\d+\))?)", lambda g: g(1)),
    (r"(?i)^(govern|map|measure|manage)\s+(\d+)\.(\d+)", lambda g: F.concat_ws("-", F.lower(g(1)), g(2), g(3))),
    (r"^(\d+\.\d+(?:\.\d+)*)", lambda g: g(1)),
    (r"(?i)^appendix\s+([a-z])", lambda g: F.concat(F.lit("appendix-"), F.lower(g(1)))),
    (r"(?i)^chapter\s+(\d+)", lambda g: F.concat(F.lit("chapter-"), g(1))),
)


def is_heading(line: Column | str) -> Column:
    """Whether a line begins as a heading does and is no line of a table of contents."""
    line = F.col(line) if isinstance(line, str) else line
    starts = F.lit(False)
    for pattern, _ in SECTION_FORMS:
        starts = starts | F.trim(line).rlike(pattern)
    return starts & ~line.contains("....")


def section_id(heading: Column | str) -> Column:
    """The canonical id of a heading; front-matter if it begins as none does, and for NULL."""
    text = F.trim(heading)
    out = F.lit("front-matter")
    for pattern, named in reversed(SECTION_FORMS):
        out = F.when(text.rlike(pattern), named(lambda k, p=pattern: F.regexp_extract(text, p, k))).otherwise(out)
    return out


def breadcrumb(path: Column | str) -> Column:
    """The last three parts of a path of headings."""
    parts = F.split(path, " > ")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), " > ")


def fingerprint(df: DataFrame, id_: str) -> DataFrame:
    """One hash over the set of ids, whatever their order and number: no task holds more than sums.

    Each id's SHA-256 is taken as eight numbers; their sums over all ids are hashed together.
    """
    ids = df.select(F.sha2(F.col(id_), 256).alias("h")).where("h is not null").distinct()
    parts = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    sums = ids.agg(F.count("*").alias("ids"), *parts)
    joined = F.concat_ws(",", "ids", *[F.coalesce(F.col(f"s{i}"), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(8)])
    return sums.select(F.sha2(joined, 256).alias("fingerprint"), "ids")


def cleaned_lines(text: Column | str) -> Column:
    """A text without repeats of the line before, lone numbers and blank lines."""
    kept = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^[0-9]+$"))
    # Each line beside the one before it.
    pairs = F.arrays_zip(kept.alias("line"), F.concat(F.array(F.lit(None).cast("string")), kept).alias("before"))
    told = F.filter(pairs, lambda p: p["line"].isNotNull() & ~p["line"].eqNullSafe(p["before"]))
    return F.array_join(F.transform(told, lambda p: p["line"]), "\n")
