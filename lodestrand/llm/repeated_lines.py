"""Lines repeated across the documents of one source: distributed PrefixSpan and removal.

Each document is the sequence of its lines' identifiers. PrefixSpan grows frequent sequences
level by level: the projected database is a table with a row for each occurrence of a pattern
and what follows it in the document, so one level is one explode, one count of distinct
documents and one semi join, all keyed by (source, pattern), never by source alone.

Defined results: rows whose source, document or text is NULL have no lines; a line without
letters is never repeated; an empty table gives an empty result; repeated rows count once, as
support counts distinct documents; columns beside the named ones are ignored, whatever they
are called, and kept by `without_repeated_lines`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.session import cut_lineage

MIN_SUPPORT = 6
MAX_LENGTH = 4


def line_key(line: Column) -> Column:
    """A line's identifier: its letters in order, apart from case. NULL if it has none.

    The hash has 64 bits. The sharp s counts as its capital form, ss.
    """
    letters = F.replace(F.lower(F.regexp_replace(line, r"[^\p{L}]+", "")), F.lit("ß"), F.lit("ss"))
    return F.when(F.length(letters) > 0, F.xxhash64(letters))


def lines(df: DataFrame, source: str = "doc_id", doc: str = "chunk_id", text: str = "text") -> DataFrame:
    """(source, doc, body, line_no, key) of each line with letters; body tells apart texts under one doc."""
    rows = df.select(F.col(source).alias("source"), F.col(doc).alias("doc"), F.col(text).alias("text"))
    rows = rows.where("source is not null and doc is not null and text is not null")
    return (
        rows.select("source", "doc", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("source", "doc", "body", "line_no", line_key(F.col("line")).alias("key"))
        .where("key is not null")
    )


def frequent_lines(occurrences: DataFrame, min_support: int) -> DataFrame:
    """(source, key, support) of the lines found in at least `min_support` documents of a source.

    The first aggregation is keyed by document as well, so a line that a third of all documents
    hold is spread; the second adds up what was already counted within each task.
    """
    per_doc = occurrences.groupBy("source", "key", "doc").agg(F.lit(1).alias("one"))
    return per_doc.groupBy("source", "key").agg(F.count("one").alias("support")).where(F.col("support") >= min_support)


def frequent_sequences(
    df: DataFrame,
    source: str = "doc_id",
    doc: str = "chunk_id",
    text: str = "text",
    min_support: int = MIN_SUPPORT,
    max_length: int = MAX_LENGTH,
    max_gap: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """PrefixSpan. Returns the patterns and their occurrences.

    patterns: (source, pattern, length, support), pattern being an array of line identifiers.
    occurrences: (source, doc, body, pattern, line_nos).
    Lines that are not frequent alone are left out first, as no frequent sequence holds them.
    Neighbours of a pattern lie at most `max_gap` places apart in what remains; patterns have at
    most `max_length` lines. Both bound the growth of a document's occurrences to its length
    times max_gap ** (max_length - 1); they drop no line, as each line of a longer pattern is a
    pattern too.
    """
    # Split and hashed once, read for the counts and for the sequences.
    every = cut_lineage(lines(df, source, doc, text))
    single = cut_lineage(frequent_lines(every, min_support))
    kept = every.join(single, ["source", "key"])
    sequences = kept.groupBy("source", "doc", "body").agg(F.array_sort(F.collect_set(F.struct("line_no", "key", "support"))).alias("seq"))
    level = sequences.select(
        "source", "doc", "body", F.posexplode("seq").alias("at", "item"), F.col("seq")
    ).select(
        "source", "doc", "body",
        F.array("item.key").alias("pattern"),
        F.array("item.line_no").alias("line_nos"),
        F.col("item.support").alias("support"),
        F.expr(f"slice(seq, at + 2, {max_gap * (max_length - 1)})").alias("rest"),
    )
    level = cut_lineage(level)
    patterns, found = [single.select("source", F.array("key").alias("pattern"), F.lit(1).alias("length"), "support")], [level]
    for length in range(2, max_length + 1):
        grown = level.select("source", "doc", "body", "pattern", "line_nos", "rest", F.posexplode(F.slice("rest", 1, max_gap)).alias("at", "item")).select(
            "source", "doc", "body",
            F.concat("pattern", F.array("item.key")).alias("pattern"),
            F.concat("line_nos", F.array("item.line_no")).alias("line_nos"),
            F.expr("slice(rest, at + 2, size(rest))").alias("rest"),
        )
        per_doc = grown.groupBy("source", "pattern", "doc").agg(F.lit(1).alias("one"))
        frequent = per_doc.groupBy("source", "pattern").agg(F.count("one").alias("support")).where(F.col("support") >= min_support)
        level = cut_lineage(grown.join(frequent, ["source", "pattern"]).select("source", "doc", "body", "pattern", "line_nos", "support", "rest"))
        if level.isEmpty():
            break
        patterns.append(level.groupBy("source", "pattern").agg(F.lit(length).alias("length"), F.max("support").alias("support")))
        found.append(level)
    occurrences = [x.select("source", "doc", "body", "pattern", "line_nos") for x in found]
    return reduce(DataFrame.unionByName, patterns), reduce(DataFrame.unionByName, occurrences)


def every_sequence(df: DataFrame, source: str = "doc_id", doc: str = "chunk_id", text: str = "text", min_support: int = MIN_SUPPORT) -> DataFrame:
    """(source, pattern, length, support) of all frequent sequences, with any gaps and of any length.

    A text is projected once per pattern, to what follows the pattern's first occurrence; levels
    are grown until none is frequent. The patterns themselves can be as many as the subsequences
    of the longest sequence that is frequent.
    """
    every = cut_lineage(lines(df, source, doc, text))
    single = cut_lineage(frequent_lines(every, min_support))
    kept = every.join(single, ["source", "key"])
    rest = F.transform(F.array_sort(F.collect_set(F.struct("line_no", "key"))), lambda x: x["key"])
    level = cut_lineage(kept.groupBy("source", "doc", "body").agg(rest.alias("rest")).withColumn("pattern", F.expr("cast(array() as array<bigint>)")))
    out, length = [], 0
    while not level.isEmpty():
        length += 1
        grown = level.select("source", "doc", "body", "pattern", "rest", F.explode(F.array_distinct("rest")).alias("key")).select(
            "source", "doc", "body",
            F.concat("pattern", F.array("key")).alias("pattern"),
            F.expr("slice(rest, array_position(rest, key) + 1, size(rest))").alias("rest"),
        )
        per_doc = grown.groupBy("source", "pattern", "doc").agg(F.lit(1).alias("one"))
        frequent = cut_lineage(per_doc.groupBy("source", "pattern").agg(F.count("one").alias("support")).where(F.col("support") >= min_support))
        out.append(frequent.select("source", "pattern", F.lit(length).alias("length"), "support"))
        level = cut_lineage(grown.where(F.size("rest") > 0).join(frequent.select("source", "pattern"), ["source", "pattern"]))
    return reduce(DataFrame.unionByName, out) if out else single.select("source", F.array("key").alias("pattern"), F.lit(1).alias("length"), "support")


def repeated_lines(df: DataFrame, source: str = "doc_id", doc: str = "chunk_id", text: str = "text", **mining) -> DataFrame:
    """(source, doc, body, line_no) of each line that a frequent sequence covers."""
    _, found = frequent_sequences(df, source, doc, text, **mining)
    return found.select("source", "doc", "body", F.explode("line_nos").alias("line_no")).distinct()


def without_repeated_lines(df: DataFrame, source: str = "doc_id", doc: str = "chunk_id", text: str = "text", **mining) -> DataFrame:
    """`df` with the columns clean_text and lines_removed; NULL texts stay NULL with 0 removed.

    A column of `df` that already has one of these names is replaced.
    """
    marks = repeated_lines(df, source, doc, text, **mining).groupBy("source", "doc", "body").agg(F.collect_set("line_no").alias("gone"))
    marks = marks.select(F.struct("source", "doc", "body").alias("_at"), F.col("gone").alias("_gone"))
    at = F.struct(F.col(source).alias("source"), F.col(doc).alias("doc"), F.xxhash64(text).alias("body"))
    joined = df.withColumn("_at", at).join(marks, "_at", "left")
    clean = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    return joined.withColumns(
        {"clean_text": F.when(F.col("_gone").isNull(), F.col(text)).otherwise(clean), "lines_removed": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))}
    ).drop("_at", "_gone")
