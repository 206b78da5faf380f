"""Context under a token budget, merging of sub-queries, citations and sentinels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One token, as TESTDATA.md counts them; any other counter is a column expression of the text.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\p{C}]"
# Fixed value: how a refusal begins.
SENTINEL = "[NO_ANSWER]"


def count_tokens(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def neutralised(text: Column | str) -> Column:
    """Forged excerpt tags lose their angle bracket."""
    return F.regexp_replace(text, r"(?i)<(/?)(excerpt)", "&lt;$1$2")


def attribute(value: Column | str) -> Column:
    return neutralised(F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit("'")))


def excerpt(marker: Column | str) -> Column:
    """A chunk (doc_id, section_id, heading, page_start, text) as numbered excerpt."""
    source = F.concat(attribute("doc_id"), F.lit(" §"), attribute("section_id"), F.lit(" — "), attribute("heading"), F.lit(" (p."), F.coalesce(F.col("page_start").cast("string"), F.lit("")), F.lit(")"))
    return F.concat(F.lit("<excerpt id="), F.col(marker).cast("string") if isinstance(marker, str) else marker, F.lit(' source="'), source, F.lit('">\n'), neutralised("text"), F.lit("\n</excerpt>\n"))


def budgeted(ranked: DataFrame, tokens: str, budget: int, by: str = "query_id") -> DataFrame:
    """Ranked rows up to the first that no longer fits; the first always stays.

    Token counts are positive, so the running sum tells: once a row misses, all later ones do.
    """
    upto = F.sum(tokens).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("tokens_upto", upto).where((F.col("rank") == 1) | (F.col("tokens_upto") <= budget))


def _gather(budget: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        chosen, seen = [], set()
        group = group.sort_values(["sub_query", "rank"])
        share = budget // max(1, group["sub_query"].nunique())
        for _, rows in group.groupby("sub_query", sort=True):
            spent, first = 0, True
            for row in rows.itertuples(index=False):
                if row.doc in seen:
                    continue
                if not first and spent + row.tokens > share:
                    break
                first, spent = False, spent + row.tokens
                seen.add(row.doc)
                chosen.append((row.question_id, len(chosen) + 1, row.sub_query, row.doc))
        return pd.DataFrame(chosen, columns=["question_id", "place", "sub_query", "doc"])

    return run


def gathered_context(sub_rankings: DataFrame, budget: int) -> DataFrame:
    """(question_id, place, sub_query, doc): sub-queries merged in turn, each under its share.

    `sub_rankings` has (question_id, sub_query, rank, doc, tokens), a few ranked rows per question.
    What one sub-query takes is skipped by the next ones, so a question is walked in order.
    """
    return sub_rankings.groupBy("question_id").applyInPandas(_gather(budget), "question_id string, place int, sub_query int, doc string")


def given_excerpts(asked: Column | str, part: str = "source") -> Column:
    """The sources (or texts) of a request's excerpts by position, as `excerpt` writes them: the first unbroken block, numbered from 1.

    Tags that are forged in a question, or opened within an excerpt, are not counted.
    """
    tag = r'<excerpt id=(\d+) source="([^"\n]*)">\n(?:((?s:.*?))\n)?</excerpt>'
    block = F.regexp_extract(asked, rf"(?m)^(?:{tag}\n?)+", 0)
    ids, parts = (F.regexp_extract_all(block, F.lit(tag), F.lit(g)) for g in (1, {"source": 2, "text": 3}[part]))
    numbered = F.transform(F.arrays_zip(ids.alias("id"), parts.alias("part")), lambda x, i: F.struct(x["id"].alias("id"), x["part"].alias("part"), (i + 1).alias("position")))
    return F.transform(F.filter(numbered, lambda x: x["id"] == x["position"].cast("string")), lambda x: x["part"])


def markers(text: Column | str) -> Column:
    """The citation markers of an answer, each once, in the order of first appearance."""
    found = F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def resolved(answers: DataFrame, text: str = "text", context_size: str = "context_size") -> DataFrame:
    """Adds cited and invalid markers and the text without the invalid ones.

    Spaces left behind are closed up: runs of spaces, and a space before a sign.
    """
    all_ = markers(text)
    out = answers.withColumns({"cited": F.filter(all_, lambda n: (n >= 1) & (n <= F.col(context_size))), "invalid": F.array_sort(F.filter(all_, lambda n: (n < 1) | (n > F.col(context_size))))})
    bare = F.expr(f"aggregate(invalid, {text}, (t, n) -> regexp_replace(t, concat('\\\\[0*', n, '\\\\]'), ''))")
    tidy = F.trim(F.regexp_replace(F.regexp_replace(bare, " {2,}", " "), " ([.!?,;:])", "$1"))
    return out.withColumn("resolved_text", F.when(F.size("invalid") > 0, tidy).otherwise(F.col(text)))


def scrubbed(answers: DataFrame, text: str = "text") -> DataFrame:
    """Adds refusal, stray_sentinel and scrubbed_text."""
    lead = F.regexp_replace(text, r"^\s+", "")
    refusal = lead.startswith(SENTINEL)
    rest = F.when(refusal, F.substring(lead, len(SENTINEL) + 1, 1 << 30)).otherwise(lead)
    stray = F.contains(rest, F.lit(SENTINEL))
    # A sentinel between two words leaves one space, anywhere else none.
    seam = F.regexp_replace(rest, r"(?<=\S)\[NO_ANSWER\][ \t]*(?=\S)(?!\[NO_ANSWER\])", " ")
    clean = F.regexp_replace(seam, r"\[NO_ANSWER\][ \t]*", "")
    return answers.withColumns({"refusal": refusal, "stray_sentinel": stray, "scrubbed_text": F.regexp_replace(F.when(stray, clean).otherwise(rest), r"^\s+|\s+$", "")})


def parsed_scores(text: Column | str, dimensions: tuple[str, ...] = ("faithfulness", "relevance", "citation_accuracy")) -> Column:
    """The scores in a judge's reply, from its first brace to its last; NULL unless all are whole numbers of 1 to 5 with reasons."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    whole = F.lit(True)
    values = []
    for d in dimensions:
        raw, why = F.get_json_object(body, f"$.{d}.score"), F.get_json_object(body, f"$.{d}.justification")
        whole = whole & F.coalesce(raw.rlike("^[1-5]$") & (F.length(F.trim(why)) > 0), F.lit(False))
        values.append(raw.cast("int").alias(d))
    return F.when(whole, F.struct(*values))
