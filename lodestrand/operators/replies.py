"""Replies of language models read as data: rankings, plans and critiques in JSON, inside the JVM.

A reply that is no such JSON, or breaks one of the rules below, is NULL or the stated fallback,
never an error of the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a critique may complain of.
ISSUES = ("uncited_claim", "unsupported_citation", "incomplete", "contradiction")


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def body(text: Column | str) -> Column:
    """What lies between the first opening and the last closing brace, if it is an object of JSON."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def items(json: Column, path: str) -> Column:
    """The entries of an array of JSON as variants; NULL if there is no array."""
    raw = F.get_json_object(json, path)
    return F.when(raw.startswith("["), F.try_parse_json(raw).cast("array<variant>"))


def is_text(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))


def text_at(x: Column, path: str) -> Column:
    """A string field of a variant; NULL if it is missing, blank or no string."""
    value = F.try_variant_get(x, path, "variant")
    text = stripped(value.cast("string"))
    return F.when(is_text(value) & (F.length(text) > 0), text)


def ranking(text: Column | str) -> Column:
    """The list of ids in {"ranking": [...]}, code fences allowed; NULL unless all entries are strings."""
    bare = F.regexp_replace(F.regexp_replace(stripped(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    listed = items(F.when(bare.startswith("{") & bare.endswith("}") & F.try_parse_json(bare).isNotNull(), bare), "$.ranking")
    return F.when(F.forall(listed, is_text), F.transform(listed, lambda x: x.cast("string")))


def plan(text: Column | str, question: Column | str, most: int = 4) -> Column:
    """(kind, sub_queries, fallback): direct, or multi_hop with its first `most` sub-queries.

    A reply that can't be read, of an unknown kind, or with fewer than two sub-queries that say
    anything falls back to the question itself.
    """
    asked = F.array(F.col(question) if isinstance(question, str) else question)
    json = body(text)
    kind = F.get_json_object(json, "$.classification")
    parts = F.filter(F.transform(F.filter(items(json, "$.sub_queries"), is_text), lambda x: stripped(x.cast("string"))), lambda x: F.length(x) > 0)
    several = F.coalesce((kind == "multi_hop") & (F.size(parts) >= 2), F.lit(False))
    direct = F.coalesce(kind == "direct", F.lit(False))
    return F.struct(
        F.when(several, "multi_hop").otherwise("direct").alias("kind"),
        F.when(several, F.slice(parts, 1, most)).otherwise(asked).alias("sub_queries"),
        (~several & ~direct).alias("fallback"),
    )


def critique(text: Column | str) -> Column:
    """(verdict, issues of kind, detail, fix): pass without issues, or revise with at least one.

    NULL if the verdict is another one or an issue is incomplete or of an unknown kind.
    """
    json = body(text)
    verdict = F.get_json_object(json, "$.verdict")
    found = F.transform(items(json, "$.issues"), lambda x: F.struct(text_at(x, "$.kind").alias("kind"), text_at(x, "$.detail").alias("detail"), text_at(x, "$.fix").alias("fix")))
    sound = F.forall(found, lambda i: F.coalesce(i["kind"].isin(*ISSUES) & i["detail"].isNotNull() & i["fix"].isNotNull(), F.lit(False)))
    passed = F.struct(F.lit("pass").alias("verdict"), F.slice(found, 1, 0).alias("issues"))
    none = F.struct(F.lit("pass").alias("verdict"), F.array().cast("array<struct<kind:string,detail:string,fix:string>>").alias("issues"))
    revise = F.struct(F.lit("revise").alias("verdict"), found.alias("issues"))
    return F.when(verdict == "pass", F.when(found.isNull(), none).otherwise(passed)).when((verdict == "revise") & (F.size(found) > 0) & sound, revise)
