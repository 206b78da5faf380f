"""Replies of models, written from the golden examples and labels as JSON and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import answers, replies
from lodestrand.operators.judging import DIMENSIONS
from lodestrand.sources.tables import table


def _golden(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "v2", "id", "question", "reference_answer", "type", "source_citations").distinct()


def reply_rankings(spark: SparkSession, folder: str) -> DataFrame:
    """A judge's ranking of the cited sections, in a code fence; examples without citations get no list."""
    listed = F.to_json(F.struct(F.transform("source_citations", lambda c: F.concat_ws(" ", c["doc"], c["section"])).alias("ranking")))
    rows = _golden(spark, folder).select("id", replies.ranking(F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).alias("r"))
    return rows.select("id", F.size(F.coalesce("r", F.array().cast("array<string>"))).alias("listed"), F.array_join("r", "|").alias("ranking"))


def reply_plans(spark: SparkSession, folder: str) -> DataFrame:
    """A planner's reply: several hops take the question and the answer, another type is no known kind."""
    kind = F.when(F.col("type") == "multihop", "multi_hop").when(F.col("type") == "lookup", "direct").otherwise(F.col("type"))
    said = F.concat(F.lit("Plan: "), F.to_json(F.struct(kind.alias("classification"), F.array("question", F.lit("  "), "reference_answer").alias("sub_queries"))), F.lit(" done"))
    rows = _golden(spark, folder).where("question is not null").select("id", replies.plan(said, "question").alias("p"))
    return rows.select("id", "p.kind", F.array_join("p.sub_queries", "|").alias("sub_queries"), "p.fallback")


def reply_critiques(spark: SparkSession, folder: str) -> DataFrame:
    """A critic's reply: an issue for each score below 3; labels with notes of white space only give no valid fix."""
    rows = table(spark, folder, "labels", "example_id", "labeler", *DIMENSIONS, "notes").distinct()
    names = {"faithfulness": "unsupported_citation", "relevance": "incomplete", "citation_accuracy": "uncited_claim"}
    issues = F.filter(F.array(*[F.when(F.col(d) < 3, F.struct(F.lit(k).alias("kind"), F.lit(d).alias("detail"), F.coalesce("notes", F.lit("look again")).alias("fix"))) for d, k in names.items()]), lambda x: x.isNotNull())
    said = F.to_json(F.struct(F.when(F.size(issues) > 0, "revise").otherwise("pass").alias("verdict"), issues.alias("issues")))
    read = rows.withColumn("c", replies.critique(said))
    return read.groupBy(F.col("c.verdict").alias("verdict")).agg(F.count("*").alias("replies"), F.sum(F.coalesce(F.size("c.issues"), F.lit(0))).alias("issues"))


def reply_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A judge's scores with their reasons; one that is missing or out of range makes the reply worthless."""
    rows = table(spark, folder, "labels", "example_id", "labeler", *DIMENSIONS).distinct()
    said = F.concat(F.lit("Here: "), F.to_json(F.struct(*[F.struct(F.col(d).alias("score"), F.lit("as noted").alias("justification")).alias(d) for d in DIMENSIONS])))
    read = rows.withColumn("s", answers.parsed_scores(said))
    return read.agg(F.count("*").alias("replies"), F.count("s").alias("valid"), *[F.sum(f"s.{d}").alias(d) for d in DIMENSIONS])


QUERIES = {f.__name__: f for f in (reply_rankings, reply_plans, reply_critiques, reply_scores)}

_G = "WITH g AS (SELECT DISTINCT id, question, reference_answer, type, source_citations FROM v2) "
SQL = {
    "reply_rankings": _G + "SELECT id, coalesce(len(source_citations), 0)::INT AS listed, array_to_string(list_transform(source_citations, lambda c: concat_ws(' ', c.doc, c.section)), '|') AS ranking FROM g",
    "reply_plans": _G
    + r"""SELECT id, CASE WHEN type = 'multihop' AND trimmed <> '' AND answer <> '' THEN 'multi_hop' ELSE 'direct' END AS kind,
  CASE WHEN type = 'multihop' AND trimmed <> '' AND answer <> '' THEN trimmed || '|' || answer ELSE question END AS sub_queries,
  NOT (type = 'multihop' AND trimmed <> '' AND answer <> '') AND coalesce(type, '') <> 'lookup' AS fallback
FROM (SELECT *, regexp_replace(question, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS trimmed, coalesce(regexp_replace(reference_answer, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS answer FROM g) WHERE question IS NOT NULL""",
    "reply_critiques": """
WITH l AS (SELECT DISTINCT example_id, labeler, faithfulness, relevance, citation_accuracy, notes FROM labels),
n AS (SELECT coalesce((faithfulness < 3)::INT, 0) + coalesce((relevance < 3)::INT, 0) + coalesce((citation_accuracy < 3)::INT, 0) AS n, coalesce(trim(notes), 'look again') AS fix FROM l),
v AS (SELECT CASE WHEN n = 0 THEN 'pass' WHEN fix <> '' THEN 'revise' END AS verdict, CASE WHEN n > 0 AND fix <> '' THEN n ELSE 0 END AS n FROM n)
SELECT verdict, count(*) AS replies, sum(n)::BIGINT AS issues FROM v GROUP BY 1""",
    "reply_scores": "WITH l AS (SELECT DISTINCT example_id, labeler, faithfulness, relevance, citation_accuracy FROM labels), s AS (SELECT *, coalesce(faithfulness BETWEEN 1 AND 5 AND relevance BETWEEN 1 AND 5 AND citation_accuracy BETWEEN 1 AND 5, false) AS ok FROM l) SELECT count(*) AS replies, count(*) FILTER (ok) AS valid, "
    + ", ".join(f"sum({d}) FILTER (ok)::BIGINT AS {d}" for d in DIMENSIONS)
    + " FROM s",
}
