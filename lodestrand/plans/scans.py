"""Tables written as JSON lines and read back under their declared schemas, and sinks that can be resumed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import one_line, slug
from lodestrand.operators import judging
from lodestrand.operators.answers import SENTINEL
from lodestrand.session import shared_folder
from lodestrand.sources import files
from lodestrand.sources.tables import table


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"


def scan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    path = _folder(spark)
    files.write_chunks(table(spark, folder, "chunks").distinct(), path)
    rows = files.json_lines(spark, path, files.CHUNK).where("_bad is null")
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"), F.sum(F.size("section_ids")).alias("sections"), F.count_if(F.col("heading").isNull()).alias("untitled"))


def scan_golden(spark: SparkSession, folder: str) -> DataFrame:
    """Examples with all required fields; held_out counts as false where it is left out."""
    path = _folder(spark)
    table(spark, folder, "v2").distinct().where("id is not null and question is not null and type is not null").write.json(path)
    return files.golden(spark, path).groupBy("type", "held_out").agg(F.count("*").alias("examples"), F.sum(F.coalesce(F.size("source_citations"), F.lit(0))).alias("citations"))


def scan_results(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as result files; what stands in rejudged files beside them is left out."""
    path, rows = _folder(spark), table(spark, folder, "labels")
    for name in ("run", "run.rejudge"):
        rows.write.json(f"{path}/{name}")
    return files.result_rows(spark, [f"{path}/run", f"{path}/run.rejudge"], files.LABEL).groupBy("labeler").agg(F.count("*").alias("labels"), F.sum("faithfulness").alias("faithfulness"))


def resume_append(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows each run adds: the golden examples, then the calls as well, then nothing."""
    path = _folder(spark)
    golden = table(spark, folder, "v2", "id").distinct()
    both = golden.unionByName(table(spark, folder, "canary_defended", "call_id").withColumnRenamed("call_id", "id").distinct())
    added = [files.append_missing(rows, path, "id") for rows in (golden, both, both)]
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids")).select(*[F.lit(n).cast("long").alias(f"run_{i}") for i, n in enumerate(added, 1)], "rows", "ids")


def labelling_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty answers to label, drawn in turn from the types; refusals are left out."""
    rows = table(spark, folder, "v2", "id", "question", "reference_answer").distinct().where("reference_answer is not null").select(F.col("id").alias("example_id"), "question", F.ltrim("reference_answer").startswith(SENTINEL).alias("refusal"))
    golden = table(spark, folder, "v2", "id", "type").distinct().where("type is not null").withColumnRenamed("id", "example_id")
    drawn = judging.round_robin(judging.labelable(rows, golden), "type", "example_id", 20)
    return drawn.select("example_id", F.format_string("| %s | %s | %s | | |", "example_id", "type", one_line("question")).alias("line"))


def questions_answered(spark: SparkSession, folder: str) -> DataFrame:
    """Golden questions that recorded calls asked as well, by type."""
    asked = F.filter(F.flatten(F.transform(F.filter("request.messages", lambda m: m["role"] == "user"), lambda m: F.split(F.coalesce(m["content"], F.lit("")), "\n"))), lambda line: line.startswith("Question: "))
    calls = table(spark, folder, "canary_defended", "call_id", "request").distinct().select("call_id", F.substring(F.try_element_at(asked, F.lit(-1)), 11, 1 << 30).alias("question"))
    golden = table(spark, folder, "v2", "id", "question", "type").distinct()
    return golden.join(calls, "question").groupBy("type").agg(F.count_distinct("id").alias("examples"), F.count_distinct("call_id").alias("calls"))


def heading_slugs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks", "heading").where("heading is not null").select("heading", slug("heading").alias("slug"))
    return rows.groupBy("heading", "slug").agg(F.count("*").alias("chunks"))


QUERIES = {f.__name__: f for f in (scan_chunks, scan_golden, scan_results, resume_append, labelling_sheet, questions_answered, heading_slugs)}

SQL = {
    "scan_chunks": "SELECT doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS characters, sum(len(section_ids))::BIGINT AS sections, count(*) FILTER (heading IS NULL) AS untitled FROM (SELECT DISTINCT * FROM chunks) GROUP BY 1",
    "scan_golden": "SELECT type, coalesce(held_out, false) AS held_out, count(*) AS examples, sum(coalesce(len(source_citations), 0))::BIGINT AS citations FROM (SELECT DISTINCT * FROM v2) WHERE id IS NOT NULL AND question IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2",
    "scan_results": "SELECT labeler, count(*) AS labels, sum(faithfulness)::BIGINT AS faithfulness FROM labels GROUP BY 1",
    "resume_append": "WITH g AS (SELECT count(DISTINCT id) AS n FROM v2), c AS (SELECT count(DISTINCT call_id) AS n FROM canary_defended) SELECT g.n AS run_1, c.n AS run_2, 0::BIGINT AS run_3, g.n + c.n AS rows, g.n + c.n AS ids FROM g, c",
    "labelling_sheet": """
WITH r AS (SELECT DISTINCT id, question, reference_answer FROM v2 WHERE reference_answer IS NOT NULL AND NOT starts_with(ltrim(reference_answer), '[NO_ANSWER]')), t AS (SELECT DISTINCT id, type FROM v2 WHERE type IS NOT NULL),
p AS (SELECT r.id, type, question, row_number() OVER (PARTITION BY type ORDER BY r.id) AS turn FROM r JOIN t USING (id))
SELECT id AS example_id, concat('| ', id, ' | ', type, ' | ', substring(regexp_replace(question, '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g'), 1, 200), ' | | |') AS line FROM p ORDER BY turn, type LIMIT 20""",
    "questions_answered": """
WITH c AS (SELECT DISTINCT call_id, request.messages AS ms FROM canary_defended),
q AS (SELECT call_id, list_filter(string_split(array_to_string(list_transform(list_filter(ms, lambda m: m.role = 'user'), lambda m: coalesce(m.content, '')), chr(10)), chr(10)), lambda l: starts_with(l, 'Question: ')) AS qs FROM c),
a AS (SELECT call_id, substr(qs[len(qs)], 11) AS question FROM q)
SELECT type, count(DISTINCT id) AS examples, count(DISTINCT call_id) AS calls FROM v2 JOIN a USING (question) GROUP BY 1""",
    "heading_slugs": "SELECT heading, regexp_replace(regexp_replace(strip_accents(lower(heading)), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS slug, count(*) AS chunks FROM chunks WHERE heading IS NOT NULL GROUP BY ALL",
}
