"""The pN_ queries and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm import consensus, leakage, multiselect, packing, pairs, repeated_lines, splitting, truncation
from lodestrand.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks", "chunk_id", "doc_id", "text")
    return repeated_lines.repeated_lines(chunks).select(F.col("doc").alias("chunk_id"), "line_no").distinct()


def p1_clean_chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks", "chunk_id", "doc_id", "text").distinct()
    return repeated_lines.without_repeated_lines(chunks).select("chunk_id", "doc_id", "lines_removed", "clean_text")


def p1_line_sequences(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks", "chunk_id", "doc_id", "text")
    patterns = repeated_lines.every_sequence(chunks)
    return patterns.groupBy(F.col("source").alias("doc_id"), "length").agg(F.count("*").alias("sequences"), F.max("support").alias("most_chunks"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.unreliable(table(spark, folder, "labels")).select(F.col("rater").alias("labeler"))


def p2_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.consensus(table(spark, folder, "labels")).withColumnRenamed("item", "example_id")


def p2_reliability(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.reliability(table(spark, folder, "labels")).withColumnRenamed("rater", "labeler")


def p2_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.agreement(table(spark, folder, "labels")).withColumns({c: F.round(c, 9) for c in ("alpha_interval", "alpha_nominal")})


def _latencies(spark: SparkSession, folder: str) -> DataFrame:
    return multiselect.measurements(table(spark, folder, "metrics", "request_id", "source", "ts", "provider", "pipeline", "latency_s", "ingest_seq"))


def p3_latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    exact = multiselect.percentiles(_latencies(spark, folder), ("provider", "pipeline"))
    return exact.withColumn("rank_error", F.lit(0))


def p3_daily_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return multiselect.summaries(_latencies(spark, folder), ("provider", "pipeline", "day"))


def p3_combined_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of all days from the days' summaries, with bounds that hold the exact value."""
    days = multiselect.summaries(_latencies(spark, folder), ("provider", "pipeline", "day"))
    out = multiselect.combined(days, ("provider", "pipeline"))
    error = multiselect.ERROR
    return out.withColumns({"estimate": F.round("estimate", 6), "least": F.round(F.col("estimate") / (1 + error), 6), "most": F.round(F.col("estimate") / (1 - error), 6)})


def _chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks", "chunk_id", "text", "char_start")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(_chunk_texts(spark, folder), with_text=False).where("piece_no > 0").select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(_chunk_texts(spark, folder))


def p4_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Of each oversized chunk: the tokens of its pieces less their overlaps, which are those of its text, and its pieces' bounds."""
    pieces = p4_pieces(spark, folder)
    before = F.lag("char_end").over(Window.partitionBy("chunk_id").orderBy("piece_no"))
    shared = F.coalesce(F.greatest(before - F.col("char_start"), F.lit(0)), F.lit(0))
    told = pieces.withColumn("shared", shared).withColumns({
        "new": splitting.token_count(F.substr("text", F.col("shared") + 1)),
        "again": F.when(F.col("piece_no") > 0, splitting.token_count(F.substr("text", F.lit(1), F.col("shared")))),
    })
    within = F.bool_and((F.col("token_count") <= splitting.LIMIT) & (splitting.token_count(F.col("text")) == F.col("token_count")))
    return told.groupBy("chunk_id").agg(F.sum("new").alias("tokens"), F.min("char_start").alias("first_start"), F.max("char_end").alias("last_end"), within.alias("within"), F.min("again").alias("least_overlap"), F.max("again").alias("most_overlap"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.pairs_of(table(spark, folder, "v2"), table(spark, folder, "canary_defended"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(_pairs(spark, folder))


def p5_clause_coverage(spark: SparkSession, folder: str) -> DataFrame:
    tagged = pairs.tagged(_pairs(spark, folder))
    return tagged.select("defect", F.explode(F.arrays_zip("tags", "words")).alias("c")).groupBy("defect", F.col("c.tags").alias("tag")).agg(F.count("*").alias("clauses"), F.sum("c.words").alias("words"))


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(table(spark, folder, "documents", "doc_id", "text")).withColumn("doc_id", F.col("id").cast("long")).drop("id", "text_hash")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _containers(spark, folder)


def p6_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document: the characters in containers, and whether these keep their capacity and split no text that fits."""
    rows = _containers(spark, folder)
    whole = (F.count("*") == 1) | (F.sum("n_tokens") > packing.CAPACITY)
    return rows.groupBy("doc_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("characters"), F.bool_and(F.col("container_tokens") <= packing.CAPACITY).alias("within"), whole.alias("whole"))


def p6_container_texts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text")
    return packing.container_texts(documents, packing.containers(documents))


def _leak_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "testitems", "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.repeated_runs(*_leak_tables(spark, folder))
    return found.select(F.col("doc").cast("long").alias("doc_id"), F.col("item").cast("long").alias("item_id"))


def p7_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Copies, edited and paraphrased too: alignments that reach half of what a full copy would score."""
    found = leakage.leaks(*_leak_tables(spark, folder), gram=leakage.EDITED_GRAM, every=leakage.EVERY, least=0.5)
    return found.select(F.col("doc").cast("long").alias("doc_id"), F.col("item").cast("long").alias("item_id"), "score", "span", "run", "words")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "source", "text")
    return truncation.cut_texts(documents).select(F.col("id").cast("long").alias("doc_id"))


def p8_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.rates(table(spark, folder, "documents", "doc_id", "source", "text"))


#: SQL for "the letters of a line, apart from case", and the repeated lines by it.
LINES_SQL = """
WITH l AS (
  SELECT DISTINCT doc_id, chunk_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT doc_id, chunk_id, text, line, line_no, replace(lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')), 'ß', 'ss') AS letters FROM l),
f AS (SELECT doc_id, letters, count(DISTINCT chunk_id) AS n FROM k WHERE letters <> '' GROUP BY ALL HAVING n >= 6)
"""

P1_FOUND_SQL = LINES_SQL + "SELECT DISTINCT k.chunk_id, CAST(k.line_no AS INTEGER) AS line_no FROM k JOIN f USING (doc_id, letters)"

P1_CLEAN_SQL = (
    LINES_SQL
    + """
SELECT k.chunk_id, k.doc_id, CAST(count(f.n) AS INTEGER) AS lines_removed,
       coalesce(string_agg(CASE WHEN f.n IS NULL THEN k.line END, chr(10) ORDER BY k.line_no), '') AS clean_text
FROM k LEFT JOIN f USING (doc_id, letters) GROUP BY k.chunk_id, k.doc_id, k.text
"""
)

P2_AGREEMENT_SQL = """
WITH d AS (SELECT DISTINCT example_id AS item, lower(trim(labeler)) AS rater, faithfulness, relevance, citation_accuracy FROM labels
           WHERE example_id IS NOT NULL AND lower(trim(labeler)) <> ''),
u AS (SELECT item, rater, 'faithfulness' AS dimension, faithfulness AS score FROM d UNION ALL SELECT item, rater, 'relevance', relevance FROM d
      UNION ALL SELECT item, rater, 'citation_accuracy', citation_accuracy FROM d),
v AS (SELECT item, rater, dimension, score FROM (
        SELECT item, rater, dimension, score, row_number() OVER (PARTITION BY item, rater, dimension ORDER BY n DESC, score) AS r
        FROM (SELECT item, rater, dimension, score, count(*) AS n FROM u WHERE score BETWEEN 1 AND 5 GROUP BY ALL)) WHERE r = 1),
m AS (SELECT *, count(*) OVER (PARTITION BY item, dimension) AS m FROM v QUALIFY m > 1),
pairs AS (SELECT a.dimension, sum((a.score - b.score) ** 2 / (a.m - 1.0)) AS d, sum((a.score <> b.score)::INT / (a.m - 1.0)) AS o
          FROM m a JOIN m b ON a.item = b.item AND a.dimension = b.dimension AND a.rater <> b.rater GROUP BY 1),
c AS (SELECT dimension, score, count(*) AS c FROM m GROUP BY ALL),
e AS (SELECT a.dimension, sum(a.c * b.c * (a.score - b.score) ** 2) AS d, sum(a.c * b.c * (a.score <> b.score)::INT) AS o FROM c a JOIN c b USING (dimension) GROUP BY 1),
n AS (SELECT dimension, count(DISTINCT item) AS items, count(*) AS ratings FROM m GROUP BY 1)
SELECT dimension, items, ratings, round(1 - (ratings - 1) * pairs.d / e.d, 9) AS alpha_interval, round(1 - (ratings - 1) * pairs.o / e.o, 9) AS alpha_nominal
FROM n JOIN pairs USING (dimension) JOIN e USING (dimension)
"""

LATENCIES_SQL = """
WITH l AS (SELECT provider, pipeline, latency_s, ts, row_number() OVER (PARTITION BY request_id, source ORDER BY ingest_seq DESC) AS r FROM metrics),
x AS (SELECT lower(trim(provider)) AS provider, coalesce(pipeline, 'vanilla') AS pipeline, CAST(ts AT TIME ZONE 'UTC' AS DATE) AS day, latency_s AS v FROM l
      WHERE r = 1 AND latency_s IS NOT NULL AND NOT isnan(latency_s) AND latency_s >= 0),
n AS (SELECT *, row_number() OVER (PARTITION BY provider, pipeline ORDER BY v) AS k, count(*) OVER (PARTITION BY provider, pipeline) AS n FROM x),
p AS (SELECT unnest([0.5, 0.9, 0.95, 0.99])::DOUBLE AS percentile)
"""

P3_SQL = LATENCIES_SQL + """
SELECT provider, pipeline, percentile, v AS value, n AS "values", 0 AS rank_error FROM n, p WHERE k = greatest(ceil(round(percentile * n, 6)), 1)
"""

P3_DAILY_SQL = LATENCIES_SQL + """
SELECT provider, pipeline, day, CASE WHEN v > 0 THEN ceil(round(ln(v) / ln(1.01 / 0.99), 9))::INT END AS bucket, count(*) AS "values" FROM x GROUP BY ALL
"""

P3_COMBINED_SQL = LATENCIES_SQL + """
, e AS (SELECT provider, pipeline, percentile, n AS "values", CASE WHEN v = 0 THEN 0 ELSE 2 * pow(1.01 / 0.99, ceil(round(ln(v) / ln(1.01 / 0.99), 9))) / (1.01 / 0.99 + 1) END AS estimate
  FROM n, p WHERE k = greatest(ceil(round(percentile * n, 6)), 1))
SELECT provider, pipeline, percentile, "values", round(estimate, 6) AS estimate, round(estimate / 1.01, 6) AS least, round(estimate / 0.99, 6) AS most FROM e
"""

P4_FOUND_SQL = r"""
SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 768 AND len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\p{C}]')) > 768
"""

P4_COVER_SQL = r"""
WITH k AS (SELECT DISTINCT chunk_id, text, coalesce(char_start, 0) AS char_start, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\p{C}]')) AS tokens FROM chunks WHERE length(text) > 768)
SELECT chunk_id, tokens, char_start AS first_start, char_start + length(text) AS last_end, true AS within, 64 AS least_overlap, 64 AS most_overlap FROM k WHERE tokens > 768
"""

#: Runs of 12 words in common; signs that show nothing are taken out as the operator's words are.
P7_FOUND_SQL = r"""
WITH n AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM testitems),
w AS (SELECT kind, id, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '[\p{Cf}\x00-\x08\x0E-\x1B\x7F-\x84\x86-\x9F\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]', '', 'g'))), '[\p{L}\p{N}]+') AS w FROM n WHERE text IS NOT NULL),
g AS (SELECT kind, id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM w WHERE len(w) >= 12)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i USING (g) WHERE d.kind = 'd' AND i.kind = 'i'
"""

QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_clean_chunks": p1_clean_chunks,
    "p1_line_sequences": p1_line_sequences,
    "p2_found": p2_found,
    "p2_consensus": p2_consensus,
    "p2_reliability": p2_reliability,
    "p2_agreement": p2_agreement,
    "p3_latency_percentiles": p3_latency_percentiles,
    "p3_daily_summaries": p3_daily_summaries,
    "p3_combined_percentiles": p3_combined_percentiles,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_cover": p4_cover,
    "p5_found": p5_found,
    "p5_clause_coverage": p5_clause_coverage,
    "p6_containers": p6_containers,
    "p6_cover": p6_cover,
    "p6_container_texts": p6_container_texts,
    "p7_found": p7_found,
    "p7_alignments": p7_alignments,
    "p8_found": p8_found,
    "p8_source_rates": p8_source_rates,
}

SQL = {
    "p1_found": P1_FOUND_SQL,
    "p1_clean_chunks": P1_CLEAN_SQL,
    "p2_agreement": P2_AGREEMENT_SQL,
    "p3_latency_percentiles": P3_SQL,
    "p3_daily_summaries": P3_DAILY_SQL,
    "p3_combined_percentiles": P3_COMBINED_SQL,
    "p4_found": P4_FOUND_SQL,
    "p4_cover": P4_COVER_SQL,
    "p6_cover": "SELECT doc_id, length(text) AS characters, true AS within, true AS whole FROM documents WHERE text IS NOT NULL",
    "p7_found": P7_FOUND_SQL,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
