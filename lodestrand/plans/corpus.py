"""Ingest, judging, report and set queries over documents, chunks, golden examples, labels and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import one_line
from lodestrand.operators import ingest, judging, ledger
from lodestrand.operators.judging import DIMENSIONS
from lodestrand.sources.tables import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def ingest_sections(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.sections(_documents(spark, folder)).drop("text")


def ingest_section_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The section ids that headings of chunks and lines of documents give, with their numbers."""
    lines = _documents(spark, folder).select(F.explode(F.split("text", "\n")).alias("line")).where(ingest.is_heading("line"))
    headings = table(spark, folder, "chunks", "chunk_id", "heading").distinct().select(F.col("heading").alias("line"))
    return lines.unionByName(headings).groupBy(ingest.section_id("line").alias("section_id")).agg(F.count("*").alias("n"))


def ingest_substantial(spark: SparkSession, folder: str) -> DataFrame:
    """Sections kept of each document: the tiny ones are dropped, unless there are no others."""
    return ingest.substantial(ingest.sections(_documents(spark, folder))).groupBy("doc_id").agg(F.count("*").alias("sections"))


def ingest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.chunks(_documents(spark, folder)).select("chunk_id", "doc_id", "ordinal", "section_id", F.size("section_ids").alias("sections"), "char_start", "char_end", "token_count", "content_type")


def ingest_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What the chunks table holds of each publication."""
    rows = table(spark, folder, "chunks", "chunk_id", "doc_id", "section_id", "page_end").distinct()
    return rows.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("section_id").alias("sections"), (F.max("page_end") + 1).alias("pages"))


def ingest_chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks", "chunk_id", "doc_id", "section_id", "char_start").distinct()
    order = Window.partitionBy("doc_id", "section_id").orderBy("char_start", "chunk_id")
    placed = rows.withColumn("ordinal", F.row_number().over(order) - 1)
    return placed.select("chunk_id", "ordinal", ingest.chunk_id("doc_id", "section_id", "ordinal").alias("stable_id"))


def ingest_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.fingerprint(table(spark, folder, "chunks", "chunk_id"), "chunk_id")


def ingest_breadcrumbs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks", "chunk_id", "section_path", "text").distinct()
    return rows.select("chunk_id", ingest.breadcrumb("section_path").alias("path"), one_line("text").alias("line"))


def ingest_clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks", "chunk_id", "text").distinct()
    return rows.select("chunk_id", ingest.cleaned_lines("text").alias("clean"))


def ingest_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each chunk numbered by segment: a line that starts with a control id begins one."""
    rows = table(spark, folder, "chunks", "chunk_id", "text").distinct().select("chunk_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    starts = F.col("line").rlike(r"^[A-Z]{2}-[0-9]+").cast("int")
    seg = F.sum(starts).over(Window.partitionBy("chunk_id").orderBy("line_no"))
    return rows.withColumn("segment", seg).groupBy("chunk_id", "segment").agg(F.min("line_no").alias("first"), F.count("*").alias("lines"))


def missing_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Cited sections no chunk covers: the anti join a resumed job starts from."""
    cited = table(spark, folder, "v2", "source_citations").select(F.explode("source_citations").alias("c")).select("c.doc", "c.section").distinct()
    held = table(spark, folder, "chunks", "doc_id", "section_ids").select(F.col("doc_id").alias("doc"), F.explode("section_ids").alias("section")).distinct()
    return cited.join(held, ["doc", "section"], "left_anti")


def cited_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Golden examples with the number of distinct chunks that cover each citation."""
    cited = table(spark, folder, "v2", "id", "source_citations").distinct().select("id", F.posexplode("source_citations").alias("n", "c")).select("id", "n", "c.doc", "c.section")
    held = table(spark, folder, "chunks", "chunk_id", "doc_id", "section_ids").distinct().select("chunk_id", F.col("doc_id").alias("doc"), F.explode("section_ids").alias("section"))
    return cited.join(held, ["doc", "section"], "left").groupBy("id", "n").agg(F.count_distinct("chunk_id").alias("chunks"))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels", "example_id", "labeler", *DIMENSIONS).withColumn("labeler", F.lower(F.trim("labeler")))
    return rows.groupBy("example_id", "labeler").agg(*[F.max(judging.valid(d)).alias(d) for d in DIMENSIONS])


def _golden(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "v2", "id", "type", "difficulty", "held_out").distinct().withColumnRenamed("id", "example_id")


def judge_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Scores by difficulty and by difficulty and type, unknown examples kept under their own key."""
    rows = _labels(spark, folder).join(_golden(spark, folder), "example_id", "left")
    rows = rows.withColumns({"difficulty": F.coalesce("difficulty", F.lit("unknown")), "type": F.coalesce("type", F.lit("unknown"))})
    return judging.summaries(rows, ("difficulty",), "type")


def judge_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return judging.agreement(_labels(spark, folder), "rater-desk")


def judge_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """(example, labeler) pairs that occur more than once, which a join must not multiply."""
    rows = table(spark, folder, "labels", "example_id", "labeler").withColumn("labeler", F.lower(F.trim("labeler")))
    return rows.groupBy("example_id", "labeler").agg(F.count("*").alias("n")).where("n > 1")


def refusal_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Refusals among requests with and without errors, by configuration; NULL without any."""
    rows = ledger.latest(table(spark, folder, "metrics", "request_id", "source", "model", "mode", "rerank", "refusal", "error", "ingest_seq"))
    return rows.groupBy("model", "mode", "rerank").agg(F.count("*").alias("n"), judging.rate(F.col("refusal"), ~F.col("error")).alias("refused_sound"), judging.rate(F.col("refusal"), F.col("error")).alias("refused_failed"))


def _run(spark: SparkSession, folder: str) -> DataFrame:
    """The generations of the ledger, each with its judge's entry under the same request."""
    rows = ledger.latest(table(spark, folder, "metrics", "request_id", "source", *judging.CONFIG, "input_tokens", "output_tokens", "cost_usd", "latency_s", "refusal", "ingest_seq")).withColumn("latency_s", ledger.measured())
    rows = rows.withColumns({"provider": ledger.group_column("provider"), "pipeline": ledger.group_column("pipeline")})
    judged = rows.where("source = 'eval.judge'").select("request_id", F.lit(True).alias("judged"), F.col("cost_usd").alias("judge_cost_usd"))
    return rows.where("source = 'eval.generation'").join(judged, "request_id", "left")


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return judging.run_summary(_run(spark, folder))


def run_summary_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """The configurations of hybrid search without a reranker."""
    return judging.of_config(judging.run_summary(_run(spark, folder)), "hybrid", "none")


def eval_set(spark: SparkSession, folder: str) -> DataFrame:
    rows = _golden(spark, folder).where(~F.coalesce("held_out", F.lit(False)) & (F.col("type") != "unanswerable"))
    return rows.groupBy("type", "difficulty").agg(F.count("*").alias("n"))


def stratified(spark: SparkSession, folder: str) -> DataFrame:
    return judging.round_robin(_golden(spark, folder).where("type is not null"), "type", "example_id", 20).select("example_id", "type", "turn")


def _pipelines(spark: SparkSession, folder: str) -> DataFrame:
    rows = ledger.latest(table(spark, folder, "metrics", "request_id", "source", "provider", "pipeline", "input_tokens", "refusal", "ingest_seq"))
    return rows.groupBy(F.lower(F.trim("provider")).alias("provider"), F.coalesce("pipeline", F.lit("vanilla")).alias("pipeline")).agg(F.avg("input_tokens").alias("tokens"), F.avg(F.col("refusal").cast("double")).alias("refusals"))


def report_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Agentic against vanilla for each provider."""
    wide = _pipelines(spark, folder).groupBy("provider").pivot("pipeline", ["vanilla", "agentic"]).agg(F.first("tokens").alias("tokens"), F.first("refusals").alias("refusals"))
    return wide.where("vanilla_tokens is not null and agentic_tokens is not null").select(
        "provider", F.round(F.col("agentic_tokens") - F.col("vanilla_tokens"), 4).alias("tokens"), F.round(F.col("agentic_refusals") - F.col("vanilla_refusals"), 6).alias("refusals")
    )


def report_extremes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pipelines(spark, folder).select("provider", "pipeline", F.round("tokens", 4).alias("tokens"), F.round("refusals", 6).alias("refusals"))
    return judging.extremes(rows, high=("tokens",), low=("refusals",))


def report_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a Markdown table, the least refusals in bold."""
    rows = report_extremes(spark, folder)
    cell = F.format_string("%.4f", "refusals")
    cells = F.concat_ws(" | ", "provider", "pipeline", F.format_string("%.1f", "tokens"), F.when(F.col("refusals_best"), F.concat(F.lit("**"), cell, F.lit("**"))).otherwise(cell))
    return rows.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def sets_union(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of both kinds of pairs, the later table winning where an id is in both."""
    golden = table(spark, folder, "v2", "id").select("id", F.lit(1).alias("priority"))
    calls = table(spark, folder, "canary_defended", "call_id").select(F.col("call_id").alias("id"), F.lit(2).alias("priority"))
    return golden.unionByName(calls).groupBy("id").agg(F.max("priority").alias("priority"))


def sets_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels", "example_id").intersect(table(spark, folder, "v2", "id").withColumnRenamed("id", "example_id"))


def sets_except(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels", "example_id").subtract(table(spark, folder, "v2", "id").withColumnRenamed("id", "example_id"))


def model_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """The longest registered prefix of each request's model: a prefix join and an argmax.

    The registered prefixes are the models themselves and what stands before their last dash.
    """
    models = table(spark, folder, "metrics", "model").where("model is not null").groupBy("model").agg(F.count("*").alias("requests"))
    prefixes = models.select(F.regexp_replace("model", "-[^-]*$", "").alias("prefix")).distinct().select("prefix", F.substring("prefix", 1, 3).alias("head"))
    joined = models.withColumn("head", F.substring("model", 1, 3)).join(prefixes, "head").where(F.expr("startswith(model, prefix)"))
    return joined.groupBy("model", "requests").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def shipments_by_region(spark: SparkSession, folder: str) -> DataFrame:
    """A star join with the filters at the scans; Spark chooses the join by each side's size."""
    line = table(spark, folder, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate").where("l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '1997-01-01'")
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderpriority")
    supplier = table(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user with gaps of at most an hour."""
    rows = table(spark, folder, "events", "user_id", "ts", "value")
    grouped = rows.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select("user_id", F.col("w.start").alias("started"), "n", "value")


QUERIES = {
    f.__name__: f
    for f in (
        ingest_sections, ingest_section_ids, ingest_substantial, ingest_chunks, ingest_manifest, ingest_chunk_ids, ingest_fingerprint, ingest_breadcrumbs, ingest_clean_lines, ingest_segments, missing_chunks, cited_sections,
        judge_summaries, judge_agreement, judge_duplicates, refusal_rates, run_summary, run_summary_hybrid, eval_set, stratified, report_deltas, report_extremes, report_markdown,
        sets_union, sets_intersect, sets_except, model_prefixes, shipments_by_region, sessions,
    )
}

_K = "WITH k AS (SELECT DISTINCT {} FROM chunks)\n"
_LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, source ORDER BY ingest_seq DESC) AS r_ FROM metrics) WHERE r_ = 1)"
_LABELS = "l AS (SELECT example_id, lower(trim(labeler)) AS labeler, " + ", ".join(f"max(CASE WHEN {d} BETWEEN 1 AND 5 THEN {d} END) AS {d}" for d in DIMENSIONS) + " FROM labels GROUP BY 1, 2)"
_GOLDEN = "g AS (SELECT DISTINCT id AS example_id, type, difficulty, held_out FROM v2)"
_PIPES = _LAST + ", p AS (SELECT lower(trim(provider)) AS provider, coalesce(pipeline, 'vanilla') AS pipeline, avg(input_tokens) AS tokens, avg(refusal::INT) AS refusals FROM l GROUP BY ALL)"

_RUN = f"""WITH {_LAST}, x AS (SELECT request_id, source, lower(trim(provider)) AS provider, model, mode, rerank, coalesce(pipeline, 'vanilla') AS pipeline, input_tokens, output_tokens, cost_usd,
  CASE WHEN latency_s >= 0 AND NOT isnan(latency_s) THEN latency_s END AS latency_s, coalesce(refusal, false) AS refusal FROM l),
g AS (SELECT x.*, j.request_id IS NOT NULL AS judged, j.cost_usd AS judge_cost_usd FROM x LEFT JOIN (SELECT * FROM x WHERE source = 'eval.judge') j USING (request_id) WHERE x.source = 'eval.generation'),
o AS (SELECT *, CASE WHEN latency_s IS NOT NULL THEN row_number() OVER (PARTITION BY provider, model, mode, rerank, pipeline, latency_s IS NULL ORDER BY latency_s) END AS i,
  count(latency_s) OVER (PARTITION BY provider, model, mode, rerank, pipeline) AS n FROM g)
"""
_SUMMARY = """SELECT * FROM (SELECT provider, model, mode, rerank, pipeline, count(*) AS items, count(*) FILTER (judged AND NOT refusal) AS judged, count(*) FILTER (refusal) AS refusals,
  count(*) FILTER (NOT judged AND NOT refusal) AS judge_failures, round(avg(latency_s), 9) AS latency_mean, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  CASE WHEN count(*) = count(cost_usd) THEN round(sum(cost_usd), 6) END AS cost_usd,
  CASE WHEN count(*) FILTER (judged AND judge_cost_usd IS NULL) = 0 AND count(*) FILTER (judged) > 0 THEN round(sum(judge_cost_usd), 6) END AS judge_cost_usd,
  median(latency_s) AS latency_p50, max(latency_s) FILTER (i = floor(n * 0.95) + 1) AS latency_p95 FROM o GROUP BY ALL)"""

SQL = {
    "ingest_section_ids": r"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT line FROM l WHERE NOT contains(line, '....') AND regexp_matches(trim(line), '^([A-Z]{2}-\d+|\d+\.\d+|(?i:(govern|map|measure|manage)\s+\d+\.\d+|appendix\s+[a-z]|chapter\s+\d+))') UNION ALL SELECT heading FROM (SELECT DISTINCT chunk_id, heading FROM chunks)),
t AS (SELECT trim(line) AS t FROM h)
SELECT CASE WHEN regexp_matches(t, '^[A-Z]{2}-\d+') THEN regexp_extract(t, '^[A-Z]{2}-\d+(\(\d+\))?')
  WHEN regexp_matches(t, '^(?i:govern|map|measure|manage)\s+\d+\.\d+') THEN regexp_replace(lower(t), '^(\w+)\s+(\d+)\.(\d+).*', '\1-\2-\3')
  WHEN regexp_matches(t, '^\d+\.\d+') THEN regexp_extract(t, '^\d+(\.\d+)+')
  WHEN regexp_matches(t, '^(?i:appendix)\s+[A-Za-z]') THEN 'appendix-' || regexp_extract(lower(t), '^appendix\s+([a-z])', 1)
  WHEN regexp_matches(t, '^(?i:chapter)\s+\d+') THEN 'chapter-' || regexp_extract(lower(t), '^chapter\s+(\d+)', 1) ELSE 'front-matter' END AS section_id, count(*) AS n
FROM t GROUP BY 1""",
    "ingest_manifest": "SELECT doc_id, count(DISTINCT chunk_id) AS chunks, count(DISTINCT section_id) AS sections, max(page_end) + 1 AS pages FROM chunks GROUP BY 1",
    "ingest_chunk_ids": _K.format("chunk_id, doc_id, section_id, char_start")
    + "SELECT chunk_id, ordinal, substr(sha1(concat_ws(':', doc_id, section_id, lpad(ordinal::VARCHAR, 4, '0'))), 1, 16) AS stable_id FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, section_id ORDER BY char_start NULLS FIRST, chunk_id) - 1)::INT AS ordinal FROM k)",
    "ingest_fingerprint": "WITH h AS (SELECT DISTINCT sha256(chunk_id) AS h FROM chunks), s AS (SELECT count(*) AS ids, "
    + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) AS s{i}" for i in range(8))
    + " FROM h) SELECT sha256(concat_ws(',', ids, " + ", ".join(f"s{i}" for i in range(8)) + ")) AS fingerprint, ids FROM s",
    "ingest_breadcrumbs": _K.format("chunk_id, section_path, text")
    + r"SELECT chunk_id, array_to_string(list_slice(string_split(section_path, ' > '), greatest(len(string_split(section_path, ' > ')) - 2, 1), len(string_split(section_path, ' > '))), ' > ') AS path, substring(regexp_replace(text, '[\t\n\x0b\f\r ]+', ' ', 'g'), 1, 200) AS line FROM k",
    "ingest_clean_lines": _K.format("chunk_id, text")
    + r""", l AS (SELECT chunk_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM k),
f AS (SELECT * FROM l WHERE trim(line, ' ') <> '' AND NOT regexp_full_match(trim(line, ' '), '[0-9]+')), w AS (SELECT *, lag(line) OVER (PARTITION BY chunk_id ORDER BY n) AS before FROM f)
SELECT k.chunk_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (line IS DISTINCT FROM before), '') AS clean FROM k LEFT JOIN w USING (chunk_id) GROUP BY 1""",
    "ingest_segments": _K.format("chunk_id, text")
    + ", l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line_no FROM k), s AS (SELECT *, sum(regexp_matches(line, '^[A-Z]{2}-[0-9]+')::INT) OVER (PARTITION BY chunk_id ORDER BY line_no)::BIGINT AS segment FROM l) SELECT chunk_id, segment, min(line_no) AS first, count(*) AS lines FROM s GROUP BY ALL",
    "missing_chunks": "SELECT DISTINCT c.doc, c.section FROM (SELECT unnest(source_citations) AS c FROM v2) WHERE NOT EXISTS (SELECT 1 FROM chunks k WHERE k.doc_id = c.doc AND list_contains(k.section_ids, c.section))",
    "cited_sections": "WITH c AS (SELECT id, unnest(source_citations) AS c, (generate_subscripts(source_citations, 1) - 1)::INT AS n FROM (SELECT DISTINCT id, source_citations FROM v2)) SELECT id, n, count(DISTINCT chunk_id) AS chunks FROM c LEFT JOIN chunks k ON k.doc_id = c.c.doc AND list_contains(k.section_ids, c.c.section) GROUP BY 1, 2",
    "judge_summaries": f"WITH {_LABELS}, {_GOLDEN}, r AS (SELECT l.*, coalesce(difficulty, 'unknown') AS difficulty, coalesce(type, 'unknown') AS type FROM l LEFT JOIN g USING (example_id)) SELECT difficulty, type, grouping(type)::INT AS total, count(*) AS n, count(faithfulness) AS judged, "
    + ", ".join(f"round(avg({d}), 4) AS {d}" for d in DIMENSIONS)
    + " FROM r GROUP BY GROUPING SETS ((difficulty), (difficulty, type))",
    "judge_agreement": f"WITH {_LABELS}, u AS ("
    + " UNION ALL ".join(f"SELECT example_id, labeler, '{d}' AS dimension, {d}::DOUBLE AS s FROM l WHERE {d} IS NOT NULL" for d in DIMENSIONS)
    + "), j AS (SELECT a.labeler, a.dimension, a.s AS a, b.s AS b FROM u a JOIN u b USING (example_id, dimension) WHERE a.labeler <> 'rater-desk' AND b.labeler = 'rater-desk') SELECT labeler, dimension, count(*) AS n, round(CASE WHEN avg(a*a)+avg(b*b)-2*avg(a)*avg(b) > 1e-12 THEN 1 - avg((a-b)**2) / (avg(a*a)+avg(b*b)-2*avg(a)*avg(b)) ELSE 1 END, 6) AS kappa, round(avg((a = b)::INT), 6) AS exact, round(avg(abs(a - b)), 6) AS distance, count(*) FILTER (abs(a - b) >= 2) AS far FROM j GROUP BY ALL",
    "judge_duplicates": "SELECT example_id, lower(trim(labeler)) AS labeler, count(*) AS n FROM labels GROUP BY 1, 2 HAVING count(*) > 1",
    "refusal_rates": f"WITH {_LAST} SELECT model, mode, rerank, count(*) AS n, round(count(*) FILTER (refusal AND NOT error) / nullif(count(*) FILTER (NOT error), 0), 4) AS refused_sound, round(count(*) FILTER (refusal AND error) / nullif(count(*) FILTER (error), 0), 4) AS refused_failed FROM l GROUP BY ALL",
    "run_summary": _RUN + _SUMMARY,
    "run_summary_hybrid": _RUN + _SUMMARY + " WHERE mode = 'hybrid' AND coalesce(rerank, 'none') = 'none'",
    "eval_set": f"WITH {_GOLDEN} SELECT type, difficulty, count(*) AS n FROM g WHERE NOT coalesce(held_out, false) AND type <> 'unanswerable' GROUP BY ALL",
    "stratified": f"WITH {_GOLDEN}, t AS (SELECT example_id, type, row_number() OVER (PARTITION BY type ORDER BY example_id)::INT AS turn FROM g WHERE type IS NOT NULL) SELECT * FROM t ORDER BY turn, type LIMIT 20",
    "report_deltas": f"WITH {_PIPES} SELECT a.provider, round(a.tokens - v.tokens, 4) AS tokens, round(a.refusals - v.refusals, 6) AS refusals FROM p a JOIN p v USING (provider) WHERE a.pipeline = 'agentic' AND v.pipeline = 'vanilla'",
    "report_markdown": f"WITH {_PIPES}, q AS (SELECT provider, pipeline, printf('%.1f', tokens) AS t, printf('%.4f', refusals) AS r, refusals = min(refusals) OVER () AS best FROM (SELECT provider, pipeline, round(tokens, 4) AS tokens, round(refusals, 6) AS refusals FROM p)) SELECT '| ' || concat_ws(' | ', provider, pipeline, t, CASE WHEN best THEN '**' || r || '**' ELSE r END) || ' |' AS line FROM q",
    "report_extremes": f"WITH {_PIPES}, q AS (SELECT provider, pipeline, round(tokens, 4) AS tokens, round(refusals, 6) AS refusals FROM p) SELECT *, tokens = max(tokens) OVER () AS tokens_best, refusals = min(refusals) OVER () AS refusals_best FROM q",
    "sets_union": "SELECT id, max(p)::INT AS priority FROM (SELECT id, 1 AS p FROM v2 UNION ALL SELECT call_id, 2 FROM canary_defended) GROUP BY 1",
    "sets_intersect": "SELECT example_id FROM labels INTERSECT SELECT id FROM v2",
    "sets_except": "SELECT example_id FROM labels EXCEPT SELECT id FROM v2",
    "model_prefixes": "WITH m AS (SELECT model, count(*) AS requests FROM metrics WHERE model IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT regexp_replace(model, '-[^-]*$', '') AS prefix FROM m) SELECT model, requests, arg_max(prefix, len(prefix)) AS prefix FROM m JOIN p ON starts_with(model, prefix) GROUP BY ALL",
    "shipments_by_region": "SELECT r_name, o_orderpriority, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= '1995-01-01' AND l_shipdate < '1997-01-01' GROUP BY ALL",
    "sessions": "WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, s",
}
