"""Queries over the request ledger (metrics) and the event stream's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import ledger
from lodestrand.operators.order_statistics import MEDIAN_HIGH, MEDIAN_LOW, even_rank, floor_rank, values_at
from lodestrand.sources.tables import table

NUMBERS = ("request_id", "source", "ts", "provider", "model", "pipeline", "input_tokens", "output_tokens", "cost_usd", "latency_s", "refusal", "error", "ingest_seq")


def _latest(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Each key's last write; a latency that is no measurement is NULL."""
    return ledger.latest(table(spark, folder, "metrics", *NUMBERS, *more)).withColumn("latency_s", ledger.measured())


def _summary(group: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return ledger.summary(_latest(spark, folder), group)

    return query


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(spark, folder)


def summary_since(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.summary(ledger.since(_latest(spark, folder), "2026-02-01"), "provider")


def stage_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.stage_summary(_latest(spark, folder, "stages"))


def stage_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = _latest(spark, folder, "stages")
    return rows.select("request_id", "source", F.round(ledger.stage_total(), 6).alias("total_s"), F.size(F.map_filter("stages", lambda k, _: k != "guard")).alias("stages_but_guard"))


def latency_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """The three definitions of a 95th percentile and the interpolated median, side by side."""
    rows = _latest(spark, folder).where("latency_s is not null").withColumn("model", F.coalesce("model", F.lit("?")))
    found = values_at(rows, ("model",), "latency_s", {"low": MEDIAN_LOW, "high": MEDIAN_HIGH, "p95_floor": floor_rank(0.95), "p95_even": even_rank(95)})
    means = rows.groupBy("model").agg(F.round(F.avg("latency_s"), 6).alias("mean"))
    return found.join(means, "model").select("model", "n", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95_floor", "p95_even")


def cost_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A group's cost under both rules for unknown costs: NULL if all are, NULL if any is."""
    return _latest(spark, folder).groupBy("model", "source").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost_if_any"), F.round(ledger.any_null_sum("cost_usd"), 6).alias("cost_if_all"))


def both_null_cost(spark: SparkSession, folder: str) -> DataFrame:
    """A request's cost under its two sources generation and judge added up."""
    rows = _latest(spark, folder)
    generated = rows.where("source = 'eval.generation'").select("request_id", F.col("cost_usd").alias("generation"))
    judged = rows.where("source = 'eval.judge'").select("request_id", F.col("cost_usd").alias("judge"))
    return generated.join(judged, "request_id").select("request_id", F.round(ledger.both_null_sum("generation", "judge"), 6).alias("cost_usd"))


def refusal_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(spark, folder, "refusal_reason").where("refusal").groupBy("refusal_reason").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.over_limit(table(spark, folder, "events", "user_id", "ts"), "user_id", window="1 day", limit=3)


def load_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _latest(spark, folder).where("latency_s is not null and source = 'api'")
    return rows.agg(F.count("*").alias("n"), F.round(F.min("latency_s"), 4).alias("least"), F.round(F.max("latency_s"), 4).alias("most"), F.round(F.avg("latency_s"), 4).alias("mean"), (F.count_distinct("request_id") == F.count("*")).alias("unique_ids"), F.bool_and(~F.col("error")).alias("all_well"))


LATEST = """
WITH m AS (SELECT *, row_number() OVER (PARTITION BY request_id, source ORDER BY ingest_seq DESC, ts DESC NULLS LAST, provider DESC NULLS LAST, model DESC NULLS LAST,
  pipeline DESC NULLS LAST, input_tokens DESC NULLS LAST, output_tokens DESC NULLS LAST, cost_usd DESC NULLS LAST, latency_s DESC NULLS LAST, refusal DESC NULLS LAST,
  error DESC NULLS LAST, refusal_reason DESC NULLS LAST, coalesce(cardinality(stages), -1) DESC) AS r_ FROM metrics),
l AS (SELECT * EXCLUDE (r_) REPLACE (CASE WHEN latency_s >= 0 AND NOT isnan(latency_s) THEN latency_s END AS latency_s) FROM m WHERE r_ = 1)
"""


def _summary_sql(name: str, key: str, where: str = "TRUE") -> str:
    return (
        LATEST
        + f""", k AS (SELECT *, {key} AS k FROM l WHERE {where}),
t AS (SELECT k, count(*) AS requests, count(*) FILTER (error) AS errors, count(*) FILTER (refusal) AS refusals, sum(input_tokens)::BIGINT AS input_tokens,
      sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd), 6) AS cost_usd FROM k GROUP BY 1),
o AS (SELECT k, latency_s, row_number() OVER (PARTITION BY k ORDER BY latency_s) AS i, count(*) OVER (PARTITION BY k) AS n FROM k WHERE latency_s >= 0 AND NOT isnan(latency_s)),
p AS (SELECT k, max(latency_s) FILTER (i = greatest(floor(0.5 * n + 0.5), 1)) AS p50, max(latency_s) FILTER (i = greatest(floor(0.95 * n + 0.5), 1)) AS p95 FROM o GROUP BY 1)
SELECT t.k AS {name}, t.* EXCLUDE (k), p50, p95 FROM t LEFT JOIN p ON t.k IS NOT DISTINCT FROM p.k
"""
    )


KEYS_SQL = {"provider": "lower(trim(provider))", "model": "model", "source": "source", "pipeline": "coalesce(pipeline, 'vanilla')", "day": "strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d')"}

QUERIES = {
    **{f"ledger_summary_{g}": _summary(g) for g in KEYS_SQL},
    "ledger_upsert_latest": upsert_latest,
    "ledger_summary_since": summary_since,
    "ledger_stage_summary": stage_summary,
    "ledger_stage_totals": stage_totals,
    "ledger_latency_definitions": latency_definitions,
    "ledger_cost_rules": cost_rules,
    "ledger_both_null_cost": both_null_cost,
    "ledger_refusal_reasons": refusal_reasons,
    "ledger_rate_limit": rate_limit,
    "ledger_load_summary": load_summary,
}

SQL = {
    **{f"ledger_summary_{g}": _summary_sql(g, k) for g, k in KEYS_SQL.items()},
    "ledger_upsert_latest": LATEST + "SELECT " + ", ".join(NUMBERS).replace("ts,", "ts AT TIME ZONE 'UTC' AS ts,") + " FROM l",
    "ledger_summary_since": _summary_sql("provider", KEYS_SQL["provider"], "ts >= TIMESTAMPTZ '2026-02-01 00:00:00+00'"),
    "ledger_stage_summary": LATEST
    + """, s AS (SELECT unnest(map_keys(stages)) AS stage, unnest(map_values(stages)) AS v FROM l),
o AS (SELECT stage, v, row_number() OVER (PARTITION BY stage ORDER BY v) AS i, count(*) OVER (PARTITION BY stage) AS n FROM s WHERE v IS NOT NULL AND NOT isnan(v))
SELECT stage, max(n) AS n, max(v) FILTER (i = greatest(floor(0.5 * n + 0.5), 1)) AS p50, max(v) FILTER (i = greatest(floor(0.95 * n + 0.5), 1)) AS p95 FROM o GROUP BY 1""",
    "ledger_stage_totals": LATEST
    + """SELECT request_id, source, CASE WHEN stages IS NULL THEN NULL ELSE round(coalesce(list_sum(map_values(stages)), 0), 6) END AS total_s,
CASE WHEN stages IS NULL THEN NULL ELSE len(list_filter(map_keys(stages), lambda k: k <> 'guard')) END::INT AS stages_but_guard FROM l""",
    "ledger_latency_definitions": LATEST
    + """, o AS (SELECT coalesce(model, '?') AS model, latency_s AS v, row_number() OVER (PARTITION BY coalesce(model, '?') ORDER BY latency_s) AS i, count(*) OVER (PARTITION BY coalesce(model, '?')) AS n
  FROM l WHERE latency_s >= 0 AND NOT isnan(latency_s))
SELECT model, max(n) AS n, round(avg(v), 6) AS mean, median(v) AS median, max(v) FILTER (i = floor(n * 0.95) + 1) AS p95_floor,
  max(v) FILTER (i = greatest(least(round_even(0.95 * n, 0), n), 1)) AS p95_even FROM o GROUP BY 1""",
    "ledger_cost_rules": LATEST
    + """SELECT model, source, count(*) AS n, round(sum(cost_usd), 6) AS cost_if_any, CASE WHEN count(*) = count(cost_usd) THEN round(sum(cost_usd), 6) END AS cost_if_all FROM l GROUP BY ALL""",
    "ledger_both_null_cost": LATEST
    + """SELECT g.request_id, round(CASE WHEN g.cost_usd IS NOT NULL OR j.cost_usd IS NOT NULL THEN coalesce(g.cost_usd, 0) + coalesce(j.cost_usd, 0) END, 6) AS cost_usd
FROM l g JOIN l j USING (request_id) WHERE g.source = 'eval.generation' AND j.source = 'eval.judge'""",
    "ledger_refusal_reasons": LATEST + "SELECT refusal_reason, count(*) AS n, count(DISTINCT source) AS sources FROM l WHERE refusal GROUP BY 1",
    "ledger_rate_limit": "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 3",
    "ledger_load_summary": LATEST
    + """SELECT count(*) AS n, round(min(latency_s), 4) AS least, round(max(latency_s), 4) AS most, round(avg(latency_s), 4) AS mean, count(DISTINCT request_id) = count(*) AS unique_ids, bool_and(NOT error) AS all_well
FROM l WHERE latency_s >= 0 AND NOT isnan(latency_s) AND source = 'api'""",
}
