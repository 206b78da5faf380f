"""The request ledger: last-write-wins upsert and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.order_statistics import nearest_rank, values_at

KEY = ("request_id", "source")


def group_column(group: str) -> Column:
    columns = {
        "provider": F.lower(F.trim("provider")),
        "model": F.col("model"),
        "source": F.col("source"),
        "pipeline": F.coalesce("pipeline", F.lit("vanilla")),
        "day": F.date_format("ts", "yyyy-MM-dd"),
    }
    if group not in columns:
        raise ValueError(f"group must be one of {sorted(columns)}")
    return columns[group]


def latest(ledger: DataFrame, key: tuple[str, ...] = KEY, order: str = "ingest_seq") -> DataFrame:
    """One row per key, its last write. The aggregate keeps one row per key within each task first.

    Rows of one key and order are settled by their other values, the fuller row first; map
    columns, which can't be compared, by their size.
    """
    rest = [c for c in ledger.columns if c not in key]
    maps = [c for c in rest if ledger.schema[c].dataType.simpleString().startswith("map")]
    ties = [c for c in rest if c != order and c not in maps] + [F.coalesce(F.size(c), F.lit(-1)).alias(c) for c in maps]
    last = ledger.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *ties)).alias("_last"))
    return last.select(*key, *[F.col("_last").getField(c).alias(c) for c in rest])


def measured(seconds: str = "latency_s") -> Column:
    """A latency, or NULL where it is no measurement: NaN or below 0."""
    return F.when((F.col(seconds) >= 0) & ~F.isnan(seconds), F.col(seconds))


def since(ledger: DataFrame, day: str) -> DataFrame:
    """Rows of `day` (YYYY-MM-DD, UTC) and later; reaches the Parquet scan as a pushed filter."""
    return ledger.where(F.col("ts") >= F.to_timestamp(F.lit(day)))


def summary(ledger: DataFrame, group: str = "provider") -> DataFrame:
    """Requests, errors, refusals, tokens, cost and latency percentiles per group.

    A group's cost is NULL only if all its costs are; unmeasured latencies don't count.
    """
    rows = ledger.withColumn("key", group_column(group))
    totals = rows.groupBy("key").agg(
        F.count("*").alias("requests"),
        F.count_if("error").alias("errors"),
        F.count_if("refusal").alias("refusals"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )
    timed = values_at(rows.where("latency_s >= 0"), ("key",), "latency_s", {"p50": nearest_rank(50), "p95": nearest_rank(95)})
    return totals.join(timed.drop("n"), totals["key"].eqNullSafe(timed["key"]), "left").drop(timed["key"]).withColumnRenamed("key", group)


def stage_summary(ledger: DataFrame) -> DataFrame:
    """(stage, n, p50, p95) over the exploded stage timings."""
    stages = ledger.select(F.explode("stages").alias("stage", "seconds")).where(F.col("seconds").isNotNull())
    return values_at(stages, ("stage",), "seconds", {"p50": nearest_rank(50), "p95": nearest_rank(95)})


def stage_total(stages: str = "stages") -> Column:
    return F.aggregate(F.map_values(stages), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def over_limit(events: DataFrame, who: str, ts: str = "ts", window: str = "1 hour", limit: int = 60) -> DataFrame:
    """(who, window_start, n) of the windows in which someone made more than `limit` requests."""
    counted = events.groupBy(who, F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(who, F.col("w.start").alias("window_start"), "n")


def any_null_sum(cost: str) -> Column:
    """A sum that is NULL as soon as one value is."""
    return F.when(F.count_if(F.col(cost).isNull()) == 0, F.sum(cost))


def both_null_sum(left: str, right: str) -> Column:
    """Adds two costs; NULL only if both are."""
    return F.when(F.col(left).isNotNull() | F.col(right).isNotNull(), F.coalesce(left, F.lit(0.0)) + F.coalesce(right, F.lit(0.0)))
