"""Scores of judges and raters: summaries by configuration, agreement, stratified selection, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.ledger import any_null_sum
from lodestrand.operators.order_statistics import MEDIAN_HIGH, MEDIAN_LOW, floor_rank, values_at

DIMENSIONS = ("faithfulness", "relevance", "citation_accuracy")


def rate(hit: Column, of: Column) -> Column:
    """The share of rows `of` that also `hit`, to 4 places; NULL if there are none."""
    return F.round(F.try_divide(F.count_if(hit & of), F.count_if(of)), 4)


def valid(column: str) -> Column:
    return F.when(F.col(column).between(1, 5), F.col(column))


def summaries(rows: DataFrame, by: tuple[str, ...], detail: str) -> DataFrame:
    """Mean scores by configuration and, as grouping sets in the same pass, by configuration and `detail`."""
    means = [F.round(F.avg(d), 4).alias(d) for d in DIMENSIONS]
    return rows.groupingSets([[F.col(b) for b in by], [F.col(b) for b in (*by, detail)]], *by, detail).agg(F.grouping(detail).cast("int").alias("total"), F.count("*").alias("n"), F.count_if(F.col("faithfulness").isNotNull()).alias("judged"), *means)


def quadratic_kappa(a: Column, b: Column) -> Column:
    """Quadratic weighted kappa of two columns of scores, as an aggregate: 1 - observed / expected.

    The moments suffice, so no contingency table is built. 1 where nothing but agreement is possible.
    """
    expected = F.avg(a * a) + F.avg(b * b) - 2 * F.avg(a) * F.avg(b)
    observed = F.avg((a - b) * (a - b))
    return F.when(expected > 1e-12, 1 - observed / expected).otherwise(1.0)


def agreement(labels: DataFrame, reference: str) -> DataFrame:
    """Each rater against a reference rater: per dimension n, kappa, exact share, mean distance, far apart."""
    long = labels.select("example_id", "labeler", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), valid(d).alias("score")) for d in DIMENSIONS])).alias("s")).select("example_id", "labeler", "s.*").where("score is not null")
    own, ref = long.where(F.col("labeler") != reference), long.where(F.col("labeler") == reference).select("example_id", "dimension", F.col("score").alias("ref"))
    a, b = F.col("score").cast("double"), F.col("ref").cast("double")
    return own.join(ref, ["example_id", "dimension"]).groupBy("labeler", "dimension").agg(
        F.count("*").alias("n"),
        F.round(quadratic_kappa(a, b), 6).alias("kappa"),
        F.round(F.avg((a == b).cast("double")), 6).alias("exact"),
        F.round(F.avg(F.abs(a - b)), 6).alias("distance"),
        F.count_if(F.abs(a - b) >= 2).alias("far"),
    )


def round_robin(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """`n` rows drawn in turn from the strata, each in its order; the n-th of a stratum needs no more than n of it."""
    placed = rows.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("turn") <= n)
    return placed.orderBy("turn", stratum).limit(n)


CONFIG = ("provider", "model", "mode", "rerank", "pipeline")


def run_summary(rows: DataFrame, by: tuple[str, ...] = CONFIG) -> DataFrame:
    """Measures of each configuration of a run.

    `rows` has the columns `by`, refusal, judged, latency_s, input_tokens, output_tokens, cost_usd
    and judge_cost_usd (of judged rows). A sum of costs is NULL as soon as one cost is; p50 is the
    interpolated median, p95 the value behind floor(0.95 n) others.
    """
    judged, refused = F.coalesce("judged", F.lit(False)), F.coalesce("refusal", F.lit(False))
    unknown = F.count_if(judged & F.col("judge_cost_usd").isNull())
    totals = rows.groupBy(*by).agg(
        F.count("*").alias("items"),
        F.count_if(judged & ~refused).alias("judged"),
        F.count_if(refused).alias("refusals"),
        F.count_if(~judged & ~refused).alias("judge_failures"),
        F.round(F.avg("latency_s"), 9).alias("latency_mean"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(any_null_sum("cost_usd"), 6).alias("cost_usd"),
        F.round(F.when((unknown == 0) & (F.count_if(judged) > 0), F.sum(F.when(judged, F.col("judge_cost_usd")))), 6).alias("judge_cost_usd"),
    )
    ranks = values_at(rows, by, "latency_s", {"low": MEDIAN_LOW, "high": MEDIAN_HIGH, "latency_p95": floor_rank(0.95)})
    same = [totals[c].eqNullSafe(ranks[c]) for c in by]
    return totals.join(ranks, same, "left").select(*[totals[c] for c in totals.columns], ((F.col("low") + F.col("high")) / 2).alias("latency_p50"), "latency_p95")


def of_config(summary: DataFrame, mode: str | None = None, rerank: str | None = None) -> DataFrame:
    """The configurations a report is asked for; a missing rerank counts as none."""
    asked = {"mode": (F.col("mode"), mode), "rerank": (F.coalesce("rerank", F.lit("none")), rerank)}
    for column, wanted in asked.values():
        if wanted is not None:
            summary = summary.where(column == wanted)
    return summary


def labelable(rows: DataFrame, golden: DataFrame, example: str = "example_id") -> DataFrame:
    """Rows worth a label: of a known example, and no refusal."""
    return rows.where(~F.coalesce("refusal", F.lit(False))).join(golden.select(example, "type"), example)


def once(rows: DataFrame, key: str) -> DataFrame:
    """The same rows; a second row for one key fails the job, which a join would multiply."""
    told = F.raise_error(F.concat(F.lit("more than one row for "), F.col(key).cast("string"))).cast("boolean")
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return counted.where(F.when(F.col("_n") > 1, told).otherwise(F.lit(True))).drop("_n")


def extremes(df: DataFrame, high: tuple[str, ...] = (), low: tuple[str, ...] = ()) -> DataFrame:
    """Marks the best of each column, ties included: <column>_best."""
    bounds = df.agg(*[F.max(c).alias(f"_{c}") for c in high], *[F.min(c).alias(f"_{c}") for c in low])
    joined = df.join(F.broadcast(bounds))
    return joined.withColumns({f"{c}_best": F.col(c) == F.col(f"_{c}") for c in (*high, *low)}).drop(*[f"_{c}" for c in (*high, *low)])
