"""Quality of rankings against cited sections: recall, precision, reciprocal rank and nDCG."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covered(rankings: DataFrame, golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, citation, rank, ...): which ranked chunk covers which citation.

    A chunk covers a citation if it is of the cited publication and one of its sections is cited.
    `golden` has (query_id, citations array<struct<doc, section>>), `chunks` (doc, doc_id, section_ids).
    """
    cited = golden.select("query_id", F.posexplode("citations").alias("citation", "c")).select("query_id", "citation", F.col("c.doc").alias("doc_id"), F.col("c.section").alias("section"))
    placed = rankings.join(chunks.select("doc", "doc_id", "section_ids"), "doc")
    return placed.join(cited, ["query_id", "doc_id"]).where(F.expr("array_contains(section_ids, section)"))


def per_query(rankings: DataFrame, golden: DataFrame, chunks: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Every query of `golden` with its metrics; 0 without a covering chunk or without citations."""
    hits = covered(rankings, golden, chunks)
    found = hits.groupBy("query_id").agg(
        *[F.count_distinct(F.when(F.col("rank") <= c, F.col("citation"))).alias(f"covered_{c}") for c in cuts],
        F.count_distinct(F.when(F.col("rank") <= 5, F.col("rank"))).alias("precise"),
        F.min(F.when(F.col("rank") <= 20, F.col("rank"))).alias("first"),
    )
    # A chunk gains only if it is the first to cover some citation.
    firsts = hits.groupBy("query_id", "citation").agg(F.min("rank").alias("rank")).where("rank <= 10").select("query_id", "rank").distinct()
    gains = firsts.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    n = F.coalesce(F.size("citations"), F.lit(0))
    ideal = F.expr("aggregate(sequence(1, least(n, 10)), 0D, (a, i) -> a + 1 / log2(i + 1))")
    rows = golden.select("query_id", n.alias("n")).join(found, "query_id", "left").join(gains, "query_id", "left")
    share = lambda c: F.when(F.col("n") > 0, F.coalesce(f"covered_{c}", F.lit(0)) / F.col("n")).otherwise(0.0)
    return rows.select(
        "query_id",
        *[share(c).alias(f"recall_{c}") for c in cuts],
        (F.coalesce("precise", F.lit(0)) / 5).alias("precision_5"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("n") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg_10"),
    )


def macro(metrics: DataFrame, by: str | None = None) -> DataFrame:
    names = [c for c in metrics.columns if c not in ("query_id", by)]
    return metrics.groupBy(*([by] if by else [])).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 9).alias(c) for c in names])
