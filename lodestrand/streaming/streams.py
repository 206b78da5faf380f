"""The ledger, its daily summary, rate limits and the audit log as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestrand.operators import guardrails, ledger
from lodestrand.session import exists, remove


def stream(spark: SparkSession, folder: str, schema: StructType, names: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files of a folder that match `names`, as they arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def daily_counts(rows: DataFrame, ts: str = "ts", late: str = "7 days", *by: str) -> DataFrame:
    """Rows and values per day; a day is final once the watermark has passed it."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), *by, "n")


def rate_limited(rows: DataFrame, who: str, ts: str = "ts", window: str = "1 minute", limit: int = 60, late: str = "10 minutes") -> DataFrame:
    return ledger.over_limit(rows.withWatermark(ts, late), who, ts, window, limit)


def upsert(rows: DataFrame, folder: str, checkpoint: str, key: tuple[str, ...] = ledger.KEY, order: str = "ingest_seq", buckets: int = 16) -> StreamingQuery:
    """Keeps a table of last writes: each batch replaces only the partitions whose keys it touches.

    A batch that runs again after a failure gives the same table, as the last write wins either way.
    `buckets` should grow with the table, so that a partition stays within a task's reach.
    """
    spark = rows.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r.part for r in new.select("part").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        if exists(spark, folder):  # the first batch finds no table
            new = new.unionByName(spark.read.parquet(folder).where(F.col("part").isin(touched)).select(*new.columns))
        merged = ledger.latest(new, key, order).select(*new.columns)
        # Written beside the table first: the partitions read are the ones replaced.
        staged = f"{folder}.staged-{number}"
        merged.write.mode("overwrite").parquet(staged)
        spark.read.schema(merged.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)
        remove(spark, staged)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_log(rows: DataFrame, folder: str, checkpoint: str, text: str = "text", ts: str = "ts") -> StreamingQuery:
    """Scans texts as they arrive and appends audit lines without texts or spans, a folder per day."""
    acted = guardrails.with_actions(guardrails.scanned(rows, text), F.lit("input"))
    lines = acted.select(F.lit("audit_v1").alias("schema"), ts, F.sha2(text, 256).alias("query_hash"), guardrails.privacy_projection().alias("detections"), F.exists("applied", lambda x: x["action"] == "block").alias("blocked"), F.date_format(ts, "yyyyMMdd").alias("day"))
    return lines.writeStream.format("json").partitionBy("day").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(query: StreamingQuery) -> None:
    """Waits until all that is there has been processed; raises what the query failed with."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
