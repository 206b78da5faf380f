"""The streams run over the given tables to their end, as batch queries see them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import ledger
from lodestrand.plans.ledger import LATEST
from lodestrand.session import shared_folder
from lodestrand.sources.tables import table
from lodestrand.streaming import streams


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table's files as a stream; a table that is one file is picked out of its folder by name."""
    now = table(spark, folder, name)
    one_file = any(f.endswith(f"/{name}.parquet") for f in now.inputFiles())
    return streams.stream(spark, folder if one_file else f"{folder}/{name}.parquet", now.schema, f"{name}.parquet" if one_file else "*.parquet")


def _run(df: DataFrame, spark: SparkSession, *keys: str) -> DataFrame:
    """The result of a streaming aggregation over all that is there: each key's row in the last batch that changed it.

    In update mode a batch passes on what changed, and the watermark drops the state of days that are final.
    """
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")  # the same folder if the batch runs again

    streams.drained(df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start())
    rows = spark.read.parquet(f"{path}/out")
    rest = [c for c in df.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *[F.col("last").getField(c).alias(c) for c in rest])


def stream_daily_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stream(spark, folder, "metrics").select("ts", F.lower(F.trim("provider")).alias("provider"))
    return _run(streams.daily_counts(rows, "ts", "70 days", "provider"), spark, "day", "provider")


def stream_upsert_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The table of last writes that the stream leaves."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = _stream(spark, folder, "metrics").select("request_id", "source", "provider", "model", "latency_s", "cost_usd", "ingest_seq")
    streams.drained(streams.upsert(rows, f"{path}/table", f"{path}/log"))
    return spark.read.parquet(f"{path}/table").drop("part").withColumn("latency_s", ledger.measured())


def stream_rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stream(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _run(streams.rate_limited(rows, "user_id", window="1 day", limit=3, late="400 days"), spark, "user_id", "window_start")


def stream_audit_log(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = _stream(spark, folder, "documents").select(F.col("ingested_at").alias("ts"), "text").where("ts is not null and text is not null")
    streams.drained(streams.audit_log(rows, f"{path}/audit", f"{path}/log"))
    lines = spark.read.schema("schema string, ts timestamp, query_hash string, blocked boolean, day string").json(f"{path}/audit")
    return lines.groupBy("day").agg(F.count("*").alias("lines"), F.count_distinct("query_hash").alias("texts"))


QUERIES = {f.__name__: f for f in (stream_daily_ledger, stream_upsert_ledger, stream_rate_limit, stream_audit_log)}

SQL = {
    "stream_daily_ledger": "SELECT date_trunc('day', ts AT TIME ZONE 'UTC') AS day, lower(trim(provider)) AS provider, count(*) AS n FROM metrics GROUP BY 1, 2",
    "stream_upsert_ledger": LATEST + "SELECT request_id, source, provider, model, latency_s, cost_usd, ingest_seq FROM l",
    "stream_rate_limit": "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 3",
    "stream_audit_log": "SELECT strftime(ingested_at AT TIME ZONE 'UTC', '%Y%m%d') AS day, count(*) AS lines, count(DISTINCT text) AS texts FROM documents WHERE ingested_at IS NOT NULL AND text IS NOT NULL GROUP BY 1",
}
