"""JSON-lines scans with declared schemas, file checks, and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from lodestrand.session import exists

CHUNK = "chunk_id string, doc_id string, section_id string, section_ids array<string>, section_path string, heading string, page_start int, page_end int, char_start int, char_end int, token_count int, content_type string, text string"
GOLDEN = "id string, question string, reference_answer string, source_citations array<struct<doc:string,section:string>>, difficulty string, type string, held_out boolean"
LABEL = "example_id string, labeler string, faithfulness int, relevance int, citation_accuracy int, notes string"
CALL = "request struct<messages:array<struct<role:string,content:string>>,model:string,max_tokens:int,temperature:double>, response struct<text:string,model:string,stop_reason:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cost_usd:double>>"


def json_lines(spark: SparkSession, paths: str | list[str], schema: str, required: tuple[str, ...] = (), reject: bool = False) -> DataFrame:
    """Rows of JSON-lines files with exactly `schema`; unknown keys are ignored, blank lines skipped.

    Lines that don't parse or lack a required key come out in `_bad`, or fail the scan with `reject`.
    """
    declared = StructType.fromDDL(schema)
    rows = spark.read.schema(StructType([*declared, StructField("_bad", StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(paths)
    lacking = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda c: c.isNotNull()), ", ") if required else F.lit("")
    rows = rows.withColumn("_bad", F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(F.length(lacking) > 0, F.concat(F.lit("missing: "), lacking)))
    if reject:
        checked = F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("bad row: "), F.col("_bad"))).cast("string"))
        rows = rows.withColumn("_bad", checked).where("_bad is null").drop("_bad")
    return rows


def golden(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Golden examples; held_out counts as false where it is left out."""
    rows = json_lines(spark, paths, GOLDEN, ("id", "question", "type"), reject=True)
    return rows.withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def result_rows(spark: SparkSession, folder: str | list[str], schema: str) -> DataFrame:
    """Rows of all result files of a folder but rejudged ones."""
    rows = json_lines(spark, folder, schema).withColumn("_file", F.input_file_name())
    return rows.where(~F.col("_file").contains(".rejudge")).drop("_file")


def verified_files(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256, verified) of each file against (name, sha256); NULL where none is expected."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.join(expected.withColumnRenamed("sha256", "want"), "name", "left").select("path", "size_bytes", "sha256", (F.col("sha256") == F.col("want")).alias("verified"))


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """Chunks as JSON lines in the fixed order of fields."""
    chunks.select(*[f.name for f in StructType.fromDDL(CHUNK)]).write.mode("overwrite").json(folder)


def write_audit(audit: DataFrame, folder: str) -> None:
    """Audit lines by the day of their own time; fields may only be added behind the schema mark."""
    audit.select(F.lit("audit_v1").alias("schema"), "*", F.date_format("ts", "yyyyMMdd").alias("day")).write.mode("append").partitionBy("day").json(folder)


def append_missing(rows: DataFrame, folder: str, key: str, then: Callable[[DataFrame], DataFrame] = lambda x: x, anew: bool = False) -> int:
    """Appends the rows whose key the table does not hold yet and tells how many; a run can be resumed.

    `then` works on the missing rows only. The rows are worked out once and counted as they are written.
    """
    spark = rows.sparkSession
    fresh = rows
    if not anew and exists(spark, folder):
        fresh = rows.join(spark.read.parquet(folder).select(key).distinct(), key, "left_anti")
    seen = Observation()
    then(fresh).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite" if anew else "append").parquet(folder)
    return seen.get["n"]
