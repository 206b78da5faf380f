"""A table of vectors with its manifest: filled where rows are missing, refused where the model differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from lodestrand.operators.embeddings import checked
from lodestrand.session import exists
from lodestrand.sources.files import append_missing

MANIFEST = "model string, dimensions int"


def manifest(spark: SparkSession, folder: str) -> tuple[str, int] | None:
    """(model, dimensions) of the table in `folder`, None before its first run."""
    if not exists(spark, f"{folder}/manifest"):
        return None
    row = spark.read.schema(MANIFEST).json(f"{folder}/manifest").first()
    return row.model, row.dimensions


def embed_missing(rows: DataFrame, folder: str, vector: Column, model: str, dimensions: int, key: str = "doc", force: bool = False) -> int:
    """Appends the vectors of the rows (key, ...) that the table does not hold yet and tells how many.

    A run that was broken off goes on where it stopped. Another model or number of dimensions
    than the table's is an error, unless `force` starts the table anew.
    """
    spark = rows.sparkSession
    held = manifest(spark, folder)
    if held and held != (model, dimensions) and not force:
        raise ValueError(f"{folder} holds vectors of {held}, not of {(model, dimensions)}")
    if not held or force:
        spark.createDataFrame([(model, dimensions)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return append_missing(rows, f"{folder}/vectors", key, lambda fresh: checked(fresh.select(key, vector.alias("v")), dimensions), anew=force)


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(key, v) as written; the manifest's number of dimensions holds for all."""
    return spark.read.parquet(f"{folder}/vectors")
