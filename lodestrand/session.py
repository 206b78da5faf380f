"""Session factory and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at every scale; sizes of shuffles are left to AQE and the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_SHIPPED: dict[str, str] = {}


def build_session(app: str = "lodestrand", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` wins over them, dots written as `__`."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that they need no install of it."""
    context = spark.sparkContext
    if _SHIPPED.get("application") == context.applicationId:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodestrand-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/lodestrand", "zip", package.parent, package.name))
    _SHIPPED["application"] = context.applicationId


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` where the cluster names one.

    Only a local master may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
    atexit.register(shutil.rmtree, folder[len("file://") :], ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame, *partition_hint: str) -> DataFrame:
    """Write `df` as a table in the shared folder and return a scan of it.

    A lost executor then costs no recomputation, the planner knows the table's size, and each
    reader prunes columns. The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestrand-{uuid.uuid4().hex}"
    writer = df.repartition(*partition_hint) if partition_hint else df
    writer.write.parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """The table goes when the application does: through Hadoop, which closes its file systems then, on any of them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def spread(df: DataFrame) -> DataFrame:
    """`df` in as many even parts as the cluster can work on a few times over.

    For work that costs far more time than its rows have bytes, which AQE would coalesce by bytes.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def drop_cut(df: DataFrame) -> None:
    """Remove the table behind a scan made by `cut_lineage` that nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestrand-" in name:
            remove(df.sparkSession, name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder on any of Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder on any of Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def gathered(df: DataFrame, most_rows: int) -> list | None:
    """The rows of `df` if there are at most `most_rows`, else None: the size check before a broadcast."""
    rows = df.limit(most_rows + 1).collect()
    return rows if len(rows) <= most_rows else None
