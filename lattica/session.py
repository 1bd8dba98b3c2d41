"""Session helpers: table access, shared storage, shipping the package, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lattica")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers once per session, so that no PYTHONPATH is needed there."""
    sc = spark.sparkContext
    if getattr(sc, "_lattica_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="lattica-")) / "lattica_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._lattica_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    own = getattr(sc, "_lattica_shared", None)
    if own is None:
        own = sc._lattica_shared = "file://" + tempfile.mkdtemp(prefix="lattica-shared-")
    return own


def work_dir(spark: SparkSession) -> str:
    """The session's own part of the shared folder. It is deleted by `clean`, or when the driver ends."""
    sc = spark.sparkContext
    if not getattr(sc, "_lattica_work", False):
        sc._lattica_work = True
        atexit.register(clean, spark)
    return f"{shared_dir(spark)}/lattica-{sc.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes the session's written tables. DataFrames that still read them can't be used any more."""
    try:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(work_dir(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives the loss of executors.

    A table is written, rather than DataFrame.checkpoint, because the latter evaluates the last stage twice.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A broadcast hint, given only after counting that df has at most max_rows rows; else df as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def tokenizer_dir() -> str:
    return os.environ.get("LATTICA_TOKENIZERS", "/opt/tokenizers")
