"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession, rows: int = 1024, size: int = 16 << 20) -> None:
    """Before Python work on texts or vectors: ship the package, and bound Arrow batches by rows and bytes. The session
    keeps these bounds, as plans are run after this returns; lower ones of its own are left alone."""
    ship_package(spark)
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where it is unset, one of its own in
    local mode alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df's rows as they are now, in files of the shared folder: partitions and their order stay, lost executors or not."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Spark's setting by which an execution deletes its shuffle files at its end, rather than whenever the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run in here deletes its shuffle files at its end."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def settled(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again; what was shuffled for it is deleted at once."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    with without_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
