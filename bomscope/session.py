"""Session defaults and durable intermediate storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = 8, app: str = "bomscope") -> SparkSession:
    """Local session for tests and the bench; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Collecting aggregates keep hashing for this many groups before they sort.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "50000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables.

    A cluster names it in `spark.checkpoint.dir`.  Only where that is unset (a local test
    run) is a private folder made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    path = getattr(spark, "_bomscope_dir", None)
    if path is None:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="bomscope-")
        spark._bomscope_dir = path
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of a query that ends in here at once, not when the driver collects its garbage.

    For writes only: what they wrote is read back, and a second run of a plan would have to make its shuffles anew.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise reliably and cut the lineage, so loops and rankings do not recompute."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read back.

    For loops: a checkpoint keeps the size that the planner guessed, and guesses of join after join multiply without
    end; files have their true size.
    """
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
