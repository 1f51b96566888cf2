"""Spark session and table access shared by every part of the library."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own settings."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName("docloom").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; the path stays a Spark path, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one made for a local run; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docloom-", dir=os.environ.get("TMPDIR"))
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that a lost executor costs nothing upstream."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_free(df: DataFrame) -> DataFrame:
    """``cut``, after which the shuffles behind ``df`` are deleted, since nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark = df.sparkSession
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        # A plan takes the setting that holds when it is made.
        return cut(df.select("*"))
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows that hold whole texts are large: at most so many of them travel to Python at a time, or fewer if the session says so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
