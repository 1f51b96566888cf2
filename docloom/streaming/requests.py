"""Requests as a stream: one per idempotency key within a watermark. An extension; state lives in Spark's state store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import shared_folder


def once_per_key(requests: DataFrame, keys: list[str], time_col: str = "ts", late: str = "7 days") -> DataFrame:
    """Repeats of a key are dropped for as long as the watermark keeps the first; its state expires by itself then."""
    return requests.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def run_once(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Runs the stream over the files that are there now and returns what it wrote."""
    schema = spark.read.parquet(path).schema
    # A file source lists a folder: the table's own, or the one that holds it as a single file.
    first = spark.read.parquet(path).select("_metadata.file_path").first()
    folder, _, name = path.rstrip("/").rpartition("/")
    single = first is not None and first[0].rsplit("/", 1)[-1] == name
    out = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", name if single else "*.parquet").parquet(folder if single else path)
    rows = source.withColumn("ts", F.col("ts").cast("timestamp"))
    query = once_per_key(rows, keys).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
