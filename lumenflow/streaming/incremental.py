"""Incremental runs: new manifest files are picked up as a stream and processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def manifest_stream(spark: SparkSession, folder: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of the manifests that arrive in a folder."""
    return spark.readStream.schema(schema).option("header", header).csv(folder)


def run_new(rows: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Process each arriving row whose key has no output yet, append the results, and stop when all is read.

    A batch that is tried again after a failure finds its own output and skips it.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(out).select(key).distinct()
            batch = batch.join(done, key, "left_anti")
        except Exception as e:  # noqa: BLE001 - the first batch has no output to read
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        process(batch.dropDuplicates([key])).write.mode("append").parquet(out)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_counts(rows: DataFrame, at: str, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Finished and failed samples per window of time, as a stream: late rows count up to the watermark."""
    failed = F.col("status").startswith("ERROR")
    return rows.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"))
