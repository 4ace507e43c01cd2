"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "/tmp/checkpoints/lumenflow"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a local one if Spark runs on one machine, else an error:
    executors and the driver don't share their disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
        if not where:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(LOCAL_DIR)
            where = LOCAL_DIR
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a frame: computed once, read back from the shared folder.

    A checkpointed frame keeps its plan's size estimate, the product of what was joined. In a loop of joins that number
    squares at every step until its own arithmetic takes over the driver, so the rows are taken up as a new relation of
    unknown size; adaptive execution measures what it needs.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a Parquet table of a new name in the shared folder, and read back: where many narrow rows are read
    more than once, it takes a fraction of a checkpoint's disk."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
