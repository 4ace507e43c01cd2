"""Session factory and table loader."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def get_session(app: str = "lumenflow", **conf: str) -> SparkSession:
    """A session with adaptive execution on; the master comes from spark-submit, or else all local cores."""
    b = SparkSession.builder.appName(app)
    if "MASTER" in os.environ:
        b = b.master(os.environ["MASTER"])
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder. The path stays a URI: only Spark's readers open it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views of the named tables (all by default)."""
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
