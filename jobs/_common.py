"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def config_of(job: str, path: str | None = None) -> dict:
    """The settings of a job: those of the file beside it, or of another local file."""
    return json.loads(Path(path or Path(__file__).with_name(f"{job}.json")).read_text())


def read(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    log.info("read %s: %d rows", path, df.count())  # from the files' footers
    return df


def wrote(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a job has written, read back."""
    df = spark.read.schema(schema).parquet(path)
    log.info("wrote %s: %d rows", path, df.count())
    return df


def main(job: str, paths: list[str], run: Callable[..., object], argv: list[str] | None = None) -> int:
    """Parse ``--name path`` for each path, start a session, run the job, stop the session."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=sys.modules[run.__module__].__doc__.splitlines()[0])
    for name in paths:
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", help="a JSON file; the default is the one beside the job")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    from lumenflow.session import get_session

    spark = get_session(job)
    try:
        run(spark, *[getattr(args, name) for name in paths], config_of(job, args.config))
    finally:
        spark.stop()
    return 0
