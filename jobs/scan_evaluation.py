"""Evaluate scored voxels against their truth for each sample, taking in only files that are new.

The evaluation of a cohort of scans that keeps growing: files of voxels (a sample, a score level, a truth) arrive in a
folder; each run takes the new ones as a stream, once, and the report covers all that has arrived. A voxel is reduced to a
count for its sample and level, so that what is kept grows with samples and levels; size, range, percentiles, area under
the ROC curve and the threshold with the best Dice all follow from these counts, exactly.

    python -m jobs.scan_evaluation --voxels DIR --out OUT --checkpoint CHECKPOINT [--config FILE]

Writes OUT/counts, by batch: (batch, sample, level, n, g), and OUT/report, by sample: (sample, n, truth, low, high, p10,
median, p90, auc, threshold, dice, status), auc in millionths and dice in billionths, both rounded down. A batch that is
tried again overwrites its own partition; the report is made anew from all counts, so that a rerun leaves the same.
Levels are whole numbers. Rows with a null level or sample are left out, a null truth is false. A sample of one class has
no area, one without truth no threshold, and its status says so.

The config file's ``sample``, ``level`` and ``truth`` are SQL on the voxels' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs import _common
from lumenflow.operators import metrics, search

COUNTS = "sample string, level long, n long, g long, batch long"
REPORT = (
    "n long, truth long, low long, high long, p10 long, median long, p90 long, auc long, threshold long, dice long, status string, sample string"
)


def counts_of(voxels: DataFrame, config: dict) -> DataFrame:
    """(sample, level, n, g) of voxels."""
    truth = F.coalesce(F.expr(config["truth"]), F.lit(False)).cast("long")
    rows = voxels.select(F.expr(config["sample"]).cast("string").alias("sample"), F.expr(config["level"]).cast("long").alias("level"), truth.alias("g"))
    return rows.where("sample is not null and level is not null").groupBy("sample", "level").agg(F.count("*").alias("n"), F.sum("g").alias("g"))


def take_new(spark: SparkSession, voxels: str, out: str, checkpoint: str, config: dict) -> int:
    """Counts of the files that no run has taken yet; the number of rows that this run read."""
    schema = spark.read.parquet(voxels).schema
    folder, _, name = voxels.rstrip("/").rpartition("/")
    # as a pattern of one name, since a stream takes a plain path for a folder, and the table may be a file
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{folder or '.'}/{{{name}}}")

    def step(batch: DataFrame, number: int) -> None:
        counted = counts_of(batch, config).withColumn("batch", F.lit(number).cast("long"))
        counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/counts")

    stream = new.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return sum(p["numInputRows"] for p in stream.recentProgress)


def evaluate(counts: DataFrame) -> DataFrame:
    """A row per sample from (sample, level, n, g). Windows run over a sample's levels, not its voxels."""
    per = counts.groupBy("sample", "level").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    own = Window.partitionBy("sample")
    below = own.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    above = own.orderBy("level").rowsBetween(0, Window.unboundedFollowing)
    each = per.select(
        "*", F.sum("n").over(below).alias("upto"), F.sum("n").over(own).alias("all"),
        F.sum("n").over(above).alias("n1"), F.sum("g").over(above).alias("g1"), F.sum("g").over(own).alias("positive"),
    ).withColumn("dice", search.exact_dice("g1", "n1", "positive"))
    at = lambda percent, name: F.min(F.when(F.col("upto") * 100 >= F.col("all") * percent, F.col("level"))).alias(name)
    top = F.max(F.struct("dice", (-F.col("level")).alias("down")))  # equal overlaps go to the lower threshold
    sums = each.groupBy("sample").agg(
        F.sum("n").alias("n"), F.sum("g").alias("truth"), F.min("level").alias("low"), F.max("level").alias("high"), at(10, "p10"), at(50, "median"), at(90, "p90"), top.alias("top")
    )
    area = metrics.auc_of_counts(per.withColumnRenamed("g", "p"), ["sample"], "level").select("sample", F.floor(F.col("auc") * 1_000_000).alias("auc"))
    any_ = F.col("truth") > 0
    status = F.when(~any_, "no truth").when(F.col("truth") == F.col("n"), "truth only").otherwise("ok")
    return sums.join(area, "sample").select(
        "n", "truth", "low", "high", "p10", "median", "p90", "auc", F.when(any_, -F.col("top.down")).alias("threshold"), F.when(any_, F.col("top.dice")).alias("dice"), status.alias("status"), "sample"
    )


def run(spark: SparkSession, voxels: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """The job; returns the report read back."""
    # the folder is there even if no row has arrived
    spark.range(0).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in COUNTS.split(", ")]).write.mode("append").partitionBy("batch").parquet(f"{out}/counts")
    _common.log.info("read %s: %d new rows", voxels, take_new(spark, voxels, out, checkpoint, config))
    counts = _common.wrote(spark, f"{out}/counts", COUNTS)
    evaluate(counts).write.mode("overwrite").partitionBy("sample").parquet(f"{out}/report")
    return _common.wrote(spark, f"{out}/report", REPORT)


if __name__ == "__main__":
    raise SystemExit(_common.main("scan_evaluation", ["voxels", "out", "checkpoint"], run))
