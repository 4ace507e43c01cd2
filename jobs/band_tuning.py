"""Tune a two-sided band on measures of texts against labelled rows, and mark every document by it.

The task of threshold tuning on a cohort, for text: a sample is a source, a voxel is a labelled document, and the intensity
is a whole-number measure of its text. For each measure the band [lo, hi] is sought whose Dice with the truth, averaged over
the samples, is largest: from percentile bounds of the positive rows, on cumulative histograms, first on a coarse grid of
edges, then on all edges near the best. The report compares it with the band of the positive rows' 5th and 95th percentiles.

    python -m jobs.band_tuning --documents DIR/documents.parquet --labels DIR/labels.parquet --out OUT [--config FILE]

Writes OUT/samples, by measure: (measure, sample, rows, truth, lo, hi, dice_before, dice_after), Dice in billionths, and
OUT/documents, by measure and lang: (measure, lang, doc_id, value, chosen). Both are overwritten, so that a rerun leaves the same. Scores
are whole numbers, so that sums and ties don't depend on their order. Null text is empty, null lang is 'none'; documents
without a label are marked, not tuned on; a measure without a positive row has no band, and its documents aren't chosen.

The config file's ``sample`` and ``truth`` are SQL on the columns of documents and labels, ``measures`` SQL on text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs import _common
from lumenflow.checkpoints import cut
from lumenflow.operators import search

SAMPLES = "measure string, sample string, rows long, truth long, lo long, hi long, dice_before long, dice_after long"
DOCUMENTS = "measure string, lang string, doc_id long, value long, chosen boolean"


def _values(documents: DataFrame, config: dict) -> DataFrame:
    """(doc_id, lang, sample, measure, value) of all documents: one scan of the texts, stored."""
    texts = documents.withColumn("text", F.coalesce("text", F.lit("")))
    pairs = [F.struct(F.lit(m).alias("measure"), F.expr(e).cast("long").alias("value")) for m, e in config["measures"].items()]
    wide = texts.select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.expr(config["sample"]).alias("sample"), F.array(*pairs).alias("m"))
    return cut(wide.select("doc_id", "lang", "sample", F.explode("m").alias("m")).select("doc_id", "lang", "sample", "m.measure", "m.value"))


def _bounds(counts: DataFrame, bins: int) -> DataFrame:
    """A row per measure: percentiles of its positive rows, and the width of a bin. The window runs over distinct values."""
    run = Window.partitionBy("measure").orderBy("value")
    each = counts.groupBy("measure", "value").agg(F.sum("g").alias("g")).where("g > 0")
    each = each.withColumn("upto", F.sum("g").over(run)).withColumn("all", F.sum("g").over(Window.partitionBy("measure")))
    at = lambda percent, name: F.min(F.when(F.col("upto") * 100 >= F.col("all") * percent, F.col("value"))).alias(name)
    found = each.groupBy("measure").agg(at(1, "low"), at(99, "high"), at(5, "lo_before"), at(95, "hi_before"))
    return found.withColumn("width", F.expr(f"greatest(1, (high - low + {bins}) div {bins})"))


def tune(spark: SparkSession, counts: DataFrame, config: dict) -> DataFrame:
    """A row per measure: lo_before, hi_before, lo, hi. ``counts`` are (measure, sample, value, n, g), stored."""
    bins, step, by = config["bins"], config["coarse"], ["measure", "sample"]
    bounds = cut(_bounds(counts, bins))
    bounded = counts.join(bounds, "measure").where("value between low and high")
    hist = bounded.groupBy(*by, F.expr("cast((value - low) div width as int)").alias("bin")).agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    cum = cut(search.dense_cumulative(spark, hist, by, bins))
    totals = cut(counts.groupBy(*by).agg(F.sum("g").alias("truth")))
    order = Window.partitionBy("measure").orderBy(F.desc("score"), "lo", "hi")

    def best(bands: DataFrame) -> DataFrame:
        scores = search.exact_band_scores(cum, totals, "sample", bands)
        return scores.withColumn("r", F.row_number().over(order)).where("r = 1").select("measure", "lo", "hi")

    upper = F.explode(F.sequence(F.col("lo") + step, F.lit(bins), F.lit(step))).alias("hi")
    grid = bounds.select("measure", F.explode(F.sequence(F.lit(0), F.lit(bins - step), F.lit(step))).alias("lo")).select("measure", "lo", upper)
    around = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - step, F.lit(0)), F.least(F.col(c) + step, F.lit(bins)))).alias(c)
    fine = best(cut(best(grid)).select("measure", around("lo"), "hi").select("measure", "lo", around("hi")).where("lo < hi"))
    return fine.join(bounds, "measure").select("measure", "lo_before", "hi_before", F.expr("low + lo * width").alias("lo"), F.expr("low + hi * width - 1").alias("hi"))


def report(counts: DataFrame, bands: DataFrame) -> DataFrame:
    """A row per measure and sample: its Dice within the band before and after tuning."""
    inside = lambda c, lo, hi: F.sum(F.when(F.col("value").between(F.col(lo), F.col(hi)), F.col(c)).otherwise(0))
    rows = counts.join(F.broadcast(bands), "measure", "left")  # a row per measure of the config
    sums = rows.groupBy("measure", "sample", "lo", "hi").agg(
        F.sum("n").alias("rows"), F.sum("g").alias("truth"),
        inside("n", "lo_before", "hi_before").alias("n0"), inside("g", "lo_before", "hi_before").alias("g0"), inside("n", "lo", "hi").alias("n1"), inside("g", "lo", "hi").alias("g1"),
    )
    return sums.withColumns({"dice_before": search.exact_dice("g0", "n0", "truth"), "dice_after": search.exact_dice("g1", "n1", "truth")})


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict) -> DataFrame:
    """The job; returns what it wrote, read back: rows of both parts with the columns of both."""
    values = _values(_common.read(spark, documents), config)
    marks = _common.read(spark, labels).where("doc_id is not null").select("doc_id", F.coalesce(F.expr(config["truth"]), F.lit(False)).cast("long").alias("g"))
    counts = cut(values.join(marks, "doc_id").groupBy("measure", "sample", "value").agg(F.count("*").alias("n"), F.sum("g").alias("g")))
    bands = cut(tune(spark, counts, config))
    report(counts, bands).select(*_names(SAMPLES)).write.mode("overwrite").partitionBy("measure").parquet(f"{out}/samples")
    marked = values.join(F.broadcast(bands.select("measure", "lo", "hi")), "measure", "left")  # a row per measure of the config
    marked = marked.withColumn("chosen", F.coalesce(F.col("value").between(F.col("lo"), F.col("hi")), F.lit(False)))
    marked.select(*_names(DOCUMENTS)).write.mode("overwrite").partitionBy("measure", "lang").parquet(f"{out}/documents")
    return output(spark, out)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def output(spark: SparkSession, out: str) -> DataFrame:
    """All that the job has written: ``part`` tells samples from documents, columns of the other part are null."""
    samples = _common.wrote(spark, f"{out}/samples", SAMPLES).withColumn("part", F.lit("sample"))
    documents = _common.wrote(spark, f"{out}/documents", DOCUMENTS).withColumn("part", F.lit("document"))
    return samples.unionByName(documents, allowMissingColumns=True)


if __name__ == "__main__":
    raise SystemExit(_common.main("band_tuning", ["documents", "labels", "out"], run))
