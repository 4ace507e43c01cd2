"""Segmentation, ranking, agreement and loss measures as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hard_dice(v: DataFrame, by: list[str], pred: Column, truth: Column) -> DataFrame:
    p, g = pred.cast("int"), truth.cast("int")
    return v.groupBy(*by).agg((2.0 * F.sum(p * g) / (F.sum(p) + F.sum(g) + F.lit(1e-8))).alias("dice"))


def soft_dice(v: DataFrame, by: list[str], value: Column, truth: Column) -> DataFrame:
    g = truth.cast("double")
    return v.groupBy(*by).agg(((2 * F.sum(value * g) + 1e-5) / (F.sum(value) + F.sum(g) + 1e-5)).alias("soft_dice"))


def centerline_dice(pred: DataFrame, truth: DataFrame, pred_skeleton: DataFrame, truth_skeleton: DataFrame) -> DataFrame:
    """Harmonic mean of the share of each skeleton that lies in the other mask (masks and skeletons are vid tables)."""

    def share(skeleton: DataFrame, mask: DataFrame, name: str) -> DataFrame:
        hit = skeleton.select("vid").distinct().join(mask.select("vid").distinct().withColumn("_in", F.lit(1)), "vid", "left")
        return hit.agg((F.sum(F.coalesce("_in", F.lit(0))) / F.greatest(F.count("*"), F.lit(1))).alias(name))

    both = share(pred_skeleton, truth, "precision").join(F.broadcast(share(truth_skeleton, pred, "sensitivity")))  # one row each
    return both.withColumn("cl_dice", 2 * F.col("precision") * F.col("sensitivity") / (F.col("precision") + F.col("sensitivity") + 1e-8))


def auc(v: DataFrame, by: list[str], score: str, truth: str) -> DataFrame:
    """Area under the ROC curve by average ranks.

    Rows are counted per distinct score first; the running count is taken over scores, so that ties of any number and
    samples of any size need one row per distinct score in the window.
    """
    per = v.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("int")).alias("p"))
    return auc_of_counts(per, by, score)


def auc_of_counts(per: DataFrame, by: list[str], score: str) -> DataFrame:
    """The same from counts: ``per`` holds (by.., score, n, p), rows and positive ones of each distinct score."""
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2.0)
    pos, total = F.sum("p"), F.sum("n")
    # a sample of one class has no area: null
    return ranked.groupBy(*by).agg(
        ((F.sum(F.col("rank") * F.col("p")) - pos * (pos + 1) / 2.0) / F.nullif(pos * (total - pos), F.lit(0))).alias("auc")
    )


def summary(v: DataFrame, by: list[str], value: str) -> DataFrame:
    return v.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.sum(value).alias("total"),
    )


def percentiles(v: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact linear percentiles."""
    return v.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(name) for name, p in at.items()])


def dice_bce_loss(v: DataFrame, by: list[str], prob: str, truth: str, w_dice: float = 0.7, w_bce: float = 0.3) -> DataFrame:
    p, y = F.col(prob), F.col(truth).cast("double")
    q = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    dice = (2 * F.sum(p * y) + 1e-5) / (F.sum(p) + F.sum(y) + 1e-5)
    bce = F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))
    return v.groupBy(*by).agg((w_dice * (1 - dice) + w_bce * bce).alias("loss"))


def consistency_loss(v: DataFrame, by: list[str], prob: str, vessel: str, truth: str, gradient: str, w_mse: float = 0.1, w_break: float = 0.1) -> DataFrame:
    """Dice plus the mean squared difference to the vesselness and the break penalty mean(|grad V| (1 - y))."""
    p, y, s = F.col(prob), F.col(truth).cast("double"), F.col(vessel)
    dice = (2 * F.sum(p * y) + 1e-5) / (F.sum(p) + F.sum(y) + 1e-5)
    return v.groupBy(*by).agg(
        (1 - dice + w_mse * F.avg((p - s) * (p - s)) + w_break * F.avg(F.col(gradient) * (1 - y))).alias("loss")
    )


def soft_gate(x: Column, threshold: float, scale: float) -> Column:
    return 1 / (1 + F.exp(-scale * (x - threshold)))


def patch_similarity(a: Column, b: Column) -> Column:
    """Cosine of two standardised arrays of equal length (population deviation), clipped to [0, 1]; 0 if one is constant."""
    n = F.size(a).cast("double")
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    ma, mb = mean(a), mean(b)
    cross = F.aggregate(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)), F.lit(0.0), lambda s, v: s + v)
    sq = lambda x, m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m))
    norm = F.sqrt(sq(a, ma) * sq(b, mb))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), cross / norm))).otherwise(0.0)


def registration_error(matches: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str]) -> DataFrame:
    return matches.withColumn("tre_mm", F.sqrt(sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b, strict=True)), F.lit(0.0))))
