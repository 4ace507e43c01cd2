"""Landmark matching: snapping to candidates, patch similarity, confidence, ordering and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.operators import metrics, spatial

#: Order of the confidence levels in reports.
LEVELS = ["high", "medium", "low"]


def confidence(similarity: Column, snapped: Column, least: float = 0.25, high: float = 0.6) -> Column:
    return F.when((similarity >= high) & snapped, "high").when(similarity >= least, "medium").otherwise("low")


def snap(points: DataFrame, candidates: DataFrame, radius: float, id_: str = "id") -> DataFrame:
    """Points moved to their nearest candidate within a radius: (id, x, y, z, snap_dist, snapped); others stay, distance -1."""
    near = spatial.nearest_within(points, candidates, radius, id_, id_)
    c = candidates.select(F.col(id_).alias("right_id"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    p = points.select(F.col(id_).alias("id"), *"xyz").join(near, "id").join(c, "right_id", "left")
    return p.select(
        "id", *[F.coalesce(F.col(f"c{a}"), F.col(a)).alias(a) for a in "xyz"], F.col("dist").alias("snap_dist"), F.col("right_id").isNotNull().alias("snapped")
    )


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Patch similarity of two array columns; patches of different sizes score 0."""
    same = F.size(a) == F.size(b)
    return pairs.withColumn("patch_similarity", F.when(same, metrics.patch_similarity(F.col(a), F.col(b))).otherwise(0.0))


def match_table(rows: DataFrame, top_n: int = 25, least: float = 0.25, high: float = 0.6) -> DataFrame:
    """Labelled matches (LM_000 ..): kept above the least similarity, ordered by confidence, similarity and id.

    The order is taken after the top-n, whose rows are few.
    """
    level = confidence(F.col("patch_similarity"), F.col("snapped"), least, high)
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("confidence"))
    order = [rank, F.desc("patch_similarity"), F.col("id")]
    kept = rows.withColumn("confidence", level).where("confidence <> 'low'").orderBy(*order).limit(top_n)
    return kept.withColumn("label", F.format_string("LM_%03d", (F.row_number().over(Window.orderBy(*order)) - 1)))


def error_summary(matches: DataFrame, column: str = "tre_mm") -> DataFrame:
    return matches.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.percentile(column, F.lit(0.5)).alias("median"), F.percentile(column, F.lit(0.95)).alias("p95"),
        F.max(column).alias("max"),
    )
