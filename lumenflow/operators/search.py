"""Threshold search on histograms and parameter sweeps."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut


def histogram(v: DataFrame, by: list[str], value: str, low: float, high: float, bins: int, truth: str | None = None) -> DataFrame:
    """Counts per bin [e, e + width), the last one closed: (by.., bin, n[, g]); ``g`` counts rows where ``truth`` holds.

    All rows are reduced to bins on the map side; what is shuffled grows with bins, not with voxels.
    """
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    rows = v.where(F.col(value).between(low, high)).withColumn("bin", b)
    aggs = [F.count("*").alias("n")] + ([F.sum(F.col(truth).cast("int")).cast("long").alias("g")] if truth else [])
    return rows.groupBy(*by, "bin").agg(*aggs)


def cumulative(hist: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Running sums over bins; a bin's own counts included. The window runs over bins, not over voxels."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select(*by, "bin", *[F.sum(c).over(w).cast("long").alias(f"c{c}") for c in columns])


def dense_cumulative(spark: SparkSession, hist: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Cumulative counts at all edges 0..bins: (by.., edge, cn, cg), the counts of bins below the edge."""
    groups = hist.select(*by).distinct()
    edges = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("edge"))
    h = hist.withColumn("edge", F.col("bin") + 1)
    w = Window.partitionBy(*by).orderBy("edge").rowsBetween(Window.unboundedPreceding, 0)
    full = edges.join(h, [*by, "edge"], "left")
    return full.select(*by, "edge", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).cast("long").alias(f"c{c}") for c in ("n", "g")])


def band_scores(cum: DataFrame, totals: DataFrame, by: list[str], grid: DataFrame) -> DataFrame:
    """Mean overlap of each band (lo, hi) of edges over the samples: two equi joins on cumulative counts, so that a band
    costs two lookups whatever the number of voxels."""
    lo = cum.select(*by, F.col("edge").alias("lo"), F.col("cn").alias("n0"), F.col("cg").alias("g0"))
    hi = cum.select(*by, F.col("edge").alias("hi"), F.col("cn").alias("n1"), F.col("cg").alias("g1"))
    pairs = grid.join(lo, "lo").join(hi, ["hi", *by]).join(totals, by)
    dice = 2.0 * (F.col("g1") - F.col("g0")) / ((F.col("n1") - F.col("n0")) + F.col("truth") + F.lit(1e-8))
    return pairs.groupBy("lo", "hi").agg(F.avg(dice).alias("mean_dice"))


def exact_dice(both: str, pred: str, truth: str) -> Column:
    """Overlap of counts in billionths, rounded down: a whole number, so that sums over samples don't depend on their order."""
    return F.expr(f"(2000000000BD * {both}) div greatest(1, {pred} + {truth})")


def exact_band_scores(cum: DataFrame, totals: DataFrame, sample: str, bands: DataFrame) -> DataFrame:
    """Summed overlap over the samples of each band, in billionths: ``bands`` are (group.., lo, hi), the columns of ``bands`` but the
    edges name the groups; ``cum`` are (group.., sample, edge, cn, cg), ``totals`` (group.., sample, truth)."""
    group = [c for c in bands.columns if c not in ("lo", "hi")]
    by = [*group, sample]
    lo = cum.select(*by, F.col("edge").alias("lo"), F.col("cn").alias("n0"), F.col("cg").alias("g0"))
    hi = cum.select(*by, F.col("edge").alias("hi"), F.col("cn").alias("n1"), F.col("cg").alias("g1"))
    pairs = bands.join(lo, [*group, "lo"]).join(hi, [*by, "hi"]).join(totals, by)
    each = pairs.select(*group, "lo", "hi", exact_dice("(g1 - g0)", "(n1 - n0)", "truth").alias("score"))
    return each.groupBy(*group, "lo", "hi").agg(F.sum("score").alias("score"))


def upper_triangle(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n + 1).select(F.col("id").cast("int").alias("lo")).select("lo", F.explode(F.sequence(F.col("lo") + 1, F.lit(n + 1))).alias("hi")).where(F.col("hi") <= n)


def band_search(spark: SparkSession, v: DataFrame, by: list[str], value: str, truth: str, low: float, high: float, bins: int) -> DataFrame:
    """All bands of the grid with their mean overlap."""
    hist = histogram(v, by, value, low, high, bins, truth)
    totals = v.groupBy(*by).agg(F.sum(F.col(truth).cast("int")).cast("long").alias("truth"))
    return band_scores(dense_cumulative(spark, hist, by, bins), totals, by, upper_triangle(spark, bins))


def linspace(low: float, high: float, n: int) -> list[float]:
    return [low + i * ((high - low) / (n - 1)) for i in range(n)]


def band_dice(cum: DataFrame, totals: DataFrame, by: list[str], bands: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Mean overlap of bands of values (lo, hi) on a fine histogram's cumulative counts: both end bins count whole."""
    width = (high - low) / bins
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(c) - low) / width))).cast("int")
    edges = bands.withColumn("_a", at("lo")).withColumn("_b", at("hi") + 1)
    lo = cum.select(*by, F.col("edge").alias("_a"), F.col("cn").alias("n0"), F.col("cg").alias("g0"))
    hi = cum.select(*by, F.col("edge").alias("_b"), F.col("cn").alias("n1"), F.col("cg").alias("g1"))
    pairs = edges.join(lo, "_a").join(hi, ["_b", *by]).join(totals, by)
    dice = 2.0 * (F.col("g1") - F.col("g0")) / ((F.col("n1") - F.col("n0")) + F.col("truth") + F.lit(1e-8))
    return pairs.groupBy("lo", "hi").agg(F.avg(dice).alias("mean_dice"))


def two_level_band_search(v: DataFrame, by: list[str], value: str, truth: str, low: float, high: float, bins: int = 2000, grid: int = 60, fine: int = 50) -> DataFrame:
    """The best band of a coarse grid, and of a fine one within two coarse steps of its ends: rows (level, lo, hi, mean_dice). One
    pass over the voxels serves both. Equal bands go to the smaller upper end, then the smaller lower one."""
    spark = v.sparkSession
    cum = cut(dense_cumulative(spark, histogram(v, by, value, low, high, bins, truth), by, bins))
    totals = cut(v.groupBy(*by).agg(F.sum(F.col(truth).cast("int")).cast("long").alias("truth")))
    place = linspace(low, high, grid)
    coarse = spark.createDataFrame([(a, b) for i, a in enumerate(place) for b in place[i + 1 :]], "lo double, hi double")
    top = best(band_dice(cum, totals, by, coarse, low, high, bins), "mean_dice", "hi", "lo").first()
    if top is None:
        return spark.createDataFrame([], "level string, lo double, hi double, mean_dice double")
    reach = 2 * (place[1] - place[0])
    los = [max(x, low) for x in linspace(top["lo"] - reach, top["lo"] + reach, fine)]
    his = [min(x, high) for x in linspace(top["hi"] - reach, top["hi"] + reach, fine)]
    near = spark.createDataFrame(sorted({(a, b) for a in los for b in his if b > a}), "lo double, hi double")
    found = best(band_dice(cum, totals, by, near, low, high, bins), "mean_dice", "hi", "lo").first()
    return spark.createDataFrame([("coarse", *top), ("fine", *found)], "level string, lo double, hi double, mean_dice double")


def scale_sweep(scores: DataFrame, by: list[str], voxel: list[str], sweeps: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """Mean soft overlap for each number of scales: ``sweeps`` (n, scale), a parameter table, lists the scales of each n, ``scores``
    holds (by.., voxel.., scale, score, truth). A voxel's score is the largest over the scales, of repeated rows too: (n,
    mean_dice). A voxel is one row with a maximum for each n, whatever the number of sweeps."""
    scales: dict[int, list] = {}
    for n, scale in sorted(tuple(r) for r in sweeps.select("n", "scale").collect()):
        scales.setdefault(n, []).append(scale)
    tops = []
    for m, each in enumerate(scales.values()):
        within = F.col("scale").isin(each)
        tops += [F.max(F.when(within, F.col(score))).alias(f"_s{m}"), F.max(F.when(within, F.col(truth))).cast("double").alias(f"_t{m}"), F.max(F.when(within, 1)).alias(f"_o{m}")]
    held = scores.where(F.col("scale").isin(sorted({x for each in scales.values() for x in each})))
    top = held.groupBy(*by, *voxel).agg(*tops)
    sums = top.groupBy(*by).agg(*[x for m in range(len(scales)) for x in (F.sum(F.col(f"_s{m}") * F.col(f"_t{m}")).alias(f"_st{m}"), F.sum(f"_s{m}").alias(f"_ss{m}"), F.sum(f"_t{m}").alias(f"_tt{m}"), F.max(f"_o{m}").alias(f"_o{m}"))])
    dice = [F.struct(F.lit(n).alias("n"), F.col(f"_o{m}").alias("o"), ((2 * F.col(f"_st{m}") + 1e-8) / (F.col(f"_ss{m}") + F.col(f"_tt{m}") + 1e-8)).alias("d")) for m, n in enumerate(scales)]
    return sums.select(F.explode(F.array(*dice)).alias("e")).select("e.*").where("o = 1").groupBy("n").agg(F.avg("d").alias("mean_dice"))


def coordinate_search(evaluate: Callable[[list[dict]], list[float]], grid: dict[str, list], start: dict | None = None, rounds: int = 1) -> tuple[dict, float, list[tuple[dict, float]]]:
    """Best parameters by changing one at a time, in the order of ``grid``, to the value with the largest result: (parameters,
    value, trials). ``evaluate`` gets all values of a parameter at once, so that they can share one Spark job; equal results
    keep what was there before, then the first."""
    at = {k: v[0] for k, v in grid.items()} | (start or {})
    top = evaluate([dict(at)])[0]
    trials = [(dict(at), top)]
    for _ in range(rounds):
        before = dict(at)
        for name, values in grid.items():
            asked = [at | {name: x} for x in values if x != at[name]]
            for trial, v in zip(asked, evaluate(asked) if asked else [], strict=True):
                trials.append((trial, v))
                if v > top:
                    at, top = trial, v
        if at == before:
            break
    return at, top, trials


def overlaps(v: DataFrame, by: list[str], candidates: list[dict], score: Callable[[Callable[[str], Column]], Column], truth: str) -> list[float]:
    """Mean soft overlap over the samples of each candidate's score with the truth, in one job: voxels meet the candidates, a few
    rows, as an array, and sums are taken within tasks first. ``score`` gets a function from a parameter's name to its column."""
    rows = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(float(x)).alias(k) for k, x in c.items()]) for n, c in enumerate(candidates)])
    each = v.withColumn("_c", F.explode(rows)).select(*by, F.col("_c.n").alias("_n"), score(lambda k: F.col(f"_c.{k}")).alias("_s"), F.col(truth).cast("double").alias("_t"))
    dice = (2 * F.sum(F.col("_s") * F.col("_t")) + 1e-5) / (F.sum("_s") + F.sum("_t") + 1e-5)
    got = {r["_n"]: r["d"] for r in each.groupBy("_n", *by).agg(dice.alias("d")).groupBy("_n").agg(F.avg("d").alias("d")).collect()}  # a row per candidate
    return [got[n] for n in range(len(candidates))]


def best(scores: DataFrame, score: str, *ties: str, n: int = 1) -> DataFrame:
    """The top rows in a total order; equal scores go by the tie columns."""
    return scores.orderBy(F.desc(score), *ties).limit(n)


def threshold_sweep(v: DataFrame, by: list[str], level: Column, truth: str, steps: list[int]) -> DataFrame:
    """Overlap of {level >= t} with the truth for each sample and threshold, from one pass: rows are counted per level
    first and thresholds meet the counts."""
    per = v.groupBy(*by, level.cast("int").alias("level")).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("int")).alias("g"))
    total = v.groupBy(*by).agg(F.sum(F.col(truth).cast("int")).alias("t"))
    each = per.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= F.col("level"))))
    sums = each.groupBy(*by, "threshold").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    grid = total.withColumn("threshold", F.explode(F.array(*[F.lit(s) for s in steps])))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    dice = 2.0 * z("g") / (z("n") + F.col("t") + F.lit(1e-8))
    return grid.join(sums, [*by, "threshold"], "left").select(*by, "threshold", dice.alias("dice"))


def nelder_mead(evaluate: Callable[[list[list[float]]], list[float]], start: list[float], step: float = 0.25, rounds: int | None = None, tolerance: float = 1e-6) -> tuple[list[float], float]:
    """Minimise a function of a few numbers by a moving simplex: (point, value).

    ``evaluate`` gets lists of points, each of which can be one Spark job: the first has the simplex, and each round's has all
    points that the round could ask for, the mirrored, far and two near ones and the simplex drawn towards its best point.
    Unless told otherwise, as many rounds are taken as the search needs: until both the simplex's values and its points agree
    with the best one's within ``tolerance``.
    """
    n = len(start)
    points = [list(start)] + [[x + step * (i == j) * (abs(x) or 1) for j, x in enumerate(start)] for i in range(n)]
    order = lambda s: sorted(s, key=lambda p: p[0])
    simplex = order(zip(evaluate(points), points, strict=True))
    for _ in itertools.count() if rounds is None else range(rounds):
        (low, best_), (high, worst) = simplex[0], simplex[-1]
        if high - low <= tolerance and all(abs(x - b) <= tolerance for _, p in simplex[1:] for x, b in zip(p, best_, strict=True)):
            break
        centre = [sum(p[j] for _, p in simplex[:-1]) / n for j in range(n)]
        moved = [[c + a * (c - w) for c, w in zip(centre, worst, strict=True)] for a in (1.0, 2.0, 0.5, -0.5)]
        drawn = [[b + 0.5 * (x - b) for x, b in zip(p, best_, strict=True)] for _, p in simplex[1:]]
        values = evaluate(moved + drawn)
        mirror, far, outer, inner = zip(values, moved, strict=False)
        if mirror[0] < low:
            new = min(mirror, far, key=lambda p: p[0])
        elif mirror[0] < simplex[-2][0]:
            new = mirror
        else:
            near, limit = (outer, mirror[0]) if mirror[0] < high else (inner, high)
            new = near if near[0] < limit else None
        simplex = order([*simplex[:-1], new] if new else [simplex[0], *zip(values[4:], drawn, strict=True)])
    return simplex[0][1], simplex[0][0]
