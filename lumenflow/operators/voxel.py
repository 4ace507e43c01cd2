"""Voxel tables: masks, normalisation, crops, mask algebra, projections, tiling, resampling, rasterising, analytic shapes.

A volume is a long table (sample_id, vid, i, j, k, value) with vid = i + nx * (j + ny * k); only the voxels of interest
need rows. Everything here is column expressions and equi joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """All voxels of a volume: vid, i, j, k."""
    vid = F.col("id")
    return spark.range(nx * ny * nz).select(
        vid.alias("vid"), F.pmod(vid, F.lit(nx)).cast("int").alias("i"),
        F.pmod(F.floor(vid / nx), F.lit(ny)).cast("int").alias("j"), F.floor(vid / (nx * ny)).cast("int").alias("k"),
    )


def vid(i: Column, j: Column, k: Column, nx: int, ny: int) -> Column:
    return i.cast("long") + F.lit(nx).cast("long") * (j.cast("long") + F.lit(ny).cast("long") * k.cast("long"))


# predicates


def label_mask(v: DataFrame, label: int = 2, value: str = "value") -> DataFrame:
    return v.where(F.col(value) == label)


def foreground(v: DataFrame, above: float = 0.0, value: str = "value") -> DataFrame:
    return v.where(F.col(value) > above)


def threshold(v: DataFrame, t: float, inclusive: bool = True, value: str = "value") -> DataFrame:
    return v.where(F.col(value) >= t if inclusive else F.col(value) > t)


def band(v: DataFrame, low: float, high: float, value: str = "value") -> DataFrame:
    return v.where(F.col(value).between(low, high))


def within_roi(v: DataFrame, roi: DataFrame, keys: list[str]) -> DataFrame:
    """Voxels whose keys occur in the region of interest."""
    return v.join(roi.select(*keys).distinct(), keys, "left_semi")


def in_bounds(v: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    return v.where(reduce(lambda a, b: a & b, [F.col(c).between(0, n - 1) for c, n in zip("ijk", shape, strict=True)]))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def minmax(v: DataFrame, by: list[str], value: str = "value", out: str = "norm", epsilon: float = 0.0) -> DataFrame:
    """(v - min) / (max - min) within each group where max > min, else v; ``epsilon`` is added to the range.

    The extremes are one small row per group, joined back: no window has to sort or hold a whole volume.
    """
    ends = v.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + epsilon)
    return v.join(ends, by).withColumn(out, F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(F.col(value))).drop("_lo", "_hi")


def bounding_box(v: DataFrame, by: list[str]) -> DataFrame:
    return v.groupBy(*by).agg(*[f(c).alias(f"{c}{n}") for c in "ijk" for f, n in ((F.min, 0), (F.max, 1))])


def crop(v: DataFrame, mask: DataFrame, by: list[str], margin: int = 0) -> DataFrame:
    """Voxels in the bounding box of a mask, with indices from its corner."""
    box = bounding_box(mask, by)
    inside = reduce(lambda a, b: a & b, [F.col(c).between(F.col(f"{c}0") - margin, F.col(f"{c}1") + margin) for c in "ijk"])
    return v.join(box, by).where(inside).select(*[(F.col(c) - F.col(f"{c}0") + margin).alias(c) if c in "ijk" else F.col(c) for c in v.columns])


def box_between(v: DataFrame, a: tuple[int, int, int], b: tuple[int, int, int], margin: int = 10) -> DataFrame:
    """Voxels of the axis-aligned box of two points, dilated: plain range predicates that reach the scan."""
    return v.where(
        reduce(lambda x, y: x & y, [F.col(c).between(max(0, min(p, q) - margin), max(p, q) + margin) for c, p, q in zip("ijk", a, b, strict=True)])
    )


def pad(spark: SparkSession, v: DataFrame, shape: tuple[int, int, int], fill: float = 0.0, value: str = "value") -> DataFrame:
    """One sample as a dense volume of a shape; voxels without a row get ``fill``."""
    full = grid(spark, *shape)
    return full.join(v.select("i", "j", "k", value), ["i", "j", "k"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def flip(v: DataFrame, axis: str, n: int) -> DataFrame:
    return v.withColumn(axis, F.lit(n - 1) - F.col(axis))


def tri_state(score: Column, auto: float, review: float, names: tuple[str, str, str] = ("accepted", "flagged", "rejected")) -> Column:
    return F.when(score >= auto, names[0]).when(score >= review, names[1]).otherwise(names[2])


# mask algebra


def union(*masks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [m.select("vid") for m in masks]).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("vid").distinct().join(b.select("vid"), "vid", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("vid").distinct().join(b.select("vid"), "vid", "left_anti")


def paint(*layers: tuple[DataFrame, int]) -> DataFrame:
    """Label volume from masks in painter's order: the last layer that holds a voxel gives its label."""
    rows = reduce(
        lambda a, b: a.unionByName(b), [m.select("vid", F.lit(p).alias("_p"), F.lit(label).alias("label")) for p, (m, label) in enumerate(layers)]
    )
    return rows.groupBy("vid").agg(F.max(F.struct("_p", "label")).getField("label").alias("label"))


def project_max(v: DataFrame, axis: str, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Maximum-intensity projection over an axis."""
    return v.groupBy(*(by or []), *[c for c in "ijk" if c != axis]).agg(F.max(value).alias(value))


def dilate(mask: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Voxels (i, j, k) that a mask reaches by the offsets, itself included."""
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{c}") for c, d in zip("ijk", o, strict=True)]) for o in [(0, 0, 0), *offsets]])
    return mask.select("i", "j", "k", F.explode(steps).alias("o")).select(*[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "ijk"]).distinct()


def erode(mask: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Voxels of a mask all of whose neighbours are in it."""
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{c}") for c, d in zip("ijk", o, strict=True)]) for o in [(0, 0, 0), *offsets]])
    near = mask.select("i", "j", "k", F.explode(steps).alias("o"))
    hit = near.select(*[F.col(c).alias(f"c{c}") for c in "ijk"], *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "ijk"])
    n = len(offsets) + 1
    return hit.join(mask.select("i", "j", "k"), ["i", "j", "k"]).groupBy("ci", "cj", "ck").count().where(F.col("count") == n).select(
        *[F.col(f"c{c}").alias(c) for c in "ijk"]
    )


def closing(mask: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    return erode(dilate(mask, offsets), offsets)


# tiles and resampling


def starts(n: int, patch: int, overlap: int) -> list[int]:
    """Tile starts with a stride of patch - 2 * overlap that cover 0..n-1 of an axis padded to at least one patch."""
    stride, n = patch - 2 * overlap, max(n, patch)
    at = list(range(0, n - patch + 1, stride))
    if at[-1] + patch < n:
        at.append(at[-1] + stride)
    return at


def tiles(v: DataFrame, shape: tuple[int, int, int], patch: int = 64, overlap: int = 8) -> DataFrame:
    """A row per voxel and tile that holds it: (.., ti, tj, tk) and the voxel's place in the tile (pi, pj, pk)."""
    out = v
    for c, n in zip("ijk", shape, strict=True):
        stride = patch - 2 * overlap
        last = len(starts(n, patch, overlap)) - 1
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - (patch - 1)) / stride)).cast("int")
        final = F.least(F.lit(last), F.floor(F.col(c) / stride)).cast("int")
        out = out.withColumn(f"t{c}", F.explode(F.sequence(first, final))).withColumn(f"p{c}", F.col(c) - F.col(f"t{c}") * stride)
    return out


def blend_weight(patch: int, sigma: float | None = None) -> Column:
    """Gaussian weight of a place in a tile, largest in its middle."""
    s = sigma or patch / 4
    mid = (patch - 1) / 2
    d2 = reduce(lambda a, b: a + b, [(F.col(f"p{c}") - mid) * (F.col(f"p{c}") - mid) for c in "ijk"])
    return F.exp(-d2 / (2 * s * s))


def blend(predictions: DataFrame, by: list[str], value: str = "value", weight: str = "w") -> DataFrame:
    """Weighted mean of overlapping tiles for each voxel."""
    total = F.sum(F.col(weight) * F.col(value)) / F.greatest(F.sum(weight), F.lit(1e-6))
    return predictions.groupBy(*by).agg(total.alias(value))


def resample_nearest(spark: SparkSession, v: DataFrame, shape, spacing, target, value: str = "value") -> DataFrame:
    """One volume on a grid of another spacing; each new voxel takes the nearest old one (halves go up)."""
    new = tuple(max(1, round(n * s / t)) for n, s, t in zip(shape, spacing, target, strict=True))
    out = grid(spark, *new)
    index = [
        F.least(F.floor(F.col(c) * t / s + 0.5), F.lit(n - 1)).cast("int").alias(f"s{c}") for c, n, s, t in zip("ijk", shape, spacing, target, strict=True)
    ]
    src = v.select(*[F.col(c).alias(f"s{c}") for c in "ijk"], value)
    return out.select("*", *index).join(src, ["si", "sj", "sk"]).select("vid", "i", "j", "k", value)


def resample_linear(spark: SparkSession, v: DataFrame, shape, spacing, target, value: str = "value") -> DataFrame:
    """Trilinear resampling: each new voxel is the weighted sum of its eight old corners."""
    new = tuple(max(1, round(n * s / t)) for n, s, t in zip(shape, spacing, target, strict=True))
    out = grid(spark, *new)
    for c, n, s, t in zip("ijk", shape, spacing, target, strict=True):
        x = F.least(F.col(c) * (t / s), F.lit(float(n - 1)))
        out = out.withColumn(f"b{c}", F.least(F.floor(x), F.lit(max(0, n - 2))).cast("int")).withColumn(f"f{c}", x - F.col(f"b{c}"))
    corner = F.array(*[F.struct(*[F.lit(b >> a & 1).alias(f"o{c}") for a, c in enumerate("ijk")]) for b in range(8)])
    out = out.withColumn("o", F.explode(corner))
    w = reduce(lambda a, b: a * b, [F.when(F.col(f"o.o{c}") == 1, F.col(f"f{c}")).otherwise(1 - F.col(f"f{c}")) for c in "ijk"])
    out = out.select("vid", "i", "j", "k", w.alias("w"), *[(F.col(f"b{c}") + F.col(f"o.o{c}")).alias(f"s{c}") for c in "ijk"])
    src = v.select(*[F.col(c).alias(f"s{c}") for c in "ijk"], value)
    return out.where("w > 0").join(src, ["si", "sj", "sk"]).groupBy("vid", "i", "j", "k").agg(F.sum(F.col("w") * F.col(value)).alias(value))


# shapes


def rasterise(segments: DataFrame, step: float = 0.5) -> DataFrame:
    """Voxels (i, j, k) within the radius of points every ``step`` along segments (x0 .. z1, r), in voxel units.

    Each step is expanded to the voxels of its own bounding cube: an equi form with no range join.
    """
    d = {c: F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"}
    length = F.sqrt(sum((d[c] * d[c] for c in "xyz"), F.lit(0.0)))
    n = F.greatest(F.lit(1), F.ceil(length / step)).cast("int")
    pts = segments.withColumn("_n", n).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumn("_t", F.col("_t") / F.col("_n"))
    pts = pts.select("r", *[(F.col(f"{c}0") + F.col("_t") * d[c]).alias(c) for c in "xyz"])
    for c, o in zip("xyz", "ijk", strict=True):
        pts = pts.withColumn(o, F.explode(F.sequence(F.ceil(F.col(c) - F.col("r")).cast("int"), F.floor(F.col(c) + F.col("r")).cast("int"))))
    d2 = sum(((F.col(o) - F.col(c)) * (F.col(o) - F.col(c)) for c, o in zip("xyz", "ijk", strict=True)), F.lit(0.0))
    return pts.where(d2 <= F.col("r") * F.col("r")).select("i", "j", "k").distinct()


def cylinder(v: DataFrame, ci: float, cj: float, radius: float, k0: int, k1: int) -> DataFrame:
    """Voxels of a cylinder along k."""
    d2 = (F.col("i") - ci) * (F.col("i") - ci) + (F.col("j") - cj) * (F.col("j") - cj)
    return v.where((d2 <= radius * radius) & F.col("k").between(k0, k1))


def superellipsoid(v: DataFrame, centre, axes, power: float = 2.5) -> DataFrame:
    total = sum((F.pow(F.abs((F.col(c) - o) / a), F.lit(power)) for c, o, a in zip("ijk", centre, axes, strict=True)), F.lit(0.0))
    return v.where(total <= 1)


def bezier(spark: SparkSession, points: list[tuple[float, float, float]], samples: int = 2000) -> DataFrame:
    """Points (t, x, y, z) of a quadratic or cubic Bezier curve."""
    n = len(points) - 1
    binomial = {2: (1, 2, 1), 3: (1, 3, 3, 1)}[n]
    t = spark.range(samples).select((F.col("id") / (samples - 1)).alias("t"))
    at = lambda a: sum((binomial[m] * points[m][a] * F.pow(1 - F.col("t"), F.lit(float(n - m))) * F.pow(F.col("t"), F.lit(float(m))) for m in range(n + 1)), F.lit(0.0))
    return t.select("t", *[at(a).alias(c) for a, c in enumerate("xyz")])


def bezier_curves(points: DataFrame, samples: int = 2000) -> DataFrame:
    """Points (x, y, z) of the cubic curves of a table, a row of control points x0 .. z3 each."""
    t = (F.col("_s") / (samples - 1)).alias("t")
    at = lambda c: F.expr(f"(1-t)*(1-t)*(1-t)*{c}0 + 3*(1-t)*(1-t)*t*{c}1 + 3*(1-t)*t*t*{c}2 + t*t*t*{c}3").alias(c)
    return points.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).select("*", t).select(*[at(c) for c in "xyz"])


def tube(v: DataFrame, curve: DataFrame, radius: float) -> DataFrame:
    """Voxels within a radius of a sampled curve, with the least squared distance: curve points are dealt to the voxels of
    their bounding cubes, so that the join is on equal voxels."""
    pts = curve.select("x", "y", "z")
    for c, o in zip("xyz", "ijk", strict=True):
        pts = pts.withColumn(o, F.explode(F.sequence(F.ceil(F.col(c) - radius).cast("int"), F.floor(F.col(c) + radius).cast("int"))))
    d2 = sum(((F.col(o) - F.col(c)) * (F.col(o) - F.col(c)) for c, o in zip("xyz", "ijk", strict=True)), F.lit(0.0))
    near = pts.groupBy("i", "j", "k").agg(F.min(d2).alias("d2")).where(F.col("d2") <= radius * radius)
    return v.join(near, ["i", "j", "k"])
