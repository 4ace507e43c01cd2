"""Random orders, splits and patches by keyed draws; choices on trees; warps of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.functions import draws
from lumenflow.operators import graph


def members(rows: DataFrame, column: str, allowed: list) -> DataFrame:
    """Rows whose column is one of some values."""
    return rows.where(F.col(column).isin(allowed))


def permuted(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``draw``: a keyed number whose order is a random permutation of the rows; sorting is left to the caller."""
    return rows.withColumn("draw", draws.uniform(seed, F.col(key)))


def split(rows: DataFrame, key: str, share: float, seed: int, names: tuple[str, str] = ("train", "validation")) -> DataFrame:
    """``part``: a row belongs to the first part with probability ``share``, by its key alone; no shuffle."""
    return rows.withColumn("part", F.when(draws.uniform(seed, F.col(key)) < share, names[0]).otherwise(names[1]))


def sample(rows: DataFrame, key: str, n: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """``n`` random rows of each group: those with the smallest draws."""
    w = Window.partitionBy(*(by or [])).orderBy("draw", key)
    got = permuted(rows, key, seed)
    if not by:
        return got.orderBy("draw", key).limit(n)
    return got.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def patches(mask: DataFrame, by: str, shape: tuple[int, int, int], size: int, n: int, seed: int) -> DataFrame:
    """``n`` random cubes for each sample around voxels of its foreground, moved inside the volume, with flips:
    (by, patch, i0, j0, k0, flip_i, flip_j, flip_k). A voxel's draw depends on its sample, its place and the patch."""
    each = mask.select(by, "vid", "i", "j", "k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("patch"))
    key = [F.col(c) for c in (by, "patch")]
    picked = each.groupBy(by, "patch").agg(F.min(F.struct(draws.uniform(seed, *key, F.col("vid")).alias("u"), "vid", "i", "j", "k")).alias("p"))
    corner = [F.greatest(F.lit(0), F.least(F.col(f"p.{c}") - size // 2, F.lit(s - size))).cast("int").alias(f"{c}0") for c, s in zip("ijk", shape, strict=True)]
    flips = [(draws.uniform(f"{seed}{c}", *key) < 0.5).alias(f"flip_{c}") for c in "ijk"]
    return picked.select(by, "patch", *corner, *flips)


def patch_values(volume: DataFrame, corners: DataFrame, by: str, size: int) -> DataFrame:
    """The voxels of each patch, flipped: (by, patch, i, j, k, value) with indices from its corner. A patch lies in eight cells of its
    own size at most, and meets the voxels of these only."""
    held = corners
    for c in "ijk":
        first = F.floor(F.col(f"{c}0") / size).cast("int")
        held = held.withColumn(f"_{c}", F.explode(F.sequence(first, F.floor((F.col(f"{c}0") + size - 1) / size).cast("int"))))
    cell = [F.floor(F.col(c) / size).cast("int").alias(f"_{c}") for c in "ijk"]
    both = volume.select(by, "i", "j", "k", "value", *cell).join(held, [by, "_i", "_j", "_k"])
    inside, out = F.lit(True), []
    for c in "ijk":
        inside = inside & F.col(c).between(F.col(f"{c}0"), F.col(f"{c}0") + size - 1)
        at = F.col(c) - F.col(f"{c}0")
        out.append(F.when(F.col(f"flip_{c}"), size - 1 - at).otherwise(at).cast("int").alias(c))
    return both.where(inside).select(by, "patch", *out, "value")


def neighbourhood(points: DataFrame, volume: DataFrame, r: int) -> DataFrame:
    """Values of the cube of radius r around each point (id, i, j, k), clipped at the border, in order of their places:
    (id, patch)."""
    reach = F.sequence(F.lit(-r), F.lit(r))
    cells = points.select(*[F.col(c).alias(f"_{c}") for c in "ijk"]).distinct()  # points of one voxel share its patch
    for c in "ijk":
        cells = cells.withColumn(f"o{c}", F.explode(reach)).withColumn(c, F.col(f"_{c}") + F.col(f"o{c}"))
    hit = cells.join(volume.select("i", "j", "k", "value"), ["i", "j", "k"])
    each = hit.groupBy("_i", "_j", "_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("oi", "oj", "ok", "value"))), lambda s: s["value"]).alias("patch"))
    return points.select("id", "i", "j", "k").join(each.select(*[F.col(f"_{c}").alias(c) for c in "ijk"], "patch"), ["i", "j", "k"]).select("id", "patch")


def quantile(values: DataFrame, column: str, shares: list[float], order: str) -> DataFrame:
    """Quantiles at (n p + 1/2)-th places, linear between neighbours: (p, q). Ranks are taken by ``order`` among equal values."""
    n = values.where(F.col(column).isNotNull()).count()
    spark = values.sparkSession
    wanted = []
    for p in shares:
        h = min(max(n * p + 0.5, 1.0), float(max(n, 1)))
        wanted.append((p, int(h), min(int(h) + 1, n), h - int(h)))
    table = spark.createDataFrame(wanted, "p double, lo long, hi long, part double")
    # ranges of values are ranked by themselves; only the rows next to a quantile are needed
    rows = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), F.col(order).alias("_o"))
    ranked = graph.numbered(rows, ["x", "_o"], "r").withColumn("r", F.col("r") + 1)
    at = lambda c: ranked.select(F.col("r").alias(c), F.col("x").alias(f"x_{c}"))
    return table.join(at("lo"), "lo").join(at("hi"), "hi").select("p", (F.col("x_lo") + F.col("part") * (F.col("x_hi") - F.col("x_lo"))).alias("q"))


def thirds(points: DataFrame, least: int = 2) -> DataFrame:
    """Points (id, x, ..) dealt to left, middle and right by the thirds of x; a part with fewer than ``least`` points takes the
    first ``least`` points by id instead: (part, id)."""
    q = {r["p"]: r["q"] for r in quantile(points, "x", [1 / 3, 2 / 3], "id").collect()}
    if not q:
        return points.select(F.lit("left").alias("part"), "id").limit(0)
    part = F.when(F.col("x") >= q[2 / 3], "right").when(F.col("x") >= q[1 / 3], "middle").otherwise("left")
    dealt = points.select(part.alias("part"), "id")
    size = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    few = [p for p in ("left", "middle", "right") if size.get(p, 0) < least]
    if not few:
        return dealt
    first = points.orderBy("id").limit(least).select(F.explode(F.array(*[F.lit(p) for p in few])).alias("part"), "id")
    return dealt.where(~F.col("part").isin(few)).unionByName(first)


def upstream_seed(skeleton: DataFrame, root: tuple[float, float, float], target: tuple[float, float, float], seed: int, least: float = 5.0, share: float = 0.3) -> DataFrame:
    """One skeleton point (id, x, y, z) nearer to the root than the point next to the target, but not within ``share`` of that
    distance or ``least``: the one with the smallest draw; the point next to the target if there is none."""
    d = lambda p: F.sqrt(sum(((F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip("xyz", p, strict=True)), F.lit(0.0)))
    rows = skeleton.select("id", "x", "y", "z", d(root).alias("d_root"), d(target).alias("d_target"))
    near = rows.orderBy("d_target", "id").limit(1)
    top = near.select(F.col("d_root").alias("_top"))
    up = rows.join(F.broadcast(top), (F.col("d_root") < F.col("_top")) & (F.col("d_root") > F.greatest(F.lit(least), share * F.col("_top")))).drop("_top")  # one row
    ranked = up.withColumn("draw", draws.uniform(seed, F.col("id"))).unionByName(near.withColumn("draw", F.lit(2.0)))
    return ranked.orderBy("draw", "id").limit(1).drop("draw")


# frames of points


def voxel_to_lps(spacing: tuple[float, float, float], origin: tuple[float, float, float]) -> list[Column]:
    """x, y, z in LPS of voxel indices in columns i, j, k (spacing and origin in the order x, y, z)."""
    return [F.lit(float(o)) + F.col(c) * float(s) for c, s, o in zip("ijk", spacing, origin, strict=True)]


def lps_to_voxel(spacing: tuple[float, float, float], origin: tuple[float, float, float]) -> list[Column]:
    """Voxel indices of points in columns x, y, z, halves to the even side."""
    return [F.rint((F.col(c) - float(o)) / float(s)).cast("int") for c, s, o in zip("xyz", spacing, origin, strict=True)]


def warp(points: DataFrame, field: DataFrame | None = None, cell: float = 1.0) -> DataFrame:
    """Points (id, x, y, z) moved by a displacement field (ci, cj, ck, dx, dy, dz) over cells of a size; the identity where there
    is no field or it has no row."""
    if field is None:
        return points
    at = [F.floor(F.col(c) / cell).cast("int").alias(n) for c, n in zip("xyz", ("ci", "cj", "ck"), strict=True)]
    moved = points.select("*", *at).join(field, ["ci", "cj", "ck"], "left")
    new = {c: F.col(c) + F.coalesce(F.col(f"d{c}"), F.lit(0.0)) for c in "xyz"}
    return moved.select(*[new[c].alias(c) if c in new else F.col(c) for c in points.columns])
