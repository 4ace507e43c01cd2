"""Stencils on voxel tables, and Hessian-based tubularity.

Small neighbourhoods are equi joins on shifted indices, or windows along an axis; wide kernels run separably on halo blocks
in Arrow batches (``smooth_blocks``), a block with its margin at a time.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut
from lumenflow.operators import voxel


def offsets(connectivity: int = 26) -> list[tuple[int, int, int]]:
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [o for o in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= most]


def neighbour_edges(mask: DataFrame, connectivity: int = 26, by: list[str] | None = None) -> DataFrame:
    """Edges (src < dst) between neighbouring voxels of a mask: half of the offsets, an equi join on shifted indices."""
    by = by or []
    half = [o for o in offsets(connectivity) if o > (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("ijk", o, strict=True)]) for o in half])
    shifted = mask.select(*by, F.col("vid").alias("p"), F.explode(steps).alias("o"), "i", "j", "k").select(
        *by, "p", *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "ijk"]
    )
    hit = shifted.join(mask.select(*by, F.col("vid").alias("q"), "i", "j", "k"), [*by, "i", "j", "k"])
    return hit.select(*by, F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"))


def neighbour_counts(mask: DataFrame, connectivity: int = 26, by: list[str] | None = None) -> DataFrame:
    """Number of neighbours in the mask of each of its voxels, 0 included."""
    by = by or []
    e = neighbour_edges(mask, connectivity, by)
    ends = e.select(*by, F.col("src").alias("vid")).union(e.select(*by, F.col("dst").alias("vid")))
    n = ends.groupBy(*by, "vid").agg(F.count("*").alias("degree"))
    return mask.join(n, [*by, "vid"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def neighbour_counts_replicated(mask: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Neighbours of each voxel of a mask as a 3x3x3 filter counts them that repeats the volume's border outwards: a voxel at
    the border meets its own face, edge or corner again."""
    steps = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("ijk", o, strict=True)]) for o in offsets(26)])
    near = mask.select("vid", "i", "j", "k", F.explode(steps).alias("o"))
    at = [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + F.col(f"o.{c}"))).alias(c) for c, n in zip("ijk", shape, strict=True)]
    hit = near.select("vid", *at).join(mask.select("i", "j", "k"), ["i", "j", "k"]).groupBy("vid").agg(F.count("*").alias("degree"))
    return mask.join(hit, "vid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def _line(axis: str, by: list[str]) -> Window:
    return Window.partitionBy(*by, *[c for c in "ijk" if c != axis]).orderBy(axis)


def central(v: DataFrame, axis: str, value: str = "value", by: list[str] | None = None, out: str | None = None) -> DataFrame:
    """(next - last) / 2 along an axis of a dense volume, 0 at the borders."""
    w = _line(axis, by or [])
    return v.withColumn(out or f"d{axis}", F.coalesce((F.lead(value).over(w) - F.lag(value).over(w)) / 2, F.lit(0.0)))


def second(v: DataFrame, axis: str, value: str = "value", by: list[str] | None = None, out: str | None = None) -> DataFrame:
    """next - 2 v + last along an axis, 0 at the borders."""
    w = _line(axis, by or [])
    return v.withColumn(out or f"d{axis}{axis}", F.coalesce(F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w), F.lit(0.0)))


def one_sided(v: DataFrame, axis: str, spacing: float = 1.0, value: str = "value", by: list[str] | None = None, out: str | None = None) -> DataFrame:
    """Gradient along a named axis with one-sided differences at the borders, per unit of length."""
    w = _line(axis, by or [])
    nxt, last, x = F.lead(value).over(w), F.lag(value).over(w), F.col(value)
    g = F.when(nxt.isNull() & last.isNull(), 0.0).when(nxt.isNull(), x - last).when(last.isNull(), nxt - x).otherwise((nxt - last) / 2)
    return v.withColumn(out or f"g{axis}", g / spacing)


def hessian(v: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Second derivatives by finite differences: dii, djj, dkk, dij, dik, djk. Whatever runs along one axis is taken together, so
    that the volume is dealt and sorted once for each axis."""
    columns = v.columns
    for n, a in enumerate("ijk"):
        v = central(second(v, a, value, by), a, value, by, out=f"_d{a}")
        for b in "ijk"[:n]:
            v = central(v, a, f"_d{b}", by, out=f"d{b}{a}")
    return v.select(*columns, *[f"d{c}" for c in ("ii", "jj", "kk", "ij", "ik", "jk")])


def eigen3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3x3 matrix in descending order, by the trigonometric closed form."""
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(p2 / 6)
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    flat = p2 < 1e-24
    one = F.when(flat, q).otherwise(q + 2 * p * F.cos(phi))
    three = F.when(flat, q).otherwise(q + 2 * p * F.cos(phi + 2 * math.pi / 3))
    return [one, F.when(flat, q).otherwise(3 * q - one - three), three]


def with_eigen(v: DataFrame) -> DataFrame:
    """l1, l2, l3: Hessian eigenvalues in ascending order of magnitude. Each step is a projection of its own, so that the
    expressions stay small."""
    e = eigen3(*[F.col(f"d{c}") for c in ("ii", "jj", "kk", "ij", "ik", "jk")])
    v = v.select("*", F.array(*e).alias("_e"))
    ordered = F.array_sort("_e", lambda x, y: F.when(F.abs(x) < F.abs(y), -1).when(F.abs(x) > F.abs(y), 1).otherwise(0))
    return v.withColumn("_e", ordered).select("*", *[F.col("_e")[n].alias(f"l{n + 1}") for n in range(3)]).drop("_e")


def tubularity(l1: Column, l2: Column, l3: Column, alpha: float = 0.5, beta: float = 0.5, c: Column | float = 0.25) -> Column:
    """Single-scale vesselness of bright tubes; 0 unless both larger eigenvalues are negative."""
    c = F.lit(c) if isinstance(c, (int, float)) else c
    ra2 = (l2 * l2) / (l3 * l3)
    rb2 = (l1 * l1) / F.abs(l2 * l3)
    s2 = l1 * l1 + l2 * l2 + l3 * l3
    v = (1 - F.exp(-ra2 / (2 * alpha * alpha))) * F.exp(-rb2 / (2 * beta * beta)) * (1 - F.exp(-s2 / (2 * c * c)))
    return F.when((l2 < 0) & (l3 < 0), v).otherwise(0.0)


def factors(l1: Column, l2: Column, l3: Column, alpha: float, beta: float, c: Column | float) -> list[Column]:
    """The three factors of tubularity: by the section's roundness, the length, and the structure's strength."""
    c = F.lit(c) if isinstance(c, (int, float)) else c
    ra = F.abs(l2) / (F.abs(l3) + 1e-9)
    rb = F.abs(l1) / (F.sqrt(F.abs(l2) * F.abs(l3)) + 1e-9)
    s2 = l1 * l1 + l2 * l2 + l3 * l3
    return [1 - F.exp(-ra * ra / (2 * alpha * alpha)), F.exp(-rb * rb / (2 * beta * beta)), 1 - F.exp(-s2 / (2 * c * c))]


def strongest(v: DataFrame, by: list[str]) -> DataFrame:
    """``c``: half of the largest norm of the eigenvalues in each group."""
    s = F.sqrt(F.col("l1") * F.col("l1") + F.col("l2") * F.col("l2") + F.col("l3") * F.col("l3"))
    if not by:
        return v.crossJoin(F.broadcast(v.agg((F.max(s) / 2 + 1e-9).alias("c"))))  # one row
    return v.join(v.groupBy(*by).agg((F.max(s) / 2 + 1e-9).alias("c")), by)


def factor_maps(v: DataFrame, shape: tuple[int, int, int], scales: list[float], alpha: float = 0.5, beta: float = 0.5, c: float | None = None, by: list[str] | None = None) -> DataFrame:
    """(by.., i, j, k, v, scale, a, b): vesselness over scales with the scale that wins, the first of equal ones, and its factors;
    zeros where no scale sees a bright tube. ``c`` is half of the largest norm of each scale unless it is given."""
    by = by or []
    h = cut(eigen_blocks(v, shape, scales, by))
    norm = lambda n: F.sqrt(sum((F.col(f"l{n}_{m}") * F.col(f"l{n}_{m}") for m in (2, 3)), F.col(f"l{n}_1") * F.col(f"l{n}_1")))
    if c is not None:
        h = h.select("*", *[F.lit(float(c)).alias(f"c{n}") for n in range(len(scales))])
    else:
        most = [(F.max(norm(n)) / 2 + 1e-9).alias(f"c{n}") for n in range(len(scales))]
        h = h.join(h.groupBy(*by).agg(*most), by) if by else h.crossJoin(F.broadcast(h.agg(*most)))  # one row
    each = []
    for n, s in enumerate(scales):
        l1, l2, l3 = (F.col(f"l{n}_{m}") for m in (1, 2, 3))
        fa, fb, fc = factors(l1, l2, l3, alpha, beta, F.col(f"c{n}"))
        h = h.withColumns({f"a{n}": fa, f"b{n}": fb, f"s{n}": fc})
        score = F.when((l2 < 0) & (l3 < 0), F.col(f"a{n}") * F.col(f"b{n}") * F.col(f"s{n}")).otherwise(0.0)
        each.append(F.struct(score.alias("v"), F.lit(-float(s)).alias("less"), F.col(f"a{n}").alias("a"), F.col(f"b{n}").alias("b")))
    best = h.select(*by, "i", "j", "k", (F.greatest(*each) if len(each) > 1 else each[0]).alias("_b"))
    seen = lambda x: F.when(F.col("_b.v") > 0, x).otherwise(F.lit(0))
    return best.select(*by, "i", "j", "k", F.col("_b.v").alias("v"), seen(-F.col("_b.less")).alias("scale"), seen(F.col("_b.a")).alias("a"), seen(F.col("_b.b")).alias("b"))


#: Voxels that a block of ``eigen_blocks`` has about, and its least side.
VOXELS, SIDE = 65536, 32


def _eigen(d: list[np.ndarray]) -> np.ndarray:
    """``eigen3`` and the order of ``with_eigen`` on arrays: (3, ..) in ascending order of magnitude."""
    xx, yy, zz, xy, xz, yz = d
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    flat = p2 < 1e-24
    p = np.sqrt(np.where(flat, 1.0, p2) / 6)
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    phi = np.arccos(np.clip((a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2, -1.0, 1.0)) / 3
    one = np.where(flat, q, q + 2 * p * np.cos(phi))
    three = np.where(flat, q, q + 2 * p * np.cos(phi + 2 * math.pi / 3))
    every = np.stack([one, np.where(flat, q, 3 * q - one - three), three])
    return np.take_along_axis(every, np.argsort(np.abs(every), 0, kind="stable"), 0)


def eigen_blocks(v: DataFrame, shape: tuple[int, int, int], scales: list[float], by: list[str]) -> DataFrame:
    """Eigenvalues of ``gaussian_hessian`` at several scales side by side, in ascending order of magnitude, l<n>_1 to l<n>_3 for the
    n-th scale, with borders repeated: voxels are dealt once, to blocks with a margin, and a task holds one block. Where voxels are missing they
    count as 0; a place has a row if a kernel reaches it from a voxel, and nulls for scales whose kernel doesn't."""
    taps = [[np.array([w for _, w in kernel(s, o)]) for o in range(3)] for s in scales]
    reach = [len(t[0]) // 2 for t in taps]
    r = max(reach)
    side = [min(n, SIDE) for n in shape]
    for a in (2, 1, 0):
        side[a] = min(shape[a], max(side[a], VOXELS // math.prod(side[:a] + side[a + 1 :])))
    kinds = {f.name: f.dataType.simpleString() for f in v.schema.fields}
    names = [f"l{n}_{m}" for n in range(len(scales)) for m in (1, 2, 3)]
    orders = [(2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 0), (1, 0, 1), (0, 1, 1)]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), *(f"{c} {kinds[c]}" for c in "ijk"), *(f"{c} double" for c in names)])

    def along(x: np.ndarray, axis: int, w: np.ndarray) -> np.ndarray:
        n = x.shape[axis] - len(w) + 1
        at = lambda m: tuple(slice(m, m + n) if a == axis else slice(None) for a in range(3))
        return sum(t * x[at(m)] for m, t in enumerate(w))

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        low = pdf[["bi", "bj", "bk"]].iloc[0].to_numpy() * side
        high = np.minimum(low + side, shape)
        first, last = np.maximum(low - r, 0), np.minimum(high + r, shape)
        at = tuple((pdf[["i", "j", "k"]].to_numpy() - first).T)
        cells, there = np.zeros(last - first), np.zeros(last - first)
        np.add.at(cells, at, pdf["value"].to_numpy(float))
        there[at] = 1
        pad = list(zip(first - (low - r), (high + r) - last, strict=True))
        cells, there = np.pad(cells, pad, mode="edge"), np.pad(there, pad)
        out, reached = [], []
        for t, m, s in zip(taps, reach, scales, strict=True):
            own = tuple(slice(r - m, n - (r - m)) for n in cells.shape)
            one = [along(cells[own], 0, t[o]) for o in range(3)]
            two = {(p, q): along(one[p], 1, t[q]) for p in range(3) for q in range(3 - p)}
            seen = there[own]
            for axis in range(3):
                seen = along(seen, axis, np.ones(2 * m + 1))
            seen = seen.ravel() > 0
            reached.append(seen)
            out += [np.where(seen, x, np.nan) for x in _eigen([(along(two[p, q], 2, t[o]) * s * s).ravel() for p, q, o in orders])]
        kept = np.logical_or.reduce(reached)
        place = np.stack(np.unravel_index(np.flatnonzero(kept), tuple(high - low)), 1) + low
        got = pd.DataFrame({**{c: place[:, n] for n, c in enumerate("ijk")}, **{c: o[kept] for c, o in zip(names, out, strict=True)}})
        for c in by:
            got[c] = pdf[c].iloc[0]
        return got[[*by, "i", "j", "k", *names]]

    dealt = v.select(*by, "i", "j", "k", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    for c, size, n in zip("ijk", side, shape, strict=True):
        lo, hi = F.floor((F.col(c) - r) / size), F.floor((F.col(c) + r) / size)
        dealt = dealt.withColumn(f"b{c}", F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit((n - 1) // size)).cast("int"))))
    return dealt.groupBy(*by, "bi", "bj", "bk").applyInPandas(f, schema)


def clipped_vesselness(v: DataFrame, shape: tuple[int, int, int], scales: list[float], low: float = -200.0, high: float = 400.0, gamma: float = 15.0, by: list[str] | None = None, **options) -> DataFrame:
    """Vesselness of intensities that are clipped to [low, high] and brought to [0, 1] in each group, with a fixed strength
    ``gamma``: (by.., i, j, k, v, scale, a, b)."""
    x = v.withColumn("value", voxel.clip(F.col("value"), low, high))
    if by:
        x = voxel.minmax(x, by, epsilon=1e-8)
    else:
        x = voxel.minmax(x.withColumn("_all", F.lit(0)), ["_all"], epsilon=1e-8).drop("_all")
    return factor_maps(x.drop("value").withColumnRenamed("norm", "value"), shape, scales, c=gamma, by=by, **options)


def max_over_scales(v: DataFrame, keys: list[str], score: str = "v", scale: str = "scale", companions: list[str] | None = None) -> DataFrame:
    """Per voxel the largest score over the scales, the first scale of equal ones, with that scale's other columns; a voxel
    without a score above 0 keeps zeros."""
    comp = companions or []
    best = F.max_by(F.struct(scale, *comp), F.struct(score, -F.col(scale)))
    out = v.groupBy(*keys).agg(F.max(score).alias(score), best.alias("_b"))
    return out.select(*keys, score, *[F.when(F.col(score) > 0, F.col(f"_b.{c}")).otherwise(F.lit(0)).alias(c) for c in (scale, *comp)])


def kernel(sigma: float, order: int) -> list[tuple[int, float]]:
    """Sampled Gaussian or its derivatives on at least five places, ``max(5, 2 ceil(3 sigma) + 1)`` wide."""
    r = (max(5, 2 * math.ceil(3 * sigma) + 1) - 1) // 2
    x = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    k = {0: g, 1: -x / sigma**2 * g, 2: (x**2 / sigma**4 - 1 / sigma**2) * g}[order]
    return [(int(a), float(b)) for a, b in zip(x, k, strict=True)]


def convolve_all(v: DataFrame, axis: str, n: int, plan: list[tuple[str, str, list[tuple[int, float]]]], by: list[str] | None = None, pad: str = "replicate") -> DataFrame:
    """One separable pass along an axis for several kernels at once: ``plan`` lists (input, output, taps), all taps on the
    same places.

    Every voxel is dealt to the places that it contributes to, and the products are summed with partial aggregation: one
    shuffle whatever the number of kernels, no window and no order. Borders repeat their last voxel, or count as 0.
    """
    by = by or []
    places = [d for d, _ in plan[0][2]]
    weights = [dict(t) for _, _, t in plan]
    arr = F.array(*[F.struct(F.lit(d).alias("d"), *[F.lit(w[d]).alias(f"w{m}") for m, w in enumerate(weights)]) for d in places])
    r = max(abs(d) for d in places)
    x = v.withColumn("t", F.explode(arr))
    inner = x.withColumn(axis, F.col(axis) - F.col("t.d")).where(F.col(axis).between(0, n - 1))
    products = [(F.col(c) * F.col(f"t.w{m}")).alias(f"_p{m}") for m, (c, _, _) in enumerate(plan)]
    parts = inner.select(*by, "i", "j", "k", *products)
    if pad == "replicate":
        # places near a border read the border voxel once for each tap beyond it
        for edge, sign in ((0, -1), (n - 1, 1)):
            far = v.where(F.col(axis) == edge).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(min(r, n) - 1)))).withColumn("t", F.explode(arr))
            far = far.where(F.col("t.d") * sign > F.col("_s")).withColumn(axis, F.col(axis) - sign * F.col("_s"))
            parts = parts.unionByName(far.select(*by, "i", "j", "k", *products))
    return parts.groupBy(*by, "i", "j", "k").agg(*[F.sum(f"_p{m}").alias(out) for m, (_, out, _) in enumerate(plan)])


def convolve(v: DataFrame, axis: str, n: int, taps: list[tuple[int, float]], value: str = "value", out: str = "value", by: list[str] | None = None, pad: str = "replicate") -> DataFrame:
    """One kernel along an axis."""
    return convolve_all(v, axis, n, [(value, out, taps)], by, pad)


def gaussian_hessian(v: DataFrame, shape: tuple[int, int, int], sigma: float, value: str = "value", by: list[str] | None = None, pad: str = "replicate") -> DataFrame:
    """Scale-normalised (times sigma squared) Gaussian second derivatives: dii, djj, dkk, dij, dik, djk.

    Three passes in all: each carries every combination of orders that a later one needs.
    """
    k = [kernel(sigma, o) for o in range(3)]
    ni, nj, nk = shape
    one = convolve_all(v, "i", ni, [(value, f"a{o}", k[o]) for o in range(3)], by, pad)
    two = convolve_all(one, "j", nj, [(f"a{p}", f"b{p}{q}", k[q]) for p in range(3) for q in range(3 - p)], by, pad)
    names = {(2, 0, 0): "dii", (0, 2, 0): "djj", (0, 0, 2): "dkk", (1, 1, 0): "dij", (1, 0, 1): "dik", (0, 1, 1): "djk"}
    three = convolve_all(two, "k", nk, [(f"b{p}{q}", name, k[s]) for (p, q, s), name in names.items()], by, pad)
    return three.select(*(by or []), "i", "j", "k", *[(F.col(c) * sigma * sigma).alias(c) for c in names.values()])


def frobenius(prefix: str = "d") -> Column:
    c = lambda n: F.col(f"{prefix}{n}") * F.col(f"{prefix}{n}")
    return F.sqrt(c("ii") + c("jj") + c("kk") + 2 * (c("ij") + c("ik") + c("jk")))


def cost(terms: list[tuple[Column, float]], least: float = 1e-3) -> Column:
    """1 - the weighted mean of scores, clipped to [0, 1], at least ``least``."""
    total = reduce(lambda a, b: a + b, [s * w for s, w in terms]) / sum(w for _, w in terms)
    return F.greatest(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), F.lit(least))


def flow_field(v: DataFrame, a: str, b: str, w_a: float, w_b: float, by: list[str] | None = None) -> DataFrame:
    """Unit vectors of grad a * w_a - grad b * w_b: fx, fy, fz; zero where the field vanishes."""
    for axis in "ijk":
        v = one_sided(one_sided(v, axis, value=a, by=by, out=f"_a{axis}"), axis, value=b, by=by, out=f"_b{axis}")
    v = v.select("*", *[(F.col(f"_a{c}") * w_a - F.col(f"_b{c}") * w_b).alias(f"_f{c}") for c in "ijk"])
    norm = F.sqrt(sum((F.col(f"_f{c}") * F.col(f"_f{c}") for c in "ijk"), F.lit(0.0)))
    v = v.withColumn("_n", norm)
    out = v.select("*", *[F.when(F.col("_n") > 0, F.col(f"_f{c}") / F.col("_n")).otherwise(0.0).alias(f"f{o}") for c, o in zip("ijk", "xyz", strict=True)])
    return out.drop("_n", *[f"_{p}{c}" for p in "abf" for c in "ijk"])


# blocks


def blocks(v: DataFrame, size: int, halo: int, value: str = "value") -> DataFrame:
    """Voxels dealt to cubic blocks with a margin: (.., bi, bj, bk); a voxel goes to each block whose margin holds it."""
    out = v
    for c in "ijk":
        lo, hi = F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size)
        out = out.withColumn(f"b{c}", F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("int"), hi.cast("int"))))
    return out


def smooth_blocks(v: DataFrame, sigma: float, size: int = 32, by: list[str] | None = None) -> DataFrame:
    """Gaussian smoothing of a dense volume, block by block in numpy: each block reads its margin and keeps its own voxels.

    A task holds one block of (size + 2 * margin) ** 3 values, whatever the volume.
    """
    by = by or []
    taps = kernel(sigma, 0)
    r = max(d for d, _ in taps)
    w = np.array([x for _, x in taps])
    kinds = {f.name: f.dataType.simpleString() for f in v.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "i int, j int, k int, value double"])

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["i", "j", "k"]].to_numpy()
        lo, hi = at.min(0), at.max(0)
        x = np.full(hi - lo + 1, np.nan)
        x[tuple((at - lo).T)] = pdf["value"]
        for axis in range(3):
            p = np.pad(x, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="edge")
            n = x.shape[axis]
            x = sum(w[m] * p.take(np.arange(2 * r - m, 2 * r - m + n), axis) for m in range(2 * r + 1))
        b = pdf[["bi", "bj", "bk"]].iloc[0].to_numpy()
        own = ((at >= b * size) & (at < (b + 1) * size)).all(1)
        out = pdf.loc[own, [*by, "i", "j", "k"]].copy()
        out["value"] = x[tuple((at[own] - lo).T)]
        return out

    return blocks(v, size, r).groupBy(*by, "bi", "bj", "bk").applyInPandas(f, schema)
