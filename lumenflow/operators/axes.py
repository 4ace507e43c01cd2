"""Principal axes of point sets of any size, and their end points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
_TURNS = [("x", "y"), ("x", "z"), ("y", "z")]


def covariance(p: DataFrame, by: list[str]) -> DataFrame:
    """A row per group: n, means mx.., and the covariance cxx, cxy, .. over all its points, by mergeable moments."""
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    return p.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in XYZ], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])


def _c(a: str, b: str) -> str:
    return f"c{min(a, b)}{max(a, b)}"


def eigenvectors(c: DataFrame, sweeps: int = 6) -> DataFrame:
    """``axes``: the eigenvalues and unit eigenvectors of each row's symmetric matrix cxx .. czz, largest first, as structs (value, x,
    y, z), by cyclic rotations that each clear one entry. A vector's largest component is positive."""
    c = c.withColumns({f"v{a}{b}": F.lit(float(a == b)) for a in XYZ for b in XYZ})
    for p, q in _TURNS * sweeps:
        (r,) = [a for a in XYZ if a not in (p, q)]
        pp, qq, pq, pr, qr = (F.col(_c(*k)) for k in ((p, p), (q, q), (p, q), (p, r), (q, r)))
        slope = (qq - pp) / (2 * pq)
        c = c.withColumn("_t", F.when(F.abs(pq) <= 1e-300, 0.0).otherwise(F.when(slope < 0, -1.0).otherwise(1.0) / (F.abs(slope) + F.sqrt(slope * slope + 1))))
        c = c.withColumn("_o", 1 / F.sqrt(F.col("_t") * F.col("_t") + 1)).withColumn("_s", F.col("_t") * F.col("_o"))
        o, s, t = F.col("_o"), F.col("_s"), F.col("_t")
        turned = {_c(p, p): pp - t * pq, _c(q, q): qq + t * pq, _c(p, q): F.lit(0.0), _c(p, r): o * pr - s * qr, _c(q, r): s * pr + o * qr}
        for a in XYZ:
            vp, vq = F.col(f"v{a}{p}"), F.col(f"v{a}{q}")
            turned |= {f"v{a}{p}": o * vp - s * vq, f"v{a}{q}": s * vp + o * vq}
        c = c.select(*[turned.get(n, F.col(n)).alias(n) for n in c.columns if n not in ("_t", "_o", "_s")])
    return c.withColumn("axes", F.sort_array(F.array(*[_axis(b) for b in XYZ]), asc=False)).drop(*[f"v{a}{b}" for a in XYZ for b in XYZ])


def _axis(b: str) -> Column:
    v = [F.col(f"v{a}{b}") for a in XYZ]
    size = [F.abs(x) for x in v]
    lead = F.when((size[0] >= size[1]) & (size[0] >= size[2]), v[0]).when(size[1] >= size[2], v[1]).otherwise(v[2])
    sign = F.when(lead < 0, -1.0).otherwise(1.0)
    return F.struct(F.col(_c(b, b)).alias("value"), *[(sign * x).alias(a) for x, a in zip(v, XYZ, strict=True)])


def principal_axes(p: DataFrame, by: list[str]) -> DataFrame:
    """(by.., n, mx, my, mz, axes) of points (by.., x, y, z)."""
    return eigenvectors(covariance(p, by)).select(*by, "n", *[f"m{a}" for a in XYZ], "axes")


def end_points(p: DataFrame, by: list[str], id_: str = "id") -> DataFrame:
    """Each group's points that reach farthest along its first axis: (by.., low_id, high_id, low, high), where equal ones go to the
    smaller id. Groups are one small row each, and the points meet theirs once."""
    first = principal_axes(p, by).select(*by, *[F.col(f"m{a}").alias(f"_m{a}") for a in XYZ], *[F.col("axes")[0][a].alias(f"_a{a}") for a in XYZ])
    both = p.join(first, by) if by else p.join(F.broadcast(first))  # one row
    along = reduce(lambda s, t: s + t, [(F.col(a) - F.col(f"_m{a}")) * F.col(f"_a{a}") for a in XYZ])
    at = both.select(*by, F.col(id_).alias("_id"), along.alias("_t"))
    least = F.min(F.struct(F.col("_t"), F.col("_id")))
    most = F.min(F.struct((-F.col("_t")).alias("_t"), F.col("_id")))
    return at.groupBy(*by).agg(least.alias("l"), most.alias("m")).select(*by, F.col("l._id").alias("low_id"), F.col("m._id").alias("high_id"), F.col("l._t").alias("low"), (-F.col("m._t")).alias("high"))
