"""Exact Euclidean distance transforms, one axis at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _envelope(f: np.ndarray, weight: float) -> np.ndarray:
    """min over q of f[q] + weight * (p - q)^2 for all p, by the lower envelope of parabolas."""
    n = len(f)
    use = np.flatnonzero(np.isfinite(f))
    if not len(use):
        return f
    v, z = [use[0]], [-np.inf]
    for q in use[1:]:
        while True:
            p = v[-1]
            s = ((f[q] + weight * q * q) - (f[p] + weight * p * p)) / (2 * weight * (q - p))
            if s > z[-1]:
                break
            v.pop()
            z.pop()
        v.append(q)
        z.append(s)
    z.append(np.inf)
    owner = np.searchsorted(np.array(z[1:]), np.arange(n), side="left")
    q = np.array(v)[owner]
    return f[q] + weight * (np.arange(n) - q) ** 2


#: Lines of one axis are passed in bundles of so many by so many, cut to pieces of so many places along the first axis.
BUNDLE, PIECE = 32, 256


def _nearest(v: DataFrame, inside: str, axis: str, by: list[str]) -> DataFrame:
    """(by.., i, j, k, near): how far the nearest outside lies along one axis, null on a line without one.

    A line is cut to pieces, so that no task holds a whole line: the nearest outside lies in a place's own piece, or it is the
    last one before the piece or the first one after it; those two are found among a row per piece.
    """
    line = [*by, *[c for c in "ijk" if c != axis]]
    cur = v.select(*by, "i", "j", "k", F.when(F.coalesce(F.col(inside), F.lit(False)), F.lit(None).cast("int")).otherwise(F.col(axis)).alias("_o"), F.floor(F.col(axis) / PIECE).cast("int").alias("_s"))
    ends = cur.groupBy(*line, "_s").agg(F.min("_o").alias("_lo"), F.max("_o").alias("_hi"))
    w = Window.partitionBy(*line).orderBy("_s")
    ends = ends.select(
        *line, "_s", F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    own = Window.partitionBy(*line, "_s").orderBy(axis)
    last = F.coalesce(F.max("_o").over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    first = F.coalesce(F.min("_o").over(own.rowsBetween(0, Window.unboundedFollowing)), F.col("_after"))
    keyed = cur.join(ends, [*line, "_s"])
    return keyed.select(*by, "i", "j", "k", F.least(F.col(axis) - last, first - F.col(axis)).cast("long").alias("near"))


def _pass(axis: str, rest: list[str], weight: float):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [pdf[c].to_numpy() for c in (axis, *rest)]
        order = np.lexsort(at)
        d2 = pdf["d2"].to_numpy()[order]
        line = np.stack([x[order] for x in at[1:]], 1)
        first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]).any(1)]))
        for n, m in zip(first, [*first[1:], len(d2)], strict=True):
            if d2[n:m].any():  # a line of zeros stays as it is
                d2[n:m] = _envelope(d2[n:m], weight)
        out = np.empty_like(d2)
        out[order] = d2
        pdf["d2"] = out
        return pdf.drop(columns=["_0", "_1"])

    return f


def squared_edt(v: DataFrame, inside: str, shape: tuple[int, int, int], spacing=(1.0, 1.0, 1.0), by: list[str] | None = None) -> DataFrame:
    """Squared distance of each voxel of a dense volume to the nearest voxel where ``inside`` is false: (by.., i, j, k, d2).

    Three passes over the lines of one axis each. Before the first, the longest, distances are none or infinite, so that it takes
    pieces of lines; the others take bundles of neighbouring lines: a group is one of the shorter axes long and ``BUNDLE`` lines
    wide and high. A volume without an outside has null distances.
    """
    by = by or []
    kinds = {f.name: f.dataType.simpleString() for f in v.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "i int, j int, k int, d2 double"])
    order = sorted(zip("kji", reversed(spacing), reversed(shape), strict=True), key=lambda x: -x[2])
    (axis, s, _), *others = order
    near = F.col("near") * float(s)
    cur = _nearest(v, inside, axis, by).select(*by, "i", "j", "k", F.coalesce(near * near, F.lit(float("inf"))).alias("d2"))
    for axis, s, _ in others:
        rest = [c for c in "ijk" if c != axis]
        bundled = cur.select("*", *[F.floor(F.col(c) / BUNDLE).alias(f"_{n}") for n, c in enumerate(rest)])
        cur = bundled.groupBy(*by, "_0", "_1").applyInPandas(_pass(axis, rest, s * s), schema)
    return cur.withColumn("d2", F.when(F.col("d2") < float("inf"), F.col("d2")))


def squared_edt_joined(v: DataFrame, inside: str, by: list[str] | None = None) -> DataFrame:
    """The same on unit voxels by column expressions only: along k, of any length, in pieces of lines; along j and i a line's
    values travel as one array, and each place takes the minimum over it, which suits up to a few hundred voxels."""
    by = by or []
    cur = _nearest(v, inside, "k", by).select(*by, "i", "j", "k", (F.col("near") * F.col("near")).alias("d2"))
    for axis in "ji":
        rest = [c for c in "ijk" if c != axis]
        lines = cur.groupBy(*by, *rest).agg(F.collect_list(F.struct(F.col(axis).alias("p"), "d2")).alias("line"))
        here = lines.select(*by, *rest, F.explode("line").alias("h"), F.filter("line", lambda x: x["d2"].isNotNull()).alias("line"))
        d2 = F.array_min(F.transform("line", lambda x: x["d2"] + (x["p"] - F.col("h.p")) * (x["p"] - F.col("h.p")).cast("long")))
        cur = here.select(*by, *rest, F.col("h.p").alias(axis), d2.alias("d2")).select(*by, "i", "j", "k", "d2")
    return cur
