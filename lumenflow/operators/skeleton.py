"""Thinning of voxel masks by blocks, pruning of short branches, and growth of vessel trees."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut
from lumenflow.operators import stencil

_AROUND = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]


def _adjacent(places: list[tuple[int, int, int]], most: int) -> list[int]:
    """For each of the 26 places about a voxel, the bits of those of ``places`` that are neighbours of it, with at most ``most``
    coordinates that differ."""
    near = lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 and sum(abs(x - y) for x, y in zip(a, b, strict=True)) <= most
    return [sum(1 << _AROUND.index(q) for q in places if near(p, q)) for p in _AROUND]


_FACES = sum(1 << n for n, o in enumerate(_AROUND) if sum(map(abs, o)) == 1)
_EDGES = sum(1 << n for n, o in enumerate(_AROUND) if sum(map(abs, o)) <= 2)
_BY_ANY = _adjacent(_AROUND, 3)
_BY_FACE = _adjacent([o for o in _AROUND if sum(map(abs, o)) <= 2], 1)


def _flood(start: int, within: int, adjacent: list[int]) -> int:
    seen, new = start, start
    while new:
        reach = 0
        while new:
            low = new & -new
            reach |= adjacent[low.bit_length() - 1]
            new ^= low
        new = reach & within & ~seen
        seen |= new
    return seen


def simple(near: int) -> bool:
    """True if a voxel with these neighbours (a bit for each of the 26 places) can go without changing the topology: the object
    about it is one 26-component, and the background of its 18-neighbourhood that touches it by a face is one 6-component."""
    if not near or _flood(near & -near, near, _BY_ANY) != near:
        return False
    back = ~near & _EDGES
    faces = back & _FACES
    return bool(faces) and not faces & ~_flood(faces & -faces, back, _BY_FACE)


#: Neighbourhoods that have been looked at: whether a voxel with them can go, and isn't the end of a line.
_known: dict[int, bool] = {}


def _goes(codes: np.ndarray) -> np.ndarray:
    every, at = np.unique(codes, return_inverse=True)
    for c in every.tolist():
        if c not in _known:
            _known[c] = bool(c & (c - 1)) and simple(c)
    return np.array([_known[c] for c in every.tolist()], bool)[at] if len(every) else np.zeros(0, bool)


def thin_round(x: np.ndarray, parity: np.ndarray) -> np.ndarray:
    """One round of thinning of a dense box, whose outermost layer counts as background: voxels at a face's border when the
    round begins go if they are simple and not the ends of lines, one of eight subfields after the other. Voxels of a subfield
    don't touch, so that they can go at once. ``parity`` is that of the box's corner in the volume."""
    x = x.copy()
    stride = np.array([x.shape[1] * x.shape[2], x.shape[2], 1])
    shift = np.array([(np.array(o) * stride).sum() for o in _AROUND])
    face = shift[[n for n, o in enumerate(_AROUND) if sum(map(abs, o)) == 1]]
    weight = 1 << np.arange(26, dtype=np.int64)
    inner = np.zeros(x.shape, bool)
    inner[1:-1, 1:-1, 1:-1] = True
    flat = x.ravel()
    at = np.flatnonzero(flat & inner.ravel())
    at = at[~flat[at[:, None] + face].all(1)]
    place = np.stack(np.unravel_index(at, x.shape), 1) + parity
    field = ((place & 1) * np.array([4, 2, 1])).sum(1)
    for n in range(8):
        here = at[field == n]
        if len(here):
            codes = (flat[here[:, None] + shift] * weight).sum(1)
            flat[here[_goes(codes)]] = False
    return flat.reshape(x.shape)


#: A subfield looks one voxel far, so that a round of eight reaches eight voxels, and a block with so wide a margin is right inside.
REACH = 8


def thin(mask: DataFrame, by: list[str], size: int = 48, rounds: int = 2) -> DataFrame:
    """Skeleton voxels (by.., vid, i, j, k) of masks of any size.

    Thinning is synchronous: a round's result depends on the voxels before it alone, so that blocks with a margin of ``REACH``
    voxels for each of ``rounds`` rounds give what the whole volume would, whatever their size. A task holds one block; blocks
    exchange their margins between calls, until a call removes nothing. Repeated voxels count once; an empty mask gives no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in mask.schema.fields}
    cells = cut(mask.select(*by, F.col("vid").cast("long").alias("vid"), *[F.col(c).cast("int").alias(c) for c in "ijk"]).distinct())
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "vid long, i int, j int, k int"])
    halo = REACH * rounds

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["i", "j", "k"]].to_numpy()
        low = at.min(0) - 1
        x = np.zeros(at.max(0) - low + 2, bool)
        x[tuple((at - low).T)] = True
        for _ in range(rounds):
            x = thin_round(x, low)
        block = pdf[["bi", "bj", "bk"]].iloc[0].to_numpy()
        own = (at // size == block).all(1) & x[tuple((at - low).T)]
        return pdf.loc[own, [*by, "vid", "i", "j", "k"]]

    n = cells.count()
    while n:
        dealt = cells
        for c in "ijk":
            lo, hi = F.floor((F.col(c) - halo) / size).cast("int"), F.floor((F.col(c) + halo) / size).cast("int")
            dealt = dealt.withColumn(f"b{c}", F.explode(F.sequence(lo, hi)))
        cells = cut(dealt.groupBy(*by, "bi", "bj", "bk").applyInPandas(f, schema))
        before, n = n, cells.count()
        if n == before:
            break
    return cells


def prune(skeleton: DataFrame, least: int, by: list[str] | None = None) -> DataFrame:
    """The skeleton without branches of fewer than ``least`` voxels: lines from an end to the first voxel with three neighbours or
    more. Lines that meet none are kept whole, however short. Each step is a join on the voxels that lines have come to."""
    by = by or []
    e = stencil.neighbour_edges(skeleton, 26, by)
    both = cut(e.select(*by, F.col("src").alias("here"), F.col("dst").alias("next")).union(e.select(*by, "dst", "src")))
    degree = cut(both.groupBy(*by, "here").agg(F.count("*").alias("n")))
    ends = degree.where("n = 1").select(*by, F.col("here").alias("end"), "here", F.lit(None).cast("long").alias("last"), F.array("here").alias("line"))
    gone = None
    for _ in range(least - 1):
        step = ends.join(both, [*by, "here"]).where(~F.col("next").eqNullSafe(F.col("last")))
        step = cut(step.join(degree.withColumnRenamed("here", "next"), [*by, "next"]))
        found = step.where("n > 2").select(*by, F.explode("line").alias("vid"))
        gone = found if gone is None else gone.union(found)
        ends = step.where("n = 2").select(*by, "end", F.col("next").alias("here"), F.col("here").alias("last"), F.concat("line", F.array("next")).alias("line"))
    return skeleton if gone is None else skeleton.join(gone.distinct(), [*by, "vid"], "left_anti")


def euler(mask: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Euler number of the union of a mask's closed unit cubes (by.., euler): corners - edges + faces - cubes, each once. It is that
    of the object whose voxels are joined by 26 neighbours; thinning keeps it."""
    by = by or []
    # a cube's cells are the places of a grid of twice the resolution that touch its middle; the parity of a place is its dimension
    at = mask.select(*by, *[(F.col(c) * 2 + 1).alias(c) for c in "ijk"]).distinct()
    for c in "ijk":
        at = at.withColumn("_d", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
    odd = reduce(lambda a, b: a + b, [F.pmod(F.col(c), F.lit(2)) for c in "ijk"])
    return at.distinct().groupBy(*by).agg(F.sum(F.when(odd % 2 == 0, 1).otherwise(-1)).alias("euler"))


def nearest_earlier(at: np.ndarray) -> np.ndarray:
    """For each point the nearest of those before it, the first of equal ones; -1 for the first point.

    Points lie in cubic cells, which are made anew, an eighth as large, whenever there are eight times as many; a point looks through
    shells of cells about its own, until none farther out can hold a nearer or equal point.
    """
    n = len(at)
    parent = np.full(n, -1)
    if n < 2:
        return parent
    low = at.min(0)
    extent = float((at.max(0) - low).max()) or 1.0
    parts, made, cells = 1, 1, {}
    shells: dict[int, list[tuple[int, int, int]]] = {}
    key = lambda i: tuple(np.minimum((at[i] - low) / extent * parts, parts - 1).astype(int).tolist())
    cells[key(0)] = [0]
    for m in range(1, n):
        if m >= 8 * made:
            made, parts, cells = m, parts * 2, {}
            for i in range(m):
                cells.setdefault(key(i), []).append(i)
        c, side = key(m), extent / parts
        # how far the point is from the nearest face of its cell
        within = at[m] - low - np.array(c) * side
        room = max(0.0, float(min(within.min(), (side - within).min())))
        best, first = np.inf, -1
        for r in range(parts):
            if r not in shells:
                shells[r] = [o for o in itertools.product(range(-r, r + 1), repeat=3) if max(map(abs, o)) == r]
            near = [i for o in shells[r] for i in cells.get((c[0] + o[0], c[1] + o[1], c[2] + o[2]), ())]
            if near:
                d = ((at[near] - at[m]) ** 2).sum(1)
                top = float(d.min())
                if top <= best:
                    low_i = min(i for i, x in zip(near, d.tolist(), strict=True) if x == top)
                    first = low_i if top < best else min(first, low_i)
                    best = top
            # rounding may put a point a little outside of its cell
            if best < (room + r * side) ** 2 * (1 - 1e-9):
                break
        parent[m] = first
        cells.setdefault(c, []).append(m)
    return parent


def grow(points: DataFrame, by: str = "tree_id", root_radius: float = 5.5, least_radius: float = 0.8) -> DataFrame:
    """A tree over each group's points (by, point_id, x, y, z), rooted at its smallest id: points join in order of id, each
    at the nearest point that is in the tree. Radii follow the cube law from the number of leaves below, the share of the
    root's flow is at most 1: (by, node_id, parent_id, x, y, z, flow, radius). A tree is one group in memory, a few numbers
    for each point."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").reset_index(drop=True)
        at = pdf[["x", "y", "z"]].to_numpy(float)
        parent = nearest_earlier(at)
        leaf = np.ones(len(at), bool)
        leaf[parent[parent >= 0]] = False
        flow = leaf.astype(float)
        for n in range(len(at) - 1, 0, -1):  # children have larger places than parents
            flow[parent[n]] += flow[n]
        ids = pdf["point_id"].to_numpy()
        radius = np.maximum(root_radius * np.cbrt(np.minimum(flow / flow[0], 1.0)), least_radius)
        up = [None if p < 0 else int(ids[p]) for p in parent]
        return pd.DataFrame({by: pdf[by], "node_id": ids, "parent_id": pd.array(up, "Int64"), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "flow": flow, "radius": radius})

    return points.groupBy(by).applyInPandas(f, f"{by} {kinds[by]}, node_id long, parent_id long, x double, y double, z double, flow double, radius double")
