"""Thinning by blocks, pruning, direct solves, axes, model hooks, tuning and traces, each at two sizes or against plain code."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenflow.operators import axes, gaps, graph, inference, search, skeleton, solve, stencil, voxel


def _mask(spark, n, where):
    return voxel.grid(spark, n, n, n).where(where).withColumn("s", F.lit("a"))


def _cells(df):
    return {(r["i"], r["j"], r["k"]) for r in df.select("i", "j", "k").collect()}


def _parts(cells):
    left, parts = set(cells), 0
    while left:
        todo, parts = [left.pop()], parts + 1
        while todo:
            c = todo.pop()
            near = [tuple(a + b for a, b in zip(c, o, strict=True)) for o in itertools.product((-1, 0, 1), repeat=3)]
            todo += [x for x in near if x in left]
            left.difference_update(near)
    return parts


RING = "(i - 9.5)*(i - 9.5) + (j - 9.5)*(j - 9.5) BETWEEN 30 AND 80 AND k BETWEEN 7 AND 11"
BAR = "i BETWEEN 1 AND 17 AND j BETWEEN 5 AND 8 AND k BETWEEN 15 AND 18"


def test_simple_voxels_by_their_euler_number():
    """A voxel that can go changes neither the number of components nor the Euler number of its surroundings and of their rest."""

    def euler(cells):
        places = {tuple(2 * a + 1 + b for a, b in zip(c, o, strict=True)) for c in cells for o in itertools.product((-1, 0, 1), repeat=3)}
        return sum(1 - 2 * (sum(x % 2 for x in p) % 2) for p in places)

    rng = np.random.default_rng(3)
    around = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
    seen = set()
    for p in np.linspace(0.05, 0.95, 400):
        on = rng.random(26) < p
        near = {o for o, x in zip(around, on, strict=True) if x}
        got = skeleton.simple(sum(1 << n for n, x in enumerate(on) if x))
        seen.add(got)
        if got:
            assert _parts(near | {(0, 0, 0)}) == _parts(near) and euler(near | {(0, 0, 0)}) == euler(near)
        elif near and _parts(near) == 1:
            assert euler(near | {(0, 0, 0)}) != euler(near) or all(o in near for o in around if sum(map(abs, o)) == 1)
    assert seen == {True, False}


@pytest.mark.parametrize("size, rounds", [(64, 1), (64, 3), (7, 1), (5, 2)])
def test_blocks_thin_like_the_whole_volume(spark, size, rounds):
    m = _mask(spark, 20, f"({RING}) OR ({BAR}) OR (i * 7 + j * 5 + k * 3) % 11 = 0 AND k < 4")
    whole = test_blocks_thin_like_the_whole_volume.__dict__.setdefault("whole", _cells(skeleton.thin(m, ["s"], size=64, rounds=2)))
    assert _cells(skeleton.thin(m, ["s"], size=size, rounds=rounds)) == whole


def test_thinning_keeps_the_topology(spark):
    m = _mask(spark, 20, RING).unionByName(_mask(spark, 20, BAR).withColumn("s", F.lit("b")))
    thin = skeleton.thin(m.union(m), ["s"])  # repeated voxels count once
    ring, bar = _cells(thin.where("s = 'a'")), _cells(thin.where("s = 'b'"))
    assert _parts(ring) == _parts(bar) == 1 and len(ring) < 60 and 1 <= len(bar) <= 20
    assert {r["s"]: r["euler"] for r in skeleton.euler(thin, ["s"]).collect()} == {"a": 0, "b": 1} == {r["s"]: r["euler"] for r in skeleton.euler(m, ["s"]).collect()}
    assert stencil.neighbour_counts(thin.where("s = 'a'").select("vid", "i", "j", "k")).where("degree < 2").count() == 0
    assert skeleton.thin(m.limit(0), ["s"]).count() == 0


def test_short_branches_go(spark):
    line = [(x, 10, 10) for x in range(2, 20)]
    spur = lambda x, n: [(x, 10 + d, 10) for d in range(1, n + 1)]
    alone = [(5, 2, 2), (6, 2, 2)]
    cells = line + spur(6, 1) + spur(10, 2) + spur(14, 4) + alone
    df = spark.createDataFrame([(i + 20 * (j + 20 * k), i, j, k) for i, j, k in cells], "vid long, i int, j int, k int")
    left = _cells(skeleton.prune(df, 3))
    assert left >= set(alone) | set(spur(14, 4)) | set(line[1:-1]) and (10, 12, 10) not in left
    assert _cells(skeleton.prune(df, 1)) == set(cells)


def _dense(edges, held):
    ids = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {x: n for n, x in enumerate(ids)}
    k = np.zeros((len(ids),) * 2)
    for a, b, g in edges:
        k[at[a], at[a]] += g
        k[at[b], at[b]] += g
        k[at[a], at[b]] -= g
        k[at[b], at[a]] -= g
    p = np.array([held.get(x, np.nan) for x in ids])
    free = np.isnan(p)
    p[free] = np.linalg.solve(k[np.ix_(free, free)], -k[np.ix_(free, ~free)] @ p[~free])
    return dict(zip(ids, p, strict=True))


def _network(spark, edges, held):
    e = spark.createDataFrame([(a, b, float(g)) for a, b, g in edges], "src long, dst long, g double")
    return e, spark.createDataFrame(list(held.items()), "id long, p double")


@pytest.mark.parametrize("n, extra", [(30, 0), (60, 25)])
def test_networks_are_solved(spark, n, extra):
    rng = np.random.default_rng(n)
    edges = [(int(rng.integers(0, i)), i, float(rng.uniform(0.1, 9))) for i in range(1, n)] + [(*map(int, rng.choice(n, 2, False)), float(rng.uniform(0.1, 9))) for _ in range(extra)]
    edges += [edges[0], (n, n + 1, 2.0), (n + 1, n + 2, 1.0), (5, 5, 3.0)]  # a parallel edge, another component, a loop
    held = {0: 10.0, n - 1: 2.0, n // 2: -4.0, n: 7.0}
    e, bc = _network(spark, edges, held)
    got = {r["id"]: r["p"] for r in solve.network(e, bc).collect()}
    want = _dense([x for x in edges if x[0] != x[1]], held)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


@pytest.mark.parametrize("n", [50, 2000])
def test_chains_take_logarithmically_many_rounds(spark, n):
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(2.0).alias("g"))
    bc = spark.createDataFrame([(0, 0.0), (n, 1.0)], "id long, p double")
    left, rounds = solve.contract(e, bc)
    assert len(rounds) <= 4 * np.log(n) and left.count() == 1
    p = solve.restore(rounds, bc)
    assert p.count() == n + 1 and p.where(F.abs(F.col("p") - F.col("id") / n) > 1e-9).count() == 0


@pytest.mark.parametrize("n", [40, 4000])
def test_axes(spark, n):
    rng = np.random.default_rng(n)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    x = rng.normal(size=(n, 3)) * [9, 3, 1] @ turn.T + [100, -50, 1000]
    p = spark.createDataFrame(pd.DataFrame({"g": "a", "id": range(n), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}))
    got = axes.principal_axes(p, ["g"]).first()
    value, vector = np.linalg.eigh(np.cov(x.T, bias=True))
    for a, v, u in zip(got["axes"], value[::-1], vector.T[::-1], strict=True):
        assert abs(a["value"] / v - 1) < 1e-9 and abs(abs(np.dot([a["x"], a["y"], a["z"]], u)) - 1) < 1e-9
    first = np.array([got["axes"][0][c] for c in "xyz"])
    t = (x - x.mean(0)) @ first
    ends = axes.end_points(p, ["g"]).first()
    assert (ends["low_id"], ends["high_id"]) == (int(t.argmin()), int(t.argmax())) and first[np.abs(first).argmax()] > 0
    assert axes.end_points(p, []).first()["high_id"] == int(t.argmax())
    point = axes.end_points(p.limit(1), ["g"]).first()
    assert point["low_id"] == point["high_id"]


def _loader(weights):
    w = np.frombuffer(weights)
    return lambda x: x * w[0] + x.mean() * 0


@pytest.mark.parametrize("n", [8, 21])
def test_models_predict_tiles(spark, tmp_path, n):
    v = voxel.grid(spark, n, n, n).withColumn("value", F.when(F.col("i") % 5 == 0, None).otherwise(F.col("i") + 0.5 * F.col("k")))
    (tmp_path / f"w{n}").write_bytes(np.array([3.0]).tobytes())
    for weights in (np.array([3.0]).tobytes(), f"{tmp_path}/w{n}"):
        out = inference.predict(v, (n, n, n), inference.Model(spark, _loader, weights), 8, 2)
        off = out.join(v.select("i", "j", "k", F.coalesce("value", F.lit(0.0)).alias("x")), ["i", "j", "k"])
        assert off.count() == n**3 and off.where(F.abs(F.col("value") - 3 * F.col("x")) > 1e-9).count() == 0


def test_models_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(inference, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="11 bytes"):
        inference.Model(spark, _loader, b"x" * 11)
    wrong = inference.Model(spark, lambda _: lambda x: x[:1], b"")
    with pytest.raises(Exception, match="the model made"):
        inference.predict(voxel.grid(spark, 4, 4, 4).withColumn("value", F.lit(1.0)), (4, 4, 4), wrong, 4, 1).collect()


def test_simplex_takes_one_job_a_round(spark):
    """The threshold and steepness of a gate by their soft overlap with a truth, all of a round's points in one job."""
    v = spark.range(2000).select((F.col("id") % 4).alias("s"), (F.col("id") % 100 / 100).alias("x"), (F.col("id") % 100 >= 60).alias("t"))
    asked = []

    def loss(points):
        asked.append(len(points))
        c = [{"at": p[0], "by": np.exp(p[1])} for p in points]
        return [-d for d in search.overlaps(v, ["s"], c, lambda p: 1 / (1 + F.exp(-p("by") * (F.col("x") - p("at")))), "t")]

    (at, _), best = search.nelder_mead(loss, [0.4, 1.5], step=0.5, rounds=25, tolerance=1e-4)
    assert abs(at - 0.6) < 0.06 and best < -0.93 and asked[0] == 3 and set(asked[1:]) == {6}


def test_bridges_have_radii_by_the_cube_law(spark):
    nodes = spark.createDataFrame([(i, 0.0, 0.0, float(i)) for i in range(5)], "id long, x double, y double, z double")
    edges = spark.createDataFrame([(0, 0, 1, 2.0), (1, 2, 3, 4.0), (2, 1, 0, 9.0)], "edge_id long, src long, dst long, radius double")
    b = spark.createDataFrame([(0, 1, 2, []), (1, 3, 4, [])], "bridge_id long, a long, b long, points array<struct<x:double,y:double,z:double>>")
    r = {x["bridge_id"]: x["radius"] for x in graph.bridge_radii(nodes, edges, b).collect()}
    assert abs(r[0] ** 3 - (8 + 64) / 4) < 1e-9 and abs(r[1] ** 3 - (64 + 1.5**3) / 4) < 1e-9
    e = graph.add_bridges(nodes, edges.withColumn("is_fixed", F.lit(True)), graph.bridge_radii(nodes, edges, b))[1]
    assert sorted(x["radius"] for x in e.where("not is_fixed").collect()) == sorted(r.values())


@pytest.mark.parametrize("gap_count, batch", [(3, 256), (40, 7)])
def test_traces_do_not_depend_on_their_batch(spark, monkeypatch, gap_count, batch):
    """Traces of gaps in one group are those of each by itself, walked step by step in mm."""
    monkeypatch.setattr(gaps, "BATCH", batch)
    rng = np.random.default_rng(gap_count)
    mm, shape = np.array([1.0, 0.5, 2.0]), (12, 14, 9)
    fields = {(g, i, j, k): (*rng.normal(size=3).tolist(), float(rng.random())) for g in range(gap_count) for i in range(2, 9) for j in range(12) for k in range(7)}
    axis = rng.normal(size=(gap_count, 2, 3))
    axis /= np.linalg.norm(axis, axis=2, keepdims=True)
    tips = rng.integers(2, 7, size=(gap_count, 2, 3))
    v = spark.createDataFrame([(*c, *x) for c, x in fields.items()], "gap long, i int, j int, k int, fx double, fy double, fz double, v double")
    names = [f"{s}{c}" for s in "ab" for c in "ijk"]
    g = spark.createDataFrame([(n, *map(int, tips[n].ravel()), *map(float, axis[n].ravel())) for n in range(gap_count)], "gap long, " + ", ".join(f"{x} int" for x in names) + ", " + ", ".join(f"{s}_{c} double" for s in "ab" for c in "xyz"))
    for goal in (False, True):
        got = {}
        for r in gaps.trace_both(v, g, ["gap"], shape, 0.97, 0.6, 0.7, 6.0, 1.5, goal, tuple(mm)).orderBy("pos").collect():
            got.setdefault((r["gap"], r["side"]), []).append(r)
        for n in range(gap_count):
            for s in range(2):
                points = np.array([[r["x"], r["y"], r["z"]] for r in got[n, "ab"[s]]])
                assert (points[0] == tips[n, s]).all() and len(points) <= 11
                for x, y in zip(points, points[1:], strict=False):
                    lead = axis[n, s] if not goal else (tips[n, 1 - s] - x) * mm / np.linalg.norm((tips[n, 1 - s] - x) * mm)
                    f = np.array(fields.get((n, *map(int, np.floor(x + 0.5))), (0, 0, 0, 0))[:3])
                    f = f / np.linalg.norm(f) if np.linalg.norm(f) else lead
                    way = 0.7 * (f if f @ lead >= 0 else -f) + 0.3 * lead
                    assert np.allclose((y - x) * mm, 0.6 * way / np.linalg.norm(way), atol=1e-9)
                last = points[-1]
                here = fields.get((n, *map(int, np.floor(last + 0.5))), (0, 0, 0, 0))[3] > 0.97 if not goal else np.linalg.norm((tips[n, 1 - s] - last) * mm) < 1.5
                assert got[n, "ab"[s]][0]["found"] == bool(here and len(points) > 1)


@pytest.mark.parametrize("n", [1, 2, 300, 5000])
def test_nearest_earlier_points(n):
    rng = np.random.default_rng(n)
    for at in (rng.normal(size=(n, 3)), rng.integers(0, 6, size=(n, 3)).astype(float), np.concatenate([rng.normal(size=(n, 3)) * 1e-3, [[1e6, 0, 0], [1e6, 0, 1]]])):
        want = [-1] + [int(((at[:m] - at[m]) ** 2).sum(1).argmin()) for m in range(1, len(at))]
        assert skeleton.nearest_earlier(at).tolist() == want


def test_trees_of_many_points(spark):
    """A hundred thousand points take seconds, not the square of their number."""
    p = spark.range(100_000).select(F.lit("t").alias("tree_id"), F.col("id").alias("point_id"), *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(10**6)) / 1e4).alias(c) for c in "xyz"])
    t = skeleton.grow(p)
    assert t.count() == 100_000 and t.where("parent_id >= node_id").count() == 0


def test_far_nodes_do_not_widen_the_search(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 3)), [[3e4, 0, 0]]])
    nodes = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")
    tree = graph.representatives_mst(nodes, nodes.select("id", F.col("id").alias("component"))).collect()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    inside, total = {0}, 0.0
    while len(inside) < len(x):
        out = [i for i in range(len(x)) if i not in inside]
        a, b = min(((i, j) for i in inside for j in out), key=lambda p: d[p])
        inside.add(b)
        total += d[a, b]
    assert len(tree) == 150 and abs(sum(r["dist"] for r in tree) / total - 1) < 1e-9
    with pytest.raises(ValueError, match="coordinates"):
        bad = nodes.withColumn("x", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("x")))
        graph.representatives_mst(bad, bad.select("id", F.col("id").alias("component")))
