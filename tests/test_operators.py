"""Properties of the operators that SQL doesn't state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.operators import distance, gaps, graph, paths, search, selection, solve, spatial, stencil, voxel


def test_components_of_a_hub_a_chain_and_a_ring(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)]
    got = dict(graph.components(spark.createDataFrame(edges + edges[:3] + [(5, 5), (None, 3)], "a long, b long")).collect())
    assert set(got.values()) == {0, 1000, 2000} and got[1040] == 1000 and got[2006] == 2000 and len(got) == 200 + 41 + 7


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_forest_is_minimal(spark):
    rng = np.random.default_rng(1)
    e = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 30, (80, 2)) if a != b})
    rows = [(a, b, a, b, float(d)) for (a, b), d in zip(e, rng.random(len(e)), strict=True)]
    got = graph.spanning_forest(spark.createDataFrame(rows, "ca long, cb long, a long, b long, dist double"))
    parent = list(range(30))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = []
    for d, a, b in sorted((r[4], r[0], r[1]) for r in rows):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.append((a, b))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(want)


def test_conjugate_gradients_and_samples_agree(spark):
    rng = np.random.default_rng(2)
    e = [(0, i, i + 1, float(rng.random() + 0.5)) for i in range(12)] + [(0, 2, 9, 0.7), (0, 50, 51, 1.0)]
    edges = spark.createDataFrame(e, "sample_id int, src long, dst long, g double")
    bc = spark.createDataFrame([(0, 0, 100.0), (0, 12, 5.0)], "sample_id int, id long, p double")
    dense = {r["id"]: r["p"] for r in solve.solve_samples(edges, bc).collect()}
    assert dense[50] == dense[51] == 0 and dense[0] == 100
    held = bc.select("id", "p").union(spark.createDataFrame([(50, 0.0)], "id long, p double"))
    inner, rhs = solve.eliminate(solve.laplacian(edges), held)
    x = {r["id"]: r["x"] for r in solve.conjugate_gradients(inner, rhs).collect()}
    assert x and all(abs(x[i] - dense[i]) < 1e-6 for i in x)
    flow = solve.flows(edges, spark.createDataFrame(list(dense.items()), "id long, p double"))
    assert abs(flow.where("src = 0").first()["flow"] - flow.where("src = 11").first()["flow"]) < 1e-9  # what goes in comes out


def test_edt_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.random((7, 6, 5)) < 0.9
    rows = [(i, j, k, bool(m[i, j, k])) for i in range(7) for j in range(6) for k in range(5)]
    out = np.argwhere(~m)
    sp = np.array([1.0, 2.0, 0.5])
    v = spark.createDataFrame(rows, "i int, j int, k int, m boolean")
    for r in distance.squared_edt(v, "m", (7, 6, 5), tuple(sp)).collect():
        assert abs(r["d2"] - ((((out - [r["i"], r["j"], r["k"]]) * sp) ** 2).sum(1)).min()) < 1e-9


def test_edt_of_a_full_volume_is_null(spark):
    v = voxel.grid(spark, 3, 3, 3).withColumn("m", F.lit(True))
    assert distance.squared_edt(v, "m", (3, 3, 3)).where("d2 is not null").count() == 0


def test_eigenvalues_match_numpy(spark):
    rng = np.random.default_rng(4)
    m = [((a := rng.normal(size=(3, 3))) + a.T) / 2 for _ in range(50)] + [np.eye(3), np.zeros((3, 3)), np.diag([1.0, 1.0, 2.0])]
    df = spark.createDataFrame([(n, *(float(x[i]) for i in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))) for n, x in enumerate(m)], "n int, a double, b double, c double, d double, e double, f double")
    for r in df.select("n", F.array(*stencil.eigen3(*[F.col(c) for c in "abcdef"])).alias("e")).collect():
        assert np.allclose(sorted(r["e"]), np.linalg.eigvalsh(m[r["n"]]), atol=1e-7)


def test_block_smoothing_equals_the_joined_convolution(spark):
    v = voxel.grid(spark, 12, 9, 7).withColumn("value", F.expr("CAST((i * 7 + j * 5 + k * 3) % 11 AS DOUBLE)"))
    cur = v
    for c, n in zip("ijk", (12, 9, 7), strict=True):
        cur = stencil.convolve(cur, c, n, stencil.kernel(1.0, 0))
    a = {tuple(r[:3]): r[3] for r in cur.collect()}
    b = {tuple(r[:3]): r[3] for r in stencil.smooth_blocks(v, 1.0, 4).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_shortest_path_goes_around(spark):
    rows = [("g", i, j, 0, 100.0 if i == 2 and j != 4 else 1.0, {(0, 0): "a", (4, 0): "b"}.get((i, j), "")) for i in range(5) for j in range(5)]
    p = paths.shortest_in_box(spark.createDataFrame(rows, "gap string, i int, j int, k int, cost double, role string"), ["gap"]).orderBy("pos").collect()
    assert (p[0]["i"], p[0]["j"], p[-1]["i"], p[-1]["j"]) == (0, 0, 4, 0) and p[0]["total"] == 12.0 and any(r["j"] == 4 for r in p)


def test_trace_reaches_its_goal(spark):
    rows = [("g", i, 0, 0, 1.0, 0.0, 0.0, {0: "a", 9: "b"}.get(i, "")) for i in range(10)]
    t = paths.trace(spark.createDataFrame(rows, "gap string, i int, j int, k int, fx double, fy double, fz double, role string"), ["gap"]).orderBy("pos").collect()
    assert t[-1]["reached"] and t[-1]["x"] == 9.0


def test_bridges_get_new_ids(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 9.0, 0.0, 0.0)], "id long, x double, y double, z double")
    edges = spark.createDataFrame([(0, 0, 1, 1.0, True)], "edge_id long, src long, dst long, radius double, is_fixed boolean")
    b = spark.createDataFrame([(0, 0, 1, [(3.0, 0.0, 0.0), (6.0, 0.0, 0.0)]), (1, 1, 0, [])], "bridge_id int, a long, b long, points array<struct<x:double,y:double,z:double>>")
    n, e = graph.add_bridges(nodes, edges, b)
    assert sorted(r["id"] for r in n.collect()) == [0, 1, 2, 3]
    assert sorted((r["src"], r["dst"]) for r in e.where("not is_fixed").collect()) == [(0, 2), (1, 0), (2, 3), (3, 1)]


def test_nelder_mead_finds_a_minimum():
    p, v = search.nelder_mead(lambda xs: [(x[0] - 1) ** 2 + (x[1] + 2) ** 2 for x in xs], [0.0, 0.0])
    assert v < 1e-3 and abs(p[0] - 1) < 0.05


@pytest.mark.parametrize("n,patch,overlap", [(16, 8, 2), (17, 8, 2), (5, 8, 2), (64, 64, 8), (100, 64, 8)])
def test_tiles_cover(n, patch, overlap):
    s = voxel.starts(n, patch, overlap)
    assert all(any(a <= x < a + patch for a in s) for x in range(n))


def test_representatives_always_connect(spark):
    nodes = spark.createDataFrame([(i, float(i * i), 0.0, 0.0) for i in range(6)], "id long, x double, y double, z double")
    comp = nodes.select("id", F.col("id").alias("component"))
    assert graph.representatives_mst(nodes, comp).count() == 5


def test_radius_pairs_on_negative_coordinates_and_borders(spark):
    rows = [(0, -1.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 1.0, 1.0, 0.0)]
    p = spatial.radius_pairs(spark.createDataFrame(rows, "id long, x double, y double, z double"), 1.0)
    assert sorted((r["a"], r["b"]) for r in p.collect()) == [(0, 1), (1, 2), (2, 3)]


def test_bridges_get_new_numbers(spark):
    """Also where the largest number is 0, or there is none."""
    node = lambda *ids: spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in ids], "id long, x double, y double, z double")
    edge = lambda *ids: spark.createDataFrame([(i, 0, 0, 1.0, True) for i in ids], "edge_id long, src long, dst long, radius double, is_fixed boolean")
    bridge = spark.createDataFrame([(1, 0, 0, [(0.5, 0.0, 0.0)]), (2, 0, 0, [])], "bridge_id long, a long, b long, points array<struct<x:double,y:double,z:double>>")
    for n, e in ((node(0), edge(0)), (node(0), edge())):
        nodes, edges = graph.add_bridges(n, e, bridge)
        assert sorted(r["id"] for r in nodes.collect()) == [0, 1]
        assert sorted(r["edge_id"] for r in edges.collect()) == list(range(e.count() + 3))


def test_gradients_that_do_not_converge_raise(spark):
    n = 40
    rows = [(i, j, 2.0 if i == j else -1.0) for i in range(n) for j in range(n) if abs(i - j) <= 1]
    a, b = spark.createDataFrame(rows, "row long, col long, value double"), spark.createDataFrame([(0, 1.0)], "id long, b double")
    with pytest.raises(ArithmeticError):
        solve.conjugate_gradients(a, b, most=3)


def test_a_graph_in_parts_is_no_single_component(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    with pytest.raises(ValueError, match="2 components"):
        graph.connected(nodes, spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))


def test_fronts_arrive_by_distance():
    t = gaps.arrival_times(np.full((21, 21, 21), 2.0), (10, 10, 10))
    d = np.linalg.norm(np.indices((21, 21, 21)).transpose(1, 2, 3, 0) - 10, axis=-1) / 2
    assert np.abs(t - d).max() < 0.75 and np.allclose(t[10, 10], np.abs(np.arange(21) - 10) / 2)
    path = gaps.descend(t, (2, 4, 10))
    assert path[0] == (2, 4, 10) and path[-1] == (10, 10, 10) and len(path) <= 12
    wall = np.ones((5, 5, 5))
    wall[2] = 0
    assert gaps.descend(gaps.arrival_times(wall, (0, 0, 0)), (4, 4, 4)) == []


def test_traces_meet_in_a_gap(spark):
    """A straight flow along k leads both traces into the gap; they stop where the vessel resumes."""
    cells = [(1, i, j, k, 0.0, 0.0, 1.0, 0.9 if k < 4 or k > 9 else 0.1) for i in range(3) for j in range(3) for k in range(14)]
    v = spark.createDataFrame(cells, "gap int, i int, j int, k int, fx double, fy double, fz double, v double")
    g = spark.createDataFrame([(1, 1, 1, 4, 1, 1, 9, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0)], "gap int, ai int, aj int, ak int, bi int, bj int, bk int, a_x double, a_y double, a_z double, b_x double, b_y double, b_z double")
    out = gaps.trace_both(v, g, ["gap"], (3, 3, 14), 0.5).collect()
    a, b = ([r for r in out if r["side"] == s] for s in "ab")
    assert a[-1]["found"] and b[-1]["found"] and a[-1]["z"] == 9.5 and b[-1]["z"] == 3.0 and all(r["x"] == r["y"] == 1.0 for r in out)
    near = gaps.trace_both(v, g, ["gap"], (3, 3, 14), 0.5, goal=True).collect()
    assert all(r["found"] for r in near) and gaps.trace_both(v.limit(0), g.limit(0), ["gap"], (3, 3, 14), 0.5).count() == 0


def test_gaps_are_filled(spark):
    """Two collinear vessels, and one that faces none of them: one bridge, accepted, joins two components."""
    from lumenflow.config import GapFilling
    from lumenflow.plans import pipelines

    skel = [(8, 8, k) for k in range(3, 8)] + [(8, 8, k) for k in range(12, 17)] + [(3, j, 3) for j in range(3, 9)]
    vid = lambda i, j, k: i + 16 * (j + 16 * k)
    s = spark.createDataFrame([(vid(*c), *c) for c in skel], "vid long, i int, j int, k int")
    v = voxel.grid(spark, 16, 16, 20).withColumn("tip", F.expr("(i = 8 and j = 8 and k in (7, 12)) or (i = 3 and j = 8 and k = 3)"))
    on = F.expr("(i = 8 and j = 8 and (k < 7 or k > 12)) or (i = 3 and k = 3 and j < 8)")
    v = v.withColumn("v", F.when(F.col("tip"), 0.4).when(on, 0.9).otherwise(0.1)).select(
        "vid", "i", "j", "k", "v", F.lit(0.9).alias("a"), F.lit(0.9).alias("b"), F.lit(0.8).alias("hu"), F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"), F.lit(1.0).alias("fz")
    )
    report, comp = pipelines.fill_gaps(v, s, (16, 16, 20), GapFilling(island_voxels=3))
    rows = report.collect()
    assert [(r["a"], r["b"], r["method"], r["action"]) for r in rows] == [(vid(8, 8, 7), vid(8, 8, 12), "fast_march", "accepted")] and 0.65 <= rows[0]["score"] <= 1
    assert comp.select("component").distinct().count() == 2
    traced, _ = pipelines.fill_gaps(v.withColumn("v", F.when(F.expr("i = 8 and j = 8 and k in (9, 10)"), 0.5).otherwise(F.col("v"))), s, (16, 16, 20), GapFilling(island_voxels=3))
    assert [r["method"] for r in traced.collect()] == ["flow"]
    marks = gaps.markers(report, [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], "accepted").collect()
    assert marks[0]["z"] == 9.5 and marks[0]["label"].startswith("gap_001_conf0.")


def test_factor_maps_of_a_tube(spark):
    """The axis of a tube wins, at a scale near its radius; clipping and scaling change nothing about the order."""
    v = voxel.grid(spark, 12, 12, 12).withColumn("value", F.when(F.expr("(i - 6) * (i - 6) + (j - 6) * (j - 6) <= 4"), 300.0).otherwise(-50.0))
    got = stencil.factor_maps(v, (12, 12, 12), [1.0, 2.0])
    axis = {(r["i"], r["j"]): r for r in got.where("k = 6").collect()}
    assert max(axis, key=lambda c: axis[c]["v"]) == (6, 6) and all(0 <= r[c] <= 1 for r in axis.values() for c in ("v", "a", "b"))
    assert axis[6, 6]["a"] > 0.8 and axis[6, 6]["b"] > 0.95 and axis[0, 0]["v"] == axis[0, 0]["a"] == 0
    clip = {(r["i"], r["j"]): r["v"] for r in stencil.clipped_vesselness(v, (12, 12, 12), [1.0, 2.0], gamma=0.5).where("k = 6").collect()}
    assert max(clip, key=clip.get) == (6, 6)


def test_coordinate_search_climbs():
    at, top, trials = search.coordinate_search(lambda ps: [-((p["x"] - 3) ** 2) - (p["y"] - 1) ** 2 for p in ps], {"x": [0, 1, 3, 5], "y": [0, 1, 2]}, rounds=3)
    assert at == {"x": 3, "y": 1} and top == 0 and trials[0] == ({"x": 0, "y": 0}, -10)


def test_warps_and_small_samples(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5, 0.5, "n")], "id long, x double, y double, z double, name string")
    assert selection.warp(p).collect() == p.collect()
    t = selection.thirds(spark.createDataFrame([(1, 0.0), (2, 1.0)], "id long, x double"))
    assert sorted((r["part"], r["id"]) for r in t.collect()) == [(p, i) for p in ("left", "middle", "right") for i in (1, 2)]
    assert selection.thirds(spark.createDataFrame([], "id long, x double")).count() == 0
    s = selection.upstream_seed(p, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), 1).collect()
    assert [r["id"] for r in s] == [1]


def test_patches_hold_their_voxels(spark):
    v = voxel.grid(spark, 8, 8, 8).select(F.lit("a").alias("s"), "vid", "i", "j", "k", F.col("vid").cast("double").alias("value"))
    corners = selection.patches(v.where("vid % 97 = 5"), "s", (8, 8, 8), 4, 3, 1)
    for r in corners.collect():
        cube = {(q["i"], q["j"], q["k"]): q["value"] for q in selection.patch_values(v, corners, "s", 4).where(F.col("patch") == r["patch"]).collect()}
        assert len(cube) == 64
        at = [3 if r[f"flip_{c}"] else 0 for c in "ijk"]
        assert cube[tuple(at)] == r["i0"] + 8 * (r["j0"] + 8 * r["k0"])
