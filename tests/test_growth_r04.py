"""What the fourth round's findings asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.functions import special
from lumenflow.operators import search, solve, spatial
from lumenflow.plans import catalog, gaps, points, vessels  # noqa: F401
from tests import oracle


def test_a_simplex_moves_until_it_has_converged():
    """A curved valley, which takes far more than a dozen rounds, and a slope that is flat at the start's simplex."""
    asked = []

    def valley(points):
        asked.append(len(points))
        return [(1 - x) ** 2 + 100 * (y - x * x) ** 2 for x, y in points]

    p, v = search.nelder_mead(valley, [-1.2, 1.0], tolerance=1e-8)
    assert abs(p[0] - 1) < 1e-6 and abs(p[1] - 1) < 1e-6 and v < 1e-12 and len(asked) > 50
    p, _ = search.nelder_mead(lambda xs: [(x[0] - 5.5) ** 2 for x in xs], [5.0], step=0.2, tolerance=1e-4)  # equal values on both sides
    assert abs(p[0] - 5.5) < 1e-3


def test_voxels_without_a_score_are_one_row(spark):
    rng = np.random.default_rng(1)
    rows = [(int(n % 3), *map(float, rng.normal(size=3)), bool(rng.random() < 0.4)) for n in range(400)] + [(1, None, -1.0, None, True)]
    v = spark.createDataFrame(rows, "sample int, l1 double, l2 double, l3 double, truth boolean")
    few = vessels._scored(v)
    assert few.count() == 3 + v.where("l2 < 0 and l3 < 0").count() < 200
    c = [{"alpha": a, "beta": 0.5, "c": 0.25} for a in (0.3, 0.8)]
    want, got = (search.overlaps(x, ["sample"], c, vessels._tubularity, "truth") for x in (v, few))
    assert np.allclose(want, got, rtol=1e-12) and few.agg(F.sum("truth")).first()[0] == v.where("truth").count()


def _long_network(n=400):
    """A long network of tangles with side branches: (edges, held, places)."""
    rng = np.random.default_rng(n)
    at = [(float(rng.integers(0, 6)), float(rng.integers(0, 6)), float(z)) for z in range(n) for _ in range(4)]
    edges = [(a, a + int(d), float(rng.uniform(0.1, 5))) for a in range(len(at) - 9) for d in rng.choice(np.arange(1, 9), 3)] + [(0, 1, 1.0), (0, 1, 2.0), (5, 5, 1.0)]
    held = [(int(x), float(x % 7)) for x in rng.choice(len(at) - 9, n // 10, replace=False)] + [(10**6, 3.0)]
    return edges, held, [(x, *p) for x, p in enumerate(at)]


@pytest.mark.parametrize("n, side, most", [(400, 8.0, 2000), (20, 8.0, 20), (400, 64.0, 90)])
def test_blocks_give_the_pressures_of_the_whole_network(spark, monkeypatch, n, side, most):
    edges, held, places = _long_network(n)
    ids = sorted({x for a, b, _ in edges for x in (a, b)})
    k = np.zeros((len(ids), len(ids)))
    for a, b, g in [(*np.searchsorted(ids, (a, b)), g) for a, b, g in edges]:
        if a != b:
            k[[a, b], [a, b]] += g
            k[[a, b], [b, a]] -= g
    known = dict(held)
    p = np.array([known.get(x, np.nan) for x in ids])
    free = np.isnan(p)
    p[free] = np.linalg.solve(k[np.ix_(free, free)], -k[np.ix_(free, ~free)] @ p[~free])
    want = dict(zip(ids, p, strict=True))
    seen = []
    real = solve.conjugate_gradients
    monkeypatch.setattr(solve, "conjugate_gradients", lambda *a: seen.append(1) or real(*a))
    e, h, at = (spark.createDataFrame(rows, schema) for rows, schema in ((edges, "src long, dst long, g double"), (held, "id long, p double"), (places, "id long, x double, y double, z double")))
    got = solve.network_by_blocks(e, h, at, side=side, most=most).collect()
    assert len(got) == len(ids) + 1 and {r["id"] for r in got} == {*ids, 10**6}
    assert all(abs(r["p"] - want[r["id"]]) < 1e-6 for r in got if r["id"] < 10**6)
    assert bool(seen) == (most == 20)  # cubes that are too full to be merged are left to conjugate gradients


def test_a_network_with_places_takes_few_jobs(spark):
    """Jobs grow with the logarithm of a network's length: elimination by rounds of independent nodes took some thousand stages here."""
    edges, held, places = _long_network()
    e, h, at = (spark.createDataFrame(rows, schema) for rows, schema in ((edges, "src long, dst long, g double"), (held, "id long, p double"), (places, "id long, x double, y double, z double")))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("blocks", "")
    assert solve.network_by_blocks(e, h, at).where("p is null").count() == 0
    assert len(tracker.getJobIdsForGroup("blocks")) < 120


@pytest.mark.parametrize("name", ["bridge_score", "weighted_bridge_score", "straight_bridges"])
def test_pairs_take_a_few_operations_each(spark, sf, name):
    """Pairs neither walk through arrays, which no code is generated for, nor are rounded as decimal text."""
    text = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in text and "lambda" not in text and " round(" not in text


def test_rounding_is_that_of_round(spark):
    rng = np.random.default_rng(6)
    x = [*map(float, rng.normal(size=3000)), 0.5, -0.5, 2.25, -2.25, 0.0, -0.0, -1e-9, 123456.7890125, None]
    d = spark.createDataFrame([(v,) for v in x], "x double")
    got = d.select(F.round("x", 6) + 0.0, special.rounded(F.col("x"), 6), F.round("x", 1) + 0.0, special.rounded(F.col("x"), 1)).collect()
    assert all(str(r[0]) == str(r[1]) and str(r[2]) == str(r[3]) for r in got)


def test_a_network_of_points_makes_no_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(solve, "POINTS", 40)
    monkeypatch.setattr(solve, "LOOK", 500)
    monkeypatch.setattr(spatial, "radius_pairs", None)
    rng = np.random.default_rng(11)
    at = rng.uniform(0, 1, (240, 3)) * [1, 1, 0.2]
    at[7] = at[8]  # the same place
    label, w = np.arange(240) % 2, rng.uniform(0.5, 2, 240)
    rows = [(int(s), i, *map(float, x), float(v)) for i, (s, x, v) in enumerate(zip(label, at, w, strict=True))] + [(0, 1000, None, 0.1, 0.1, 1.0), (1, 1001, float("nan"), 0.1, 0.1, 1.0)]
    held = [(i, float(i % 9)) for i in range(0, 240, 7)] + [(1000, 2.0), (1001, 4.0)]
    points = spark.createDataFrame(rows, "label int, id long, x double, y double, z double, w double")
    got = solve.network_of_points(points, spark.createDataFrame(held, "id long, p double"), 0.35, lambda a, b, d: (a + b) / np.maximum(d, 0.01), ["label"]).collect()
    dist = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    g = np.where((dist <= 0.35) & (label[:, None] == label[None]) & ~np.eye(240, dtype=bool), (w[:, None] + w[None]) / np.maximum(dist, 0.01), 0)
    k, known = np.diag(g.sum(1)) - g, dict(held)
    p = np.array([known.get(i, np.nan) for i in range(240)])
    free = np.isnan(p)
    p[free] = np.linalg.solve(k[np.ix_(free, free)], -k[np.ix_(free, ~free)] @ p[~free])
    assert len(got) == 242 and all(abs(r["p"] - (p[r["id"]] if r["id"] < 240 else known[r["id"]])) < 1e-8 for r in got)
    assert all((r["residual"] is None) == (r["id"] in known) and abs(r["residual"] or 0) < 1e-8 for r in got)


def test_pressures_of_repeated_ids(spark, tmp_path):
    """Ids of two points, with and without links, and a point far from all."""
    at = [(1, 0.0), (2, 0.01), (2, 0.5), (10, 0.02), (10, 0.51), (3, -3.0), (4, 5.0), (4, 6.0), (20, 8.0), (20, 9.0), (5, 0.52)]
    spark.createDataFrame([(i, [x, 0.0, 0.0, 0.2, 0.1, 0.1], 0) for i, x in at], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("pressure_solve", "pressure_by_sample"):
        oracle.same(catalog.QUERIES[name](spark, str(tmp_path)), catalog.ORACLE_SQL[name], oracle.connect(str(tmp_path)))
