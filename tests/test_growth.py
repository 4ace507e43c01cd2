"""Larger and deeper inputs: what the small tables don't show."""

import numpy as np
from pyspark.sql import functions as F

from lumenflow.operators import distance, graph, paths, selection, spatial, stencil
from lumenflow.operators import gaps as gap_ops
from lumenflow.plans import catalog, gaps, points, tabular, vessels, volumes  # noqa: F401
from tests import oracle


def _lines(spark, path, rows):
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_orderkey long, l_discount double, l_quantity double").write.parquet(f"{path}/lineitem.parquet")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_box_between_points_stays_in_the_cube_of_a_deep_volume(spark, tmp_path):
    _lines(spark, tmp_path, [(1, 12, 34 * 1024, 0.1, 7.0), (1, 12, 5 * 1024, 0.1, 3.0)])
    oracle.same(catalog.QUERIES["box_between_points"](spark, str(tmp_path)), catalog.ORACLE_SQL["box_between_points"], oracle.connect(str(tmp_path)))


def _deep(spark, n):
    """Two lines along k with few outside places, one of them without any."""
    return spark.range(2 * n).select((F.col("id") % 2).cast("int").alias("i"), F.lit(0).alias("j"), F.expr("cast(id div 2 as int)").alias("k")).withColumn(
        "in", (F.col("i") == 1) | ~F.col("k").isin(3, n // 2, n // 2 + 1, n - 9)
    )


def _deep_d2(n):
    k = np.arange(n)
    line = np.min([(k - z) ** 2 for z in (3, n // 2, n // 2 + 1, n - 9)], axis=0)
    return {(i, int(z)): int(line[z]) + i for i in (0, 1) for z in k}


def test_long_lines_are_cut_to_pieces(spark):
    n = 2 * distance.PIECE + 100
    got = distance.squared_edt_joined(_deep(spark, n), "in")
    assert _plan(got).count("collect_list") == 2  # arrays along j and i only
    assert {(r["i"], r["k"]): r["d2"] for r in got.collect()} == _deep_d2(n)


def test_bundles_never_hold_the_longest_axis(spark):
    n = 2 * distance.PIECE + 100
    got = distance.squared_edt(_deep(spark, n), "in", (2, 1, n))
    assert _plan(got).count("FlatMapGroupsInPandas") == 2
    assert {(r["i"], r["k"]): r["d2"] for r in got.collect()} == _deep_d2(n)


def test_points_are_not_dealt_to_a_cube_each(spark):
    v = spark.range(64).select(*[F.expr(f"cast(id div {n} % 4 as int)").alias(c) for c, n in zip("ijk", (1, 4, 16), strict=True)], F.col("id").cast("double").alias("value"))
    p = spark.range(1000).select("id", F.lit(1).alias("i"), F.lit(4).alias("j"), F.lit(0).alias("k"))
    mean = spatial.neighbourhood_mean(p, v, 1)
    patch = selection.neighbourhood(p, v, 1)
    for df in (mean, patch):
        text = _plan(df)
        assert "Generate" not in text[text.index("Join") : text.index("Range (0, 1000")]
    near = [float(i + 4 * 3 + 16 * k) for i in (0, 1, 2) for k in (0, 1)]
    assert {(r["mean"], r["n"]) for r in mean.collect()} == {(sum(near) / 6, 6)} and mean.count() == 1000
    assert {tuple(r["patch"]) for r in patch.collect()} == {tuple(near)} and patch.count() == 1000


def _cloud(spark):
    rng = np.random.default_rng(4)
    lattice = [(x * 0.05, y * 0.05, 3.0) for x in range(6) for y in range(3)]  # neighbours at the radius itself, up to rounding
    at = [*rng.normal(0, 0.12, (500, 3)).tolist(), *lattice, *rng.uniform(0, 0.01, (60, 3)).tolist(), (5.0, 5.0, 5.0), (5.0, 5.0, 5.0)]
    order = rng.permutation(len(at))
    return spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(order, at, strict=True)] + [(9000, None, 1.0, 1.0), (9001, None, 1.0, 1.0)], "id long, x double, y double, z double")


def test_clusters_without_their_links(spark):
    p = _cloud(spark)
    want = dict(graph.components_of(p, spatial.radius_pairs(p, 0.05)).collect())
    assert {r["id"]: r["component"] for r in spatial.clusters(p, 0.05).collect()} == want and len(set(want.values())) > 20
    comp = spark.createDataFrame(list(want.items()), "id long, component long")
    rows = spatial.across(p, comp, 0.15).collect()
    got = {(r["a"], r["b"], round(r["dist"], 9), r["ca"], r["cb"]) for r in rows}
    assert len(got) == len(rows)
    assert got == {(r["a"], r["b"], round(r["dist"], 9), want[r["a"]], want[r["b"]]) for r in spatial.radius_pairs(p, 0.15).collect() if want[r["a"]] != want[r["b"]]}
    e = spatial.radius_pairs(p, 0.05).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    assert sorted(spatial.sparse(p, 0.05).collect()) == sorted(graph.leaves(p, e).collect())


def test_a_dense_ball_gives_few_links(spark, monkeypatch):
    seen = []
    real = graph.components
    monkeypatch.setattr(graph, "components", lambda links, *a: seen.append(links.count()) or real(links, *a))
    p = spark.range(3000).select("id", *[(F.rand(n) * 0.02).alias(c) for n, c in enumerate("xyz")])
    p = spark.createDataFrame(p.collect(), p.schema)
    assert spatial.distinct_points(p, 0.05).collect()[0]["n"] == 3000
    assert sum(seen) < 3000  # of 4.5 million pairs


def test_scores_of_arrays_are_those_of_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(b, n, *map(float, rng.random(5))) for b, size in enumerate((1, 2, 3, 10)) for n in range(size)]
    s = spark.createDataFrame(rows, "g int, pos int, a double, b double, v double, hu double, cosine double")
    one = s.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "v", "hu", "cosine"))).alias("s"))
    both = one.select("g", paths.bridge_score_of(F.col("s")).alias("x"), gap_ops.weighted_score_of(F.col("s")).alias("y"))
    want = paths.bridge_score(s, ["g"], "pos").withColumnRenamed("score", "x").join(gap_ops.weighted_score(s, ["g"], "pos").withColumnRenamed("score", "y"), "g")
    at = lambda df: np.array(sorted((r["g"], r["x"], r["y"]) for r in df.collect()))
    assert np.allclose(at(both), at(want), atol=1e-12)


def test_bridge_samples_are_not_shuffled(spark, sf):
    for q in ("bridge_score", "weighted_bridge_score"):
        assert not any(x in _plan(catalog.QUERIES[q](spark, sf)) for x in ("Window", "Aggregate"))


def test_a_hessian_deals_the_volume_once_for_each_axis(spark):
    v = spark.range(27).select(*[F.expr(f"cast(id div {n} % 3 as int)").alias(c) for c, n in zip("ijk", (1, 3, 9), strict=True)], F.col("id").cast("double").alias("value"))
    text = stencil.hessian(v)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 3
