"""End-to-end plans: from a label volume to pressures and flows, from gaps to accepted bridges, from two point sets to matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut
from lumenflow.config import Completion, FlowNetwork, GapFilling, Landmarks
from lumenflow.functions import physics
from lumenflow.operators import distance, gaps, graph, landmarks, paths, skeleton, solve, spatial, stencil, voxel


def flow_network(volume: DataFrame, shape: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), c: FlowNetwork = FlowNetwork()) -> tuple[DataFrame, DataFrame]:
    """(nodes with radius and pressure, edges with conductance and flow) of one dense label volume (vid, i, j, k, value).

    Vessel voxels are thinned; neighbouring skeleton voxels are edges; radii come from the distance to the outside;
    components within the gap are bridged by phantom edges; the widest leaf is the inlet, the other leaves are outlets.
    """
    skel = skeleton.thin(voxel.label_mask(volume, c.label), [])
    d = distance.squared_edt(volume.withColumn("in", F.col("value") == c.label), "in", shape, spacing).where("d2 > 0").withColumn("value", F.sqrt("d2"))
    nodes = cut(
        spatial.lookup(skel, d, floor=c.radius_floor_mm).select(
            F.col("vid").alias("id"), *[(F.col(o) * s).alias(x) for o, x, s in zip("ijk", "xyz", spacing, strict=True)], "radius"
        )
    )
    real = cut(stencil.neighbour_edges(skel))
    comp = cut(graph.components_of(nodes, real.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    leaf = cut(graph.leaves(nodes, real))
    near = spatial.radius_pairs(nodes.join(leaf.select("id"), "id", "left_semi"), c.gap_mm)
    bridges = cut(graph.phantom_edges(near, comp, leaf, c.gap_mode).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    at = lambda n: nodes.select(F.col("id").alias(n), F.col("radius").alias(f"r_{n}"), *[F.col(x).alias(f"{x}_{n}") for x in "xyz"])
    both = real.withColumn("is_phantom", F.lit(False)).unionByName(bridges.withColumn("is_phantom", F.lit(True)))
    length = F.sqrt(sum(((F.col(f"{x}_src") - F.col(f"{x}_dst")) * (F.col(f"{x}_src") - F.col(f"{x}_dst")) for x in "xyz"), F.lit(0.0)))
    edges = both.join(at("src"), "src").join(at("dst"), "dst").select(
        "src", "dst", "is_phantom", ((F.col("r_src") + F.col("r_dst")) / 2).alias("radius_mm"), length.alias("length_mm")
    )
    edges = cut(
        edges.withColumn(
            "g",
            F.when(F.col("is_phantom"), physics.phantom_conductance(F.col("radius_mm"), F.col("length_mm"), c.alpha, c.viscosity))
            .otherwise(physics.conductance(F.col("radius_mm"), F.col("length_mm"), c.viscosity)) * physics.MM3_PER_M3,
        )
    )
    wide = spatial.top_ranked(leaf.select("id").join(nodes.select("id", "radius"), "id"), "radius", 1).select(F.col("id").alias("inlet"))
    # one row
    fixed = leaf.select("id").join(F.broadcast(wide), F.col("id") == F.col("inlet"), "left")
    bc = fixed.select("id", F.when(F.col("inlet").isNotNull(), c.p_in_mmhg).otherwise(c.p_out_mmhg).cast("double").alias("p"))
    whole = gaps.merge_components(comp, bridges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    held = cut(bc.unionByName(solve.floating(nodes, whole, bc).select("id", F.lit(c.p_out_mmhg).alias("p"))))
    pressure = cut(solve.network_by_blocks(edges, held, nodes))
    flow = solve.flows(edges, pressure.withColumn("p", physics.mmhg_to_pa(F.col("p"))))
    return nodes.join(pressure, "id").withColumnRenamed("p", "pressure_mmhg"), flow.withColumnRenamed("flow", "flow_mm3s")


def complete_gaps(nodes: DataFrame, edges: DataFrame, cost: DataFrame, geometry: DataFrame, c: Completion = Completion()) -> DataFrame:
    """Gap report of a network in voxel units: leaf pairs of different components within the gap, the cheapest path through
    the cost volume in their box, its score and action: (a, b, dist, voxels, score, action). ``geometry`` holds (i, j, k, v:
    vesselness, a, b: its factors, hu: plausibility)."""
    leaf = graph.leaves(nodes, edges)
    comp = graph.components_of(nodes, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    near = spatial.radius_pairs(nodes.join(leaf.select("id"), "id", "left_semi"), c.gap_mm)
    pairs = cut(graph.closest_pairs(near, comp).select("a", "b", "dist").withColumn("gap", F.concat_ws("-", "a", "b")))
    at = lambda n: nodes.select(F.col("id").alias(n), *[F.col(x).cast("int").alias(f"{n}{o}") for x, o in zip("xyz", "ijk", strict=True)])
    box = pairs.join(at("a"), "a").join(at("b"), "b")
    for o in "ijk":
        lo, hi = F.least(f"a{o}", f"b{o}") - 3, F.greatest(f"a{o}", f"b{o}") + 3
        box = box.withColumn(o, F.explode(F.sequence(lo, hi)))
    role = lambda n: F.col("i").eqNullSafe(F.col(f"{n}i")) & (F.col("j") == F.col(f"{n}j")) & (F.col("k") == F.col(f"{n}k"))
    cells = box.join(cost.select("i", "j", "k", "cost"), ["i", "j", "k"]).select("gap", "i", "j", "k", "cost", F.when(role("a"), "a").when(role("b"), "b").otherwise("").alias("role"))
    path = cut(paths.shortest_in_box(cells, ["gap"]))
    samples = path.join(geometry.select("i", "j", "k", "v", "a", "b", "hu"), ["i", "j", "k"])
    score = gaps.weighted_score(samples, ["gap"], "pos", *c.weights[:3])
    size = path.groupBy("gap").agg(F.count("*").alias("voxels"))
    out = pairs.join(score, "gap").join(size, "gap")
    return out.select("a", "b", "dist", "voxels", "score", voxel.tri_state(F.col("score"), c.auto, c.review).alias("action"))


def fill_gaps(
    voxels: DataFrame, skeleton: DataFrame, shape: tuple[int, int, int], c: GapFilling = GapFilling(), resume: float = 0.44, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
) -> tuple[DataFrame, DataFrame]:
    """(report, components) of the gaps of one skeleton (vid, i, j, k), with lengths in mm.

    ``voxels``: (vid, i, j, k, v: vesselness, a, b: its factors, hu: plausibility, fx, fy, fz: flow). Tips where a vessel breaks
    off, on islands of enough voxels, are paired within the gap if they face each other; each pair is traced from both
    sides, or else bridged by the path of first arrival through a cost of vesselness, geometry and plausibility; bridges are
    scored, and accepted ones join components. Report: (gap, a, b, dist, ai.. bk, method, score, action); gaps are
    numbered from 1 in the order of their tips.
    """
    near = cut(stencil.neighbour_edges(skeleton))
    nodes = skeleton.select(F.col("vid").alias("id"))
    links = near.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    comp = cut(graph.components_of(nodes, links))
    large = graph.island_filter(nodes, links, c.island_voxels).select(F.col("id").alias("vid"))
    tips = gaps.break_tips(skeleton, voxels.select("vid", F.col("v").alias("value")), shape, resume).join(large, "vid", "left_semi")
    inner = skeleton.select(F.col("vid").alias("inner_vid"), *[F.col(o).alias(f"_{o}") for o in "ijk"])
    out = [(F.col(o) - F.col(f"_{o}")) * s for o, s in zip("ijk", spacing, strict=True)]
    norm = F.sqrt(sum((x * x for x in out), F.lit(0.0)))
    tips = cut(
        tips.join(inner, "inner_vid").select(
            F.col("vid").alias("id"), "i", "j", "k", *[(F.col(o) * s).cast("double").alias(x) for o, x, s in zip("ijk", "xyz", spacing, strict=True)], *[(d / norm).alias(f"u{x}") for d, x in zip(out, "xyz", strict=True)]
        )
    )
    pairs = spatial.facing_pairs(tips, c.gap_mm, ["ux", "uy", "uz"], c.facing).select("a", "b", "dist")
    pairs = graph.numbered(pairs, ["a", "b"], "gap").withColumn("gap", F.col("gap") + 1)
    at = lambda n: tips.select(F.col("id").alias(n), *[F.col(o).alias(f"{n}{o}") for o in "ijk"], *[F.col(f"u{x}").alias(f"{n}_{x}") for x in "xyz"])
    found = cut(pairs.join(at("a"), "a").join(at("b"), "b"))
    box = found
    for o in "ijk":
        lo, hi = F.least(f"a{o}", f"b{o}") - 3, F.greatest(f"a{o}", f"b{o}") + 3
        box = box.withColumn(o, F.explode(F.sequence(lo, hi)))
    cells = cut(box.drop("a", "b").join(voxels.drop("vid"), ["i", "j", "k"]))  # a and b are the tips there, factors here
    traced = cut(gaps.trace_both(cells.select("gap", "i", "j", "k", "fx", "fy", "fz", "v"), found, ["gap"], shape, resume, c.step, c.blend, c.gap_mm, c.converge, spacing=spacing))
    met = traced.where("met").groupBy("gap").agg(F.max(F.when(F.col("side") == "a", F.col("pos"))).alias("na"), F.max(F.when(F.col("side") == "b", F.col("pos"))).alias("nb"))
    both = traced.join(met, "gap").select(
        "gap", F.when(F.col("side") == "a", F.col("pos")).otherwise(F.col("na") + 1 + F.col("nb") - F.col("pos")).alias("pos"), "x", "y", "z", F.lit("flow").alias("method")
    )
    role = lambda n: (F.col("i") == F.col(f"{n}i")) & (F.col("j") == F.col(f"{n}j")) & (F.col("k") == F.col(f"{n}k"))
    rest = cells.join(met, "gap", "left_anti").select("gap", "i", "j", "k", stencil.cost([(F.col("v"), c.weights[0]), (F.col("a") * F.col("b"), c.weights[1]), (F.col("hu"), c.weights[2])]).alias("cost"), F.when(role("a"), "a").when(role("b"), "b").otherwise("").alias("role"))
    marched = gaps.fast_march(rest, ["gap"]).select("gap", "pos", *[F.col(o).cast("double").alias(x) for o, x in zip("ijk", "xyz", strict=True)], F.lit("fast_march").alias("method"))
    path = cut(both.unionByName(marched))
    step = paths.steps(path, ["gap"], "pos", ["x", "y", "z"])
    mm = [F.col(f"d_{x}") * s for x, s in zip("xyz", spacing, strict=True)]
    size = F.sqrt(sum((d * d for d in mm), F.lit(0.0))) + 1e-9
    u = step.select("gap", "pos", "method", "x", "y", "z", *[(d / size).alias(f"u{x}") for d, x in zip(mm, "xyz", strict=True)])
    wp = Window.partitionBy("gap").orderBy("pos")
    cosine = sum((F.col(f"u{x}") * F.lag(f"u{x}").over(wp) for x in "xyz"), F.lit(0.0))
    samples = u.withColumn("cosine", cosine).select("gap", "pos", "method", "cosine", *[F.floor(F.col(x) + 0.5).cast("int").alias(o) for x, o in zip("xyz", "ijk", strict=True)])
    samples = samples.join(voxels.select("i", "j", "k", "a", "b", "hu"), ["i", "j", "k"])
    score = paths.bridge_score(samples, ["gap"], "pos").join(path.groupBy("gap").agg(F.max("method").alias("method")), "gap")
    report = cut(found.join(score, "gap").select("gap", "a", "b", "dist", *[f"{n}{o}" for n in "ab" for o in "ijk"], "method", "score", gaps.actions(F.col("score"), c.auto, c.review, "rejected").alias("action")))
    return report, gaps.merge_components(comp, report.where("action = 'accepted'").select("a", "b"))


def match_landmarks(before: DataFrame, after: DataFrame, patches_before: DataFrame, patches_after: DataFrame, c: Landmarks = Landmarks()) -> DataFrame:
    """Match table of points in one frame: clustered bifurcations (id, x, y, z) of two images, and patches (id, patch)."""
    snapped = landmarks.snap(before, after, c.radius_mm)
    near = spatial.nearest_within(before, after, c.radius_mm)
    pair = near.join(patches_before.select("id", F.col("patch").alias("p0")), "id", "left").join(
        patches_after.select(F.col("id").alias("right_id"), F.col("patch").alias("p1")), "right_id", "left"
    )
    sim = landmarks.similarity(pair, "p0", "p1").select("id", F.coalesce("patch_similarity", F.lit(0.0)).alias("patch_similarity"))
    return landmarks.match_table(snapped.join(sim, "id"), c.top_n, c.least_similarity, c.high_similarity)
