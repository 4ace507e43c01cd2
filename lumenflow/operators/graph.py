"""Graphs as node and edge tables: components, spanning forests, degrees, reduced graphs, bridges, tree sums.

Iterative operators are loops of joins whose steps are cut by reliable checkpoints; a loop ends when nothing changes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut
from lumenflow.functions import physics

#: Links that a task of an iterative operator takes.
LINKS = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over the links, for every id that has one.

    Alternates large-star and small-star steps (a node's larger, then smaller neighbours move to its smallest one) until
    the links no longer change; links only ever shrink towards stars, so a step's volume stays that of the links. Both
    steps group by a node with partial aggregation of the minimum, and join it back: a node with very many links is
    dealt over tasks by the adaptive skew join, which needs both sides stored. Nulls and self links give nothing.
    """
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    # frames in the loop hold at most twice as many rows as there are links: few links take few tasks and files
    parts = max(1, -(-edges.count() // LINKS))
    few = lambda df: cut(df.coalesce(parts))
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
        large = few(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small_low = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
        edges = few(small.where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == mark:
            break
        mark = (now["n"], now["h"])
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return few(stars.union(stars.select(F.col("component").alias("id"), "component").distinct()))


def components_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Components of all nodes; one without a link is its own."""
    return nodes.select("id").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))


def island_filter(nodes: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """Nodes of components with at least ``least`` members: (id, component, size)."""
    comp = components_of(nodes, links)
    sizes = comp.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return comp.join(sizes, "component").select("id", "component", "size")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    n = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(n, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def leaves(nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """Nodes of degree at most one (exactly one if ``strict``)."""
    d = degrees(nodes, edges)
    return d.where(F.col("degree") == 1 if strict else F.col("degree") <= 1)


def dedupe(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """Undirected edges once, the first of equal ones; self loops go."""
    e = edges.where("src <> dst").withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    first = F.min_by(F.struct(*[F.col(c) for c in edges.columns]), order)
    return e.groupBy("lo", "hi").agg(first.alias("e")).select("e.*")


def endpoints(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with the attributes of both ends, as <column>_src and <column>_dst: two equi joins."""
    at = lambda n: nodes.select(F.col("id").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in columns])
    return edges.join(at("src"), "src").join(at("dst"), "dst")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes' components, if there is one at most; else an error that counts them."""
    comp = cut(components_of(nodes, edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    n = comp.select("component").distinct().count()
    if n > 1:
        raise ValueError(f"the graph has {n} components")
    return comp


def prune(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def first_incident(nodes: DataFrame, edges: DataFrame, value: str, default: float = 1.5, order: str = "edge_id") -> DataFrame:
    """Each node's value at its first edge, ``default`` where it has none."""
    ends = edges.select(F.col("src").alias("id"), order, value).union(edges.select(F.col("dst").alias("id"), order, value))
    best = ends.groupBy("id").agg(F.min_by(value, order).alias(value))
    return nodes.select("id").join(best, "id", "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def closest_pairs(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """For each two components, the closest of the pairs (a, b, dist) between them, ties to smaller ids: (ca, cb, a, b,
    dist) with ca < cb."""
    c = comp.select("id", "component")
    j = pairs.join(c.select(F.col("id").alias("a"), F.col("component").alias("_x")), "a").join(
        c.select(F.col("id").alias("b"), F.col("component").alias("_y")), "b"
    )
    return closest(j.select("a", "b", "dist", F.col("_x").alias("ca"), F.col("_y").alias("cb")))


def closest(pairs: DataFrame) -> DataFrame:
    """The same from pairs (a, b, dist, ca, cb) that come with their components."""
    best = pairs.where("ca <> cb").groupBy(F.least("ca", "cb").alias("_x"), F.greatest("ca", "cb").alias("_y")).agg(F.min(F.struct("dist", "a", "b")).alias("m"))
    return best.select(F.col("_x").alias("ca"), F.col("_y").alias("cb"), "m.a", "m.b", "m.dist")


def spanning_forest(edges: DataFrame, a: str = "ca", b: str = "cb", order: list[str] | None = None) -> DataFrame:
    """Minimum spanning forest by Boruvka rounds: each component takes its smallest outgoing edge in a total order, the
    chosen edges merge components. Edges are (a, b, order columns..); ends and order columns must tell edges apart."""
    order = order or ["dist", "a", "b"]
    cols = edges.columns
    left = cut(edges.select(F.col(a).alias("_p"), F.col(b).alias("_q"), F.struct(*[F.col(c) for c in [*order, *[c for c in cols if c not in order]]]).alias("e")).where("_p <> _q"))
    chosen = None
    while not left.isEmpty():
        ends = left.select(F.col("_p").alias("c"), "e").union(left.select(F.col("_q").alias("c"), "e"))
        picked = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("e").distinct())
        chosen = picked if chosen is None else cut(chosen.union(picked).distinct())
        comp = components(chosen.select(F.col(f"e.{a}").alias("a"), F.col(f"e.{b}").alias("b")))
        home = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"{c}_c"))
        left = left.select(F.col(f"e.{a}").alias("_p"), F.col(f"e.{b}").alias("_q"), "e")
        left = cut(
            left.join(home("_p"), "_p", "left").join(home("_q"), "_q", "left")
            .select(F.coalesce("_p_c", "_p").alias("_p"), F.coalesce("_q_c", "_q").alias("_q"), "e").where("_p <> _q")
        )
    return (chosen if chosen is not None else left.select("e")).select("e.*").select(*cols)


def phantom_edges(pairs: DataFrame, comp: DataFrame, leaf: DataFrame, mode: str = "mst") -> DataFrame:
    """Bridges between leaves of different components, from leaf pairs within the gap: all of them, or the component-level
    spanning forest of the closest ones."""
    ids = leaf.select("id")
    near = pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    if mode == "mst":
        return spanning_forest(closest_pairs(near, comp)).select("a", "b", "dist")
    c = comp.select("id", "component")
    return (
        near.join(c.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(c.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
        .where("x <> y").select("a", "b", "dist")
    )


def representatives_mst(nodes: DataFrame, comp: DataFrame, radius: float | None = None) -> DataFrame:
    """Edges that always connect all components: the spanning tree over the components' first nodes, by distance.

    The forest of the pairs within a radius comes first; then the radius doubles, or grows eightfold after a round that found no
    pair, and pairs are formed only from nodes outside the largest tree so far, since an edge of the spanning tree that is left
    leads out of a smaller one. The first radius is the spacing of as many evenly spread nodes in the box of the middle nine
    tenths of each coordinate, so that single far nodes don't widen it. Coordinates must be numbers.
    """
    rep = cut(comp.groupBy("component").agg(F.min("id").alias("id")).join(nodes, "id").select("id", "component", *[F.col(c).cast("double").alias(c) for c in "xyz"]))
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    inner = [F.percentile_approx(c, F.array(F.lit(0.05), F.lit(0.95)), 1000).alias(c) for c in "xyz"]
    ends = rep.agg(F.count("*").alias("n"), F.count_if(~(usable("x") & usable("y") & usable("z"))).alias("bad"), *inner).first()
    out = rep.select(*[F.col("component").alias(c) for c in ("ca", "cb")], *[F.col("id").alias(c) for c in ("a", "b")], F.lit(0.0).alias("dist")).limit(0)
    if ends["bad"]:
        raise ValueError(f"{ends['bad']} nodes without coordinates")
    if ends["n"] < 2:
        return out
    sides = [ends[c][1] - ends[c][0] for c in "xyz"]
    r = radius or max(sides) / ends["n"] ** (1 / max(1, sum(x > 0 for x in sides))) or 1.0
    home = cut(rep.select("id", F.col("id").alias("tree")))
    while True:
        largest = home.groupBy("tree").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tree").limit(1).select("tree")
        some = rep.join(home, "id").join(largest, "tree", "left_anti")
        q = cut(rep.join(home, "id"))
        pairs = _near(cut(some), q, r)
        pairs = pairs.where("ta <> tb").select("ca", "cb", "a", "b", "dist").distinct()
        # the trees are the nodes of this round's forest
        tree = lambda c: home.select(F.col("id").alias(c), F.col("tree").alias(f"t{c}"))
        found = cut(spanning_forest(pairs.join(tree("a"), "a").join(tree("b"), "b"), "ta", "tb", ["dist", "a", "b"]).select("ca", "cb", "a", "b", "dist"))
        out = cut(out.unionByName(found))
        linked = components(out.select("a", "b"))
        home = cut(rep.select("id").join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("tree")))
        if home.select("tree").distinct().count() == 1:
            return out
        r *= 8 if found.isEmpty() else 2


def _near(some: DataFrame, rep: DataFrame, r: float) -> DataFrame:
    """Pairs of representatives within r, one of them in ``some``: an equi join on cells of that size."""
    cell = lambda c: F.floor(F.col(c) / r).cast("long")
    around = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("xyz", o, strict=True)]) for o in ((i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))])
    ask = some.withColumn("o", F.explode(around)).select(
        F.col("id").alias("p"), F.col("component").alias("cp"), F.col("tree").alias("tp"), *[F.col(c).alias(f"p{c}") for c in "xyz"], *[(cell(c) + F.col(f"o.{c}")).alias(f"c{c}") for c in "xyz"]
    )
    held = rep.select("id", "component", "tree", *"xyz", *[cell(c).alias(f"c{c}") for c in "xyz"])
    d = F.sqrt(sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "xyz"), F.lit(0.0)))
    hit = ask.join(held, ["cx", "cy", "cz"]).where(F.col("tp") != F.col("tree")).withColumn("dist", d).where(F.col("dist") <= r)
    first = F.col("cp") < F.col("component")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return hit.select(
        pick("cp", "component", "ca"), pick("component", "cp", "cb"), pick("p", "id", "a"), pick("id", "p", "b"), pick("tp", "tree", "ta"), pick("tree", "tp", "tb"), "dist"
    )


def reduced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Contract chains of degree-2 nodes: (src, dst, hops) between critical nodes (degree other than 2), each chain once.

    A chain is a component of degree-2 nodes; its ends are the critical nodes next to it. Chains without critical ends
    (rings) give nothing; parallel chains stay apart by ``chain``, the smallest inner node (null for a direct edge).
    """
    d = cut(degrees(nodes, edges))
    crit = d.where("degree <> 2").select("id")
    e = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    flag = lambda c: crit.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_crit"))
    f = cut(e.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left").fillna(False, ["src_crit", "dst_crit"]))
    direct = f.where("src_crit and dst_crit and src < dst").select("src", "dst", F.lit(1).cast("long").alias("hops"), F.lit(None).cast("long").alias("chain"))
    inner = f.where("not src_crit and not dst_crit and src < dst")
    chain = components_of(d.where("degree = 2").select("id"), inner.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    chain = cut(chain)
    size = chain.groupBy("component").agg(F.count("*").alias("n"))
    ends = f.where("src_crit and not dst_crit").select(F.col("src").alias("end"), F.col("dst").alias("id")).join(chain, "id")
    # a chain has two ends; both at one node if it is a loop
    pairs = ends.groupBy("component").agg(F.min("end").alias("src"), F.max("end").alias("dst")).join(size, "component")
    long = pairs.select("src", "dst", (F.col("n") + 1).alias("hops"), F.col("component").alias("chain"))
    return direct.unionByName(long)


def reduced_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The reduced graph with its geometry: (src, dst, chain, hops, path, length, mean_radius) for nodes (id, x, y, z, radius).

    ``path`` lists a chain's nodes from src, the smaller end, to dst; a chain that begins and ends at one node goes by its
    smaller inner neighbour first. A chain is ordered in a task of its own, from a few numbers for each node.
    """
    short = cut(reduced(nodes, edges))
    e = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    inner = degrees(nodes, edges).where("degree = 2").select("id")
    within = e.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi")
    chain = cut(components_of(inner, within.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    links = chain.select(F.col("id").alias("src"), F.col("component").alias("chain")).join(e, "src")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["chain", "path"]
        near: dict[int, list[int]] = {}
        for s, d in zip(pdf["src"], pdf["dst"], strict=True):
            near.setdefault(int(s), []).append(int(d))
        ends = sorted((d, s) for s, ds in near.items() for d in ds if d not in near)
        if not ends:  # a ring
            return pd.DataFrame(columns=names)
        path = [ends[0][0], ends[0][1]]
        while path[-1] in near:
            path.append(next((d for d in sorted(near[path[-1]]) if d != path[-2]), path[-2]))
        return pd.DataFrame([(pdf["chain"].iloc[0], path)], columns=names)

    ordered = links.groupBy("chain").applyInPandas(order, "chain long, path array<long>")
    direct = short.where("chain is null").select("src", "dst", "chain", "hops", F.array("src", "dst").alias("path"))
    long = short.where("chain is not null").join(ordered, "chain").select("src", "dst", "chain", "hops", "path")
    both = cut(direct.unionByName(long))
    at = nodes.select(F.col("id").alias("node"), "x", "y", "z", "radius")
    steps = both.select("src", "dst", "chain", F.posexplode("path").alias("pos", "node")).join(at, "node")
    w = Window.partitionBy("src", "dst", "chain").orderBy("pos")
    d = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in "xyz"), F.lit(0.0)))
    sums = steps.withColumn("_d", d).groupBy("src", "dst", "chain").agg(F.sum("_d").alias("length"), F.avg("radius").alias("mean_radius"))
    same = (both["src"] == F.col("s")) & (both["dst"] == F.col("d")) & both["chain"].eqNullSafe(F.col("c"))
    sums = sums.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("chain").alias("c"), "length", "mean_radius")
    return both.join(sums, same).select("src", "dst", "chain", "hops", "path", "length", "mean_radius")


def accumulate(tree: DataFrame, own: DataFrame) -> DataFrame:
    """Sum of each node's own amount and those below it: tree (id, parent), own (id, own) -> (id, total).

    Each amount climbs to its ancestors level by level; amounts that have met at a node go on as one row.
    """
    t = cut(tree.select("id", "parent"))
    level = cut(t.join(own, "id", "left").select("id", F.coalesce("own", F.lit(0)).cast("long").alias("amount")))
    total = level
    while True:
        up = level.join(t, "id").where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum("amount").alias("amount"))
        level = cut(up.where("amount <> 0"))
        if level.isEmpty():
            break
        total = cut(total.unionByName(level).groupBy("id").agg(F.sum("amount").alias("amount")))
    return total.select("id", F.col("amount").alias("total"))


def add_bridges(nodes: DataFrame, edges: DataFrame, bridges: DataFrame, radius: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Add bridges (bridge_id, a, b, points: interior points in order) as new nodes and edges that aren't fixed, with the
    bridges' own ``radius`` where they have one, see ``bridge_radii``.

    New ids follow the largest old ones by a prefix sum over the bridges, not by a scan of the points in one task.
    """
    largest = lambda df, c: -1 if (got := df.agg(F.max(c)).first()[0]) is None else int(got)
    top_n, top_e = largest(nodes, "id") + 1, largest(edges, "edge_id") + 1
    b = bridges.withColumn("_n", F.size("points"))
    w = Window.orderBy("bridge_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per accepted bridge
    b = b.withColumn("_n0", F.coalesce(F.sum("_n").over(w), F.lit(0)) + top_n).withColumn("_e0", F.coalesce(F.sum(F.col("_n") + 1).over(w), F.lit(0)) + top_e)
    inner = b.select("_n0", F.posexplode("points").alias("_p", "q"))
    new_nodes = inner.select((F.col("_n0") + F.col("_p")).cast("long").alias("id"), "q.x", "q.y", "q.z")
    chain = F.concat(F.array(F.col("a").cast("long")), F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: (F.col("_n0") + i - 1).cast("long")), F.array(F.col("b").cast("long")))
    chain = F.when(F.col("_n") == 0, F.array(F.col("a").cast("long"), F.col("b").cast("long"))).otherwise(chain)
    wide = F.coalesce(F.col("radius"), F.lit(float(radius))) if "radius" in bridges.columns else F.lit(float(radius))
    links = b.select("_e0", wide.alias("_r"), F.posexplode(F.arrays_zip(F.slice(chain, 1, F.size(chain) - 1).alias("s"), F.slice(chain, 2, F.size(chain) - 1).alias("d"))).alias("_p", "q"))
    new_edges = links.select((F.col("_e0") + F.col("_p")).cast("long").alias("edge_id"), F.col("q.s").alias("src"), F.col("q.d").alias("dst"), F.col("_r").alias("radius"), F.lit(False).alias("is_fixed"))
    return nodes.select("id", "x", "y", "z").unionByName(new_nodes), edges.unionByName(new_edges, allowMissingColumns=True)


def bridge_radii(nodes: DataFrame, edges: DataFrame, bridges: DataFrame, default: float = 1.5, least: float = 0.5) -> DataFrame:
    """The bridges (a, b, ..) with a ``radius`` by the cube law from the first edge at each of their ends (src, dst, edge_id,
    radius), ``default`` for an end without one."""
    first = first_incident(nodes, edges, "radius", default)
    at = lambda n: first.select(F.col("id").alias(n), F.col("radius").alias(f"_r{n}"))
    both = bridges.join(at("a"), "a", "left").join(at("b"), "b", "left")
    ends = [F.coalesce(F.col(f"_r{n}"), F.lit(float(default))) for n in "ab"]
    return both.withColumn("radius", physics.bridge_radius(*ends, least)).drop("_ra", "_rb")


def numbered(rows: DataFrame, order: list[str], name: str, parts: int = 64) -> DataFrame:
    """The rows with their place from 0 in an order without ties: ranges are numbered by themselves, after the sizes of those before."""
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per range
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("_r", place).join(F.broadcast(before), "_p").withColumn(name, (F.col("_r") + F.col("_b")).cast("long")).drop("_p", "_r", "_b")
