"""Round trips and edge cases of the sources and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.operators import skeleton, stencil, voxel
from lumenflow.sources import fiducials, manifests, nifti, polydata, volumes
from lumenflow.streaming import incremental


@pytest.mark.parametrize("dtype", ["uint8", "int16", "float32", "float64"])
def test_nifti_bytes(dtype):
    x = np.arange(60).reshape(3, 4, 5).astype(dtype)
    a = np.array([[2, 0, 0, -5], [0, 1.5, 0, 3], [0, 0, 3, 1], [0, 0, 0, 1]], float)
    for z in (False, True):
        y, b, s = nifti.parse(nifti.build(x, a, z))
        assert (x == y).all() and np.allclose(a, b) and s == (2.0, 1.5, 3.0)


def test_nifti_tables(spark, tmp_path):
    x = np.zeros((3, 4, 5), np.float32)
    x[1, 2, 3], x[0, 0, 4] = 7, -2
    (tmp_path / "a.nii.gz").write_bytes(nifti.build(x, np.eye(4), True))
    v = nifti.voxels(spark, str(tmp_path))
    assert sorted((r["i"], r["j"], r["k"], r["vid"], r["value"]) for r in v.collect()) == [(0, 0, 4, 48, -2.0), (1, 2, 3, 43, 7.0)]
    assert nifti.voxels(spark, str(tmp_path), dense=True).count() == 60
    g = nifti.headers(spark, str(tmp_path))
    back = nifti.pack(v, g).first()
    assert (nifti.parse(bytes(back["content"]))[0] == x).all()
    spark.dataSource.register(volumes.NiftiSource)
    assert spark.read.format("nifti").option("paths", str(tmp_path / "a.nii.gz")).load().count() == 2
    with pytest.raises(ValueError):
        nifti.parse(b"\0" * 400)


def test_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text("001, a/x.nii ,b.nii\n\n002,/abs/y.nii,c.nii, roi.nii \n,z,z,z\n")
    rows = manifests.read(spark, str(tmp_path / "m.csv"), "preprocessed").orderBy("id").collect()
    assert [(r["id"], r["mask"], r["roi"]) for r in rows] == [("001", "a/x.nii", None), ("002", "/abs/y.nii", "roi.nii")]
    df = spark.createDataFrame([(r["id"], r["mask"]) for r in rows], "id string, mask string")
    got = [r[0] for r in df.select(manifests.resolve("/data/", F.col("mask"))).collect()]
    assert got == ["/data/a/x.nii", "/abs/y.nii"]
    (tmp_path / "h.csv").write_text("id, label ,x\n1, a.nii,2\n2,,3\n")
    assert [r[0] for r in manifests.named(spark, str(tmp_path / "h.csv"), "label").collect()] == ["a.nii"]
    with pytest.raises(ValueError):
        manifests.named(spark, str(tmp_path / "h.csv"), "nope")
    files = manifests.listing(spark, str(tmp_path), "*.csv")
    assert [r["name"] for r in files.collect()] == ["h.csv", "m.csv"]
    assert manifests.existing(spark.createDataFrame([("q/h.csv",), ("q/none",)], "f string"), files, "f").count() == 1
    d = manifests.with_defaults(df, spark.createDataFrame([("001", 3.0)], "id string, alpha double"), {"alpha": 0.5, "c": 1.0}).orderBy("id").collect()
    assert [(r["alpha"], r["c"], r["defaulted"]) for r in d] == [(3.0, 1.0, False), (0.5, 1.0, True)]


def test_fiducials(spark, tmp_path):
    p = spark.createDataFrame([(1.5, -2.0, 3.0, "LM_000"), (4.0, 5.0, 6.0, "LM_001")], "x double, y double, z double, label string")
    for system in ("LPS", "RAS"):
        fiducials.write(p, str(tmp_path / system), system)
        got = fiducials.read(spark, f"{tmp_path}/{system}/part-*").orderBy("pos")
        assert [(r["x"], r["y"], r["z"], r["label"]) for r in got.collect()] == [(1.5, -2.0, 3.0, "LM_000"), (4.0, 5.0, 6.0, "LM_001")]
        assert fiducials.seed(spark, f"{tmp_path}/{system}/part-*") == (1.5, -2.0, 3.0)


def test_polydata(spark, tmp_path):
    text = """<VTKFile><PolyData><Piece><Points><DataArray type="Float64" NumberOfComponents="3">0 0 0 1 0 0
 2 0 0 2 1 0</DataArray></Points><PointData><DataArray Name="radius_mm">1 2 3 4</DataArray></PointData>
<Lines><DataArray Name="connectivity">0 1 2 1 3</DataArray><DataArray Name="offsets">3 5</DataArray></Lines></Piece></PolyData></VTKFile>"""
    (tmp_path / "a.vtp").write_text(text)
    (tmp_path / "b.vtp").write_text(text.replace('Name="radius_mm"', 'Name="other"'))
    nodes, edges = polydata.read(spark, str(tmp_path))
    a = edges.where("file like '%a.vtp'").orderBy("edge_id").collect()
    assert [(r["src"], r["dst"], r["radius"]) for r in a] == [(0, 1, 1.5), (1, 2, 2.5), (1, 3, 3.0)]
    assert edges.where("file like '%b.vtp' and radius = 1.5").count() == 3 and nodes.count() == 8
    one = nodes.where("file like '%a.vtp'").withColumn("radius_mm", F.col("radius"))
    xml = polydata.render(one, edges.where("file like '%a.vtp'").withColumn("flow", F.lit(None).cast("double")), ["radius_mm"], ["flow"])
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "c.vtp").write_text(xml.first()["value"])
    n2, e2 = polydata.read(spark, str(tmp_path / "out"))
    pick = lambda df, c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert pick(n2, ["node_id", "x", "y", "z", "radius"]) == pick(one, ["node_id", "x", "y", "z", "radius"])
    assert pick(e2, ["src", "dst"]) == pick(edges.where("file like '%a.vtp'"), ["src", "dst"])


def test_trees(spark):
    p = spark.range(40).select(F.lit("t").alias("tree_id"), F.col("id").alias("point_id"), *[(F.col("id") * m % 17).cast("double").alias(c) for c, m in zip("xyz", (3, 5, 7))])
    t = skeleton.grow(p).orderBy("node_id").collect()
    assert t[0]["parent_id"] is None and all(r["parent_id"] < r["node_id"] for r in t[1:])
    leaves = {r["node_id"] for r in t} - {r["parent_id"] for r in t}
    assert t[0]["flow"] == len(leaves) and t[0]["radius"] == 5.5 and all(r["radius"] <= 5.5 for r in t)


def test_incremental(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.csv").write_text("id,label\na,x\nb,y\n")
    go = lambda: incremental.run_new(
        incremental.manifest_stream(spark, str(src), "id string, label string"), lambda df: df.withColumn("status", F.lit("ok")), str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination()
    go()
    (src / "2.csv").write_text("id,label\nb,y\nc,z\n")
    go()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_image_data_and_tables(spark):
    from lumenflow.sources import images

    v = spark.createDataFrame([("a", i, j, k, i + 10 * j + 100 * k) for i in range(2) for j in range(2) for k in range(2)], "sample_id string, i int, j int, k int, value int")
    x = images.render(v, (2, 2, 2), (-0.5, 1.0, 2.0), (3.0, 0.0, 1.0)).first()["value"]
    assert 'Origin="2.5 0.0 1.0" Spacing="0.5 1.0 2.0"' in x and 'type="Int32"' in x and ">1 0 11 10 101 100 111 110<" in x
    t = spark.createDataFrame([("b", 1.0, 2.0), ("a", 3.0, None)], "id string, x double, y double")
    lines = [r["value"] for r in images.console(t, "id", ["x", "y"], 8, 2).collect()]
    assert lines == ["id             x       y", "a           3.00       -", "b           1.00    2.00", "MEAN        2.00    2.00"]


def test_fiducial_variants(spark):
    from lumenflow.sources import fiducials

    p = spark.createDataFrame([(1.0, -2.0, 3.0, "BIF_000")], "x double, y double, z double, label string")
    get = lambda **o: [r["value"] for r in fiducials.lines(p, **o).orderBy("place").collect()]
    assert get()[1:] == ["# CoordinateSystem = LPS", fiducials.COLUMNS, "pt_BIF_000,-1.0000,2.0000,3.0000,0,0,0,1,1,1,0,BIF_000,,"]
    assert get(system=None, digits=3, prefix=fiducials.NODE, numbered=True)[1:] == [fiducials.COLUMNS, f"{fiducials.NODE}0,1.000,-2.000,3.000,0,0,0,1,1,1,0,BIF_000,,"]


def test_command_line(spark, sf, tmp_path, capsys):
    from lumenflow.__main__ import main

    assert main(["list"]) == 0 and "hard_dice_by_group" in capsys.readouterr().out
    assert main(["query", "select_members", "--data", sf, "--out", f"{tmp_path}/o", "--format", "csv"]) == 0
    assert spark.read.csv(f"{tmp_path}/o", header=True).columns == ["p_partkey", "p_size"]


@pytest.mark.parametrize("shape, slices", [((3, 4, 5), 2), ((30, 17, 41), 7)])
def test_slabs(spark, tmp_path, shape, slices):
    """Slabs of plain and packed files give what the files hold, in both orders, with bounds, and headers without voxels."""
    rng = np.random.default_rng(5)
    want = {}
    for name, packed in (("a.nii", False), ("b.nii.gz", True)):
        x = np.where(rng.random(shape) < 0.3, rng.integers(1, 99, shape), 0).astype(np.int16)
        (tmp_path / name).write_bytes(nifti.build(x, np.diag([1.0, 2.0, 3.0, 1.0]), packed))
        want |= {(name, i, j, k): float(x[i, j, k]) for i, j, k in np.argwhere(x)}
    spark.dataSource.register(volumes.NiftiSource)
    load = lambda **o: spark.read.format("nifti").options(paths=str(tmp_path), slices=str(slices), **o).load()
    named = lambda df, c: {(r["file"].rsplit("/")[-1], *(r[x] for x in c)): r["value"] for r in df.collect()}
    v = load()
    assert named(v, "ijk") == want and v.rdd.getNumPartitions() == -(-shape[2] // slices) + 1
    assert {(n, k, j, i): x for (n, i, j, k), x in want.items()} == named(load(order="zyx"), "zyx")
    assert load(dense="true").count() == 2 * int(np.prod(shape))
    assert v.where(F.col("vid") != F.col("i") + shape[0] * (F.col("j") + shape[1] * F.col("k"))).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bounded = load(pushdown="true")
    few = bounded.where("k >= 2 and k < 4 and j = 1 and i > 0 and value > 3")
    assert named(few, "ijk") == {c: x for c, x in want.items() if 2 <= c[3] < 4 and c[2] == 1 and c[1] > 0 and x > 3}
    assert few.rdd.getNumPartitions() <= 3 and bounded.where("k > 1000").count() == 0
    assert bounded.where("k > 1").where("k <= 3 and i <> 1").count() == v.where("k > 1 and k <= 3 and i <> 1").count()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    heads = load(what="header").orderBy("file").collect()
    assert [(h["nx"], h["ny"], h["nz"], h["spacing"]) for h in heads] == [(*shape, [1.0, 2.0, 3.0])] * 2
    # a header is all that planning needs: the voxels may be missing
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "c.nii").write_bytes((tmp_path / "a.nii").read_bytes()[: nifti.HEAD])
    assert spark.read.format("nifti").options(paths=f"{tmp_path}/cut/c.nii", what="header").load().first()["nz"] == shape[2]
