"""The jobs against DuckDB, twice over growing input, on odd rows, and by their command lines."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import _common, band_tuning, queries, scan_evaluation
from tests import oracle
from tests.conftest import ROOT


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    oracle.same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], oracle.connect(sf))


def _rows(df):
    return sorted(map(str, df.collect()))


def test_scans_are_taken_once(spark, sf, tmp_path):
    """Two files, then a third: the report is that of all rows, the second run reads only the new file."""
    voxels, out, at = f"{tmp_path}/voxels", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    parts = [lines.where(F.pmod("l_orderkey", F.lit(3)) == i) for i in range(3)]
    config = _common.config_of("scan_evaluation") | {"files_per_batch": 1}
    for p in parts[:2]:
        p.coalesce(1).write.mode("append").parquet(voxels)
    first = scan_evaluation.run(spark, voxels, out, at, config)
    early = _rows(first)
    assert early == _rows(scan_evaluation.evaluate(scan_evaluation.counts_of(spark.read.parquet(voxels), config)).select(*first.columns))
    assert spark.read.parquet(f"{out}/counts").select("batch").distinct().count() == 2
    assert scan_evaluation.take_new(spark, voxels, out, at, config) == 0
    assert _rows(scan_evaluation.run(spark, voxels, out, at, config)) == early
    third = parts[2].withColumn("l_returnflag", F.when(F.col("l_returnflag") == "R", F.lit("new")).otherwise(F.col("l_returnflag")))
    third.coalesce(1).write.mode("append").parquet(voxels)
    assert scan_evaluation.take_new(spark, voxels, out, at, config) == third.count()
    got = scan_evaluation.run(spark, voxels, out, at, config)
    assert _rows(got) == _rows(scan_evaluation.evaluate(scan_evaluation.counts_of(spark.read.parquet(voxels), config)).select(*got.columns))
    assert got.where("sample like 'new%'").count() > 0


def test_a_batch_tried_again_counts_once(spark, tmp_path):
    """The output of a batch without its commit: the run after it writes the same partition."""
    voxels, out, at = f"{tmp_path}/voxels", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    config = {"sample": "s", "level": "v", "truth": "t", "files_per_batch": 10}
    rows = [("a", 1, True), ("a", 2, False), ("a", None, True), (None, 1, True), ("b", 3, None), ("b", 3, False), ("c", 5, True), ("7", -1, True), ("7", 4, False)]
    spark.createDataFrame(rows, "s string, v int, t boolean").coalesce(1).write.parquet(voxels)
    spark.createDataFrame([("a", 9, 99, 99)], "sample string, level long, n long, g long").write.parquet(f"{out}/counts/batch=0")
    got = {r["sample"]: r for r in scan_evaluation.run(spark, voxels, out, at, config).collect()}
    assert {s: (r.n, r.truth, r.status) for s, r in got.items()} == {"a": (2, 1, "ok"), "b": (2, 0, "no truth"), "c": (1, 1, "truth only"), "7": (2, 1, "ok")}
    assert got["b"].auc is None and got["b"].threshold is None and got["c"].auc is None and got["c"].threshold == 5
    assert got["a"].auc == 0 and got["7"].threshold == -1 and got["7"].dice == 666666666


def test_no_voxels(spark, tmp_path):
    voxels, config = f"{tmp_path}/voxels", {"sample": "s", "level": "v", "truth": "t", "files_per_batch": 10}
    spark.createDataFrame([], "s string, v int, t boolean").write.parquet(voxels)
    assert scan_evaluation.run(spark, voxels, f"{tmp_path}/out", f"{tmp_path}/at", config).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_bands_of_odd_rows(spark, tmp_path):
    config = _common.config_of("band_tuning") | {"measures": {"words": "regexp_count(text, '[^ ]+')"}, "bins": 4, "coarse": 2}
    docs = [(i, "w " * (i % 10), "12" if i % 2 else None, "s" if i % 3 else None, 0) for i in range(40)] + [(None, None, "", None, None), (40, "w " * 5000, "en", "s", 0)]
    marks = [(i, int(3 <= i % 10 <= 5), 0) for i in range(0, 40)] + [(41, 1, 0), (None, 1, 0), (40, None, 0)]
    d, m = f"{tmp_path}/d", f"{tmp_path}/l"
    spark.createDataFrame(docs, DOCS).write.parquet(d)
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(m)
    first = _rows(band_tuning.run(spark, d, m, f"{tmp_path}/out", config))
    again = band_tuning.run(spark, d, m, f"{tmp_path}/out", config)
    assert _rows(again) == first
    rows = again.collect()
    whole = [r for r in rows if r.part == "document"]
    assert len(whole) == 42 and {r.lang for r in whole} >= {"12", "none", "en"}
    assert all(r.chosen == (3 <= r.value <= 5) for r in whole)
    samples = {r["sample"]: r for r in rows if r.part == "sample"}
    assert set(samples) == {"s", "none"} and all(r.dice_after == 10**9 and (r.lo, r.hi) == (3, 5) for r in samples.values())


def test_nothing_to_tune_on(spark, tmp_path):
    config = _common.config_of("band_tuning")
    d, m = f"{tmp_path}/d", f"{tmp_path}/l"
    spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS).write.parquet(d)
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(m)
    rows = band_tuning.run(spark, d, m, f"{tmp_path}/out", config).collect()
    assert {(r.part, r.chosen, r.lo, r.dice_after) for r in rows} == {("sample", None, None, 0), ("document", False, None, None)}
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(d)
    assert band_tuning.run(spark, d, m, f"{tmp_path}/out", config).count() == 0


@pytest.mark.parametrize("job, args", [("band_tuning", ["--documents", "{sf}/documents.parquet", "--labels", "{sf}/labels.parquet", "--out", "{tmp}/out"]),
                                       ("scan_evaluation", ["--voxels", "{sf}/lineitem.parquet", "--out", "{tmp}/out", "--checkpoint", "{tmp}/at"])])
def test_command_line(tmp_path, job, args):
    env = {"MASTER": "local[2]", "PYTHONPATH": str(ROOT), "SPARK_LOCAL_IP": "127.0.0.1"}
    args = [a.format(sf="/root/testdata/sf0.001", tmp=tmp_path) for a in args]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args], cwd=ROOT, env=os.environ | env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and "read" in done.stderr
    assert list((tmp_path / "out").rglob("*.parquet"))
