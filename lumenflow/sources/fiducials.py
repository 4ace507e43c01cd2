"""Fiducial point lists: comment lines, a coordinate system in the header, one point per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the format: its first line, the columns of a point line, and the prefix of node names.
VERSION = "# Markups fiducial file version = 4.11"
COLUMNS = "# columns = id,x,y,z,ow,ox,oy,oz,vis,sel,lock,label,desc,associatedNodeID"
NODE = "vtkMRMLMarkupsFiducialNode_"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, id, x, y, z, label) in RAS: files whose header says LPS (or says nothing) have x and y negated."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    system = F.upper(F.regexp_extract("value", r"(?m)^#\s*CoordinateSystem\s*=\s*(\w+)", 1))
    flip = F.when(system.isin("RAS", "0"), 1.0).otherwise(-1.0)
    rows = lines.select("file", flip.alias("s"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    rows = rows.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("c", F.split("value", ","))
    num = lambda n: F.expr(f"try_cast(trim(get(c, {n})) AS DOUBLE)")
    out = rows.select(
        "file", F.col("line").alias("pos"), F.col("c")[0].alias("id"), (num(1) * F.col("s")).alias("x"), (num(2) * F.col("s")).alias("y"), num(3).alias("z"),
        F.get("c", F.lit(11)).alias("label"),
    )
    return out.where("x is not null and y is not null and z is not null")


def seed(spark: SparkSession, path: str) -> tuple[float, float, float]:
    """The first point of a file, in RAS."""
    r = read(spark, path).orderBy("file", "pos").limit(1).first()
    if r is None:
        raise ValueError(f"no point in {path}")
    return r["x"], r["y"], r["z"]


def lines(points: DataFrame, system: str | None = "LPS", digits: int = 4, prefix: str = "pt_", numbered: bool = False) -> DataFrame:
    """(place, value): the lines of a file for points (x, y, z in RAS, label). ``system``: that of the numbers, named in the
    header; None leaves them in RAS and unnamed. Points are named by prefix and label, or numbered by label from 0."""
    s = -1.0 if system == "LPS" else 1.0
    name = F.col("label")
    if numbered:
        points = points.withColumn("_n", F.row_number().over(Window.orderBy("label", "x", "y", "z")) - 1)  # a point list is a small report
        name = F.col("_n")
    xyz = [(F.col("x") * s, "x"), (F.col("y") * s, "y"), (F.col("z"), "z")]
    line = F.concat(F.lit(prefix), name.cast("string"), *[F.format_string(f",%.{digits}f", v.cast("double")) for v, _ in xyz], F.lit(",0,0,0,1,1,1,0,"), F.col("label"), F.lit(",,"))
    head = [VERSION, *([f"# CoordinateSystem = {system}"] if system else []), COLUMNS]
    first = points.sparkSession.createDataFrame(list(enumerate(head)), "place int, value string")
    return first.unionByName(points.select(F.lit(len(head)).alias("place"), line.alias("value")))


def write(points: DataFrame, path: str, system: str | None = "LPS", **options) -> None:
    """Write points as one file, see ``lines``. A point list is a small report."""
    lines(points, system, **options).repartition(1).sortWithinPartitions("place", "value").select("value").write.mode("overwrite").text(path)
