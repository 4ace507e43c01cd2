"""Centerline graphs in ASCII XML polydata: points, polylines and arrays as node and edge tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F




def _numbers(text: Column, kind: str) -> Column:
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.cast(kind))


def _array(section: str, name: str | None) -> Column:
    """The text of a data array inside a section; by name, or its first one."""
    inside = F.regexp_extract("value", rf"(?s)<{section}\b[^>]*>(.*?)</{section}>", 1)
    head = r"<DataArray\b[^>]*>" if name is None else rf'<DataArray\b[^>]*Name="{name}"[^>]*>'
    return F.regexp_extract(inside, rf"(?s){head}(.*?)</DataArray>", 1)


def read(spark: SparkSession, path: str, radius: str = "radius_mm", default_radius: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(nodes: file, node_id, x, y, z, radius; edges: file, edge_id, src, dst, radius).

    A polyline becomes edges between its consecutive points; an edge's radius is its ends' mean, ``default_radius`` where
    the file has none.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = files.select(
        "file", _numbers(_array("Points", None), "double").alias("xyz"), _numbers(_array("PointData", radius), "double").alias("r"),
        _numbers(_array("Lines", "connectivity"), "long").alias("con"), _numbers(_array("Lines", "offsets"), "int").alias("off"),
    )
    n = (F.size("xyz") / 3).cast("int")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("xyz", i * 3).alias("x"), F.get("xyz", i * 3 + 1).alias("y"), F.get("xyz", i * 3 + 2).alias("z"), F.get("r", i).alias("r")))
    nodes = parsed.where(F.size("xyz") >= 3).select("file", F.posexplode(points).alias("node_id", "p")).select(
        "file", F.col("node_id").cast("long").alias("node_id"), "p.x", "p.y", "p.z", F.coalesce("p.r", F.lit(default_radius)).alias("radius")
    )
    lines = parsed.select("file", "con", "r", F.posexplode("off").alias("line", "end"), "off")
    first = F.when(F.col("line") == 0, 0).otherwise(F.get("off", F.col("line") - 1))
    lines = lines.withColumn("ids", F.slice("con", first + 1, F.col("end") - first)).where(F.size("ids") >= 2)
    pair = F.arrays_zip(F.slice("ids", F.lit(1), F.size("ids") - 1).alias("src"), F.slice("ids", F.lit(2), F.size("ids") - 1).alias("dst"))
    edges = lines.select("file", "line", "r", F.posexplode(pair).alias("pos", "e")).select("file", "line", "pos", "r", "e.src", "e.dst")
    w = Window.partitionBy("file").orderBy("line", "pos")
    r = lambda c: F.get("r", F.col(c).cast("int"))
    edges = edges.select(
        "file", (F.row_number().over(w) - 1).cast("long").alias("edge_id"), "src", "dst", F.coalesce((r("src") + r("dst")) / 2, F.lit(default_radius)).alias("radius")
    )
    return nodes, edges


def render(nodes: DataFrame, edges: DataFrame, point_data: list[str], cell_data: list[str], key: str = "file") -> DataFrame:
    """(key, value): one XML document per graph, with point and cell arrays; node ids must count from 0. Null becomes NaN."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NaN"))
    rows = lambda df, order, cols: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[text(c).alias(c) for c in cols]))).alias("a"), F.count("*").alias("n"))
    n = rows(nodes, "node_id", ["x", "y", "z", *point_data]).select(key, F.col("a").alias("pa"), F.col("n").alias("pn"))
    e = rows(edges, "edge_id", ["src", "dst", *cell_data]).select(key, F.col("a").alias("ca"), F.col("n").alias("cn"))
    joined = lambda a, f: F.array_join(F.transform(a, f), " ")
    field = lambda c: lambda p: p[c]
    one = lambda name, body, kind="Float64", extra="": F.concat(F.lit(f'<DataArray type="{kind}" Name="{name}" format="ascii"{extra}>'), body, F.lit("</DataArray>"))
    both = n.join(e, key, "left")
    offsets = F.array_join(F.transform(F.sequence(F.lit(1), F.col("cn").cast("int")), lambda i: (i * 2).cast("string")), " ")
    value = F.concat(
        F.lit('<?xml version="1.0"?><VTKFile type="PolyData" version="1.0" byte_order="LittleEndian"><PolyData>'),
        F.format_string('<Piece NumberOfPoints="%d" NumberOfLines="%d">', F.col("pn"), F.coalesce("cn", F.lit(0))),
        F.lit("<Points>"), one("Points", joined("pa", lambda p: F.concat_ws(" ", p["x"], p["y"], p["z"])), extra=' NumberOfComponents="3"'), F.lit("</Points><Lines>"),
        one("connectivity", F.coalesce(joined("ca", lambda c: F.concat_ws(" ", c["src"], c["dst"])), F.lit("")), "Int64"),
        one("offsets", F.coalesce(offsets, F.lit("")), "Int64"), F.lit("</Lines><PointData>"),
        *[one(c, joined("pa", field(c))) for c in point_data], F.lit("</PointData><CellData>"),
        *[one(c, F.coalesce(joined("ca", field(c)), F.lit(""))) for c in cell_data], F.lit("</CellData></Piece></PolyData></VTKFile>"),
    )
    return both.select(key, value.alias("value"))
