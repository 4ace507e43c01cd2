"""Volumes as ASCII XML image data, and fixed-width console tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: names of the number types.
TYPES = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64"}


def render(v: DataFrame, shape: tuple[int, int, int], affine_diagonal: tuple[float, float, float], origin: tuple[float, float, float], by: str = "sample_id", value: str = "value") -> DataFrame:
    """(by, value): one document for each dense volume (by, i, j, k, value), the first index running fastest. An axis with a
    negative step is flipped, and begins at its other end; steps are positive in the document. A volume is one row."""
    at, start = {}, []
    for c, n, d, o in zip("ijk", shape, affine_diagonal, origin, strict=True):
        at[c] = F.lit(n - 1) - F.col(c) if d < 0 else F.col(c)
        start.append(o + d * (n - 1) if d < 0 else o)
    place = at["i"].cast("long") + shape[0] * (at["j"].cast("long") + shape[1] * at["k"].cast("long"))
    rows = v.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(value).cast("string").alias("x")))).alias("a"))
    kind = TYPES[v.schema[value].dataType.simpleString()]
    extent = " ".join(f"0 {n - 1}" for n in shape)
    head = (
        '<?xml version="1.0"?><VTKFile type="ImageData" version="1.0" byte_order="LittleEndian">'
        f'<ImageData WholeExtent="{extent}" Origin="{" ".join(map(repr, start))}" Spacing="{" ".join(repr(abs(d)) for d in affine_diagonal)}">'
        f'<Piece Extent="{extent}"><PointData Scalars="{value}"><DataArray type="{kind}" Name="{value}" format="ascii">'
    )
    tail = "</DataArray></PointData></Piece></ImageData></VTKFile>"
    return rows.select(by, F.concat(F.lit(head), F.array_join(F.transform("a", lambda s: s["x"]), " "), F.lit(tail)).alias("value"))


def console(rows: DataFrame, label: str, numbers: list[str], width: int = 12, digits: int = 4, mean: str = "MEAN") -> DataFrame:
    """(place, value): the lines of a fixed-width table, a head, the rows by label, and a line of means."""
    cell = lambda c: F.lpad(F.coalesce(F.format_number(F.col(c).cast("double"), digits), F.lit("-")), width, " ")
    line = F.concat(F.rpad(F.col(label).cast("string"), width, " "), *[cell(c) for c in numbers])
    head = label.ljust(width)[:width] + "".join(c[:width].rjust(width) for c in numbers)
    body = rows.select(F.lit(1).alias("place"), F.col(label).cast("string").alias("_l"), line.alias("value"))
    means = rows.agg(*[F.avg(c).alias(c) for c in numbers]).withColumn(label, F.lit(mean)).select(F.lit(2).alias("place"), F.lit("").alias("_l"), line.alias("value"))
    first = rows.sparkSession.createDataFrame([(0, "", head)], "place int, _l string, value string")
    return first.unionByName(body).unionByName(means).orderBy("place", "_l").select("place", "value")
