"""Bounded, deterministic training samples, and models fitted on them in a task."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut

#: Rows of a table of values up to which it is broadcast (a few MB).
FEW = 20_000


def unit(*cols: Column | str, seed: int = 0) -> Column:
    """A keyed number in [0, 1) of some columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= FEW else table


def stratified(df: DataFrame, by: str, key: str, most: int, text: str = "text", seed: int = 0) -> DataFrame | None:
    """(value, text, u): about ``most`` rows of each value of ``by``, those with the lowest keyed numbers ``u`` of key and text.

    A first pass counts all rows of each value; the second reads those under the value's share. Rows that repeat key and text
    count once. None if there is no value.
    """
    rows = df.where(F.col(by).isNotNull()).select(F.col(by).alias("value"), F.col(text).alias("text"), unit(key, text, seed=seed).alias("u"))
    counts = cut(rows.groupBy("value").agg((float(most) / F.count("*")).alias("share")))
    n = counts.count()
    if not n:
        return None
    some = rows.where("text is not null").join(_small(counts, n), "value").where("u < share").select("value", "text", "u")
    return some.dropDuplicates(["value", "u"])


def rooms(sizes: dict[object, int], most_bytes: int) -> dict[object, int]:
    """Bytes dealt evenly over values that need ``sizes``: one that needs less than an even share leaves the rest to others."""
    out, left = {}, most_bytes
    for n, v in enumerate(sorted(sizes, key=lambda v: (sizes[v], str(v)))):
        out[v] = left // (len(sizes) - n)
        left -= min(sizes[v], out[v])
    return out


def bounded(sample: DataFrame, most_bytes: int) -> DataFrame:
    """Rows (value, text, u, ...) of at most ``most_bytes`` of text, dealt evenly over the values.

    A value's rows are taken by ``u``, those apart that are longer than the value's room. A value of which no text fits gets
    its shortest one beyond the limit, so that no value is lost. A number for each value passes through the driver.
    """
    rows = cut(sample.withColumn("bytes_", F.octet_length("text").cast("long")))
    per = {r["value"]: r for r in rows.groupBy("value").agg(F.sum("bytes_").alias("n"), F.min("bytes_").alias("least")).collect()}
    if not per:
        return rows.drop("bytes_")
    room = rooms({v: r["n"] for v, r in per.items()}, most_bytes)
    kind = rows.schema["value"].dataType.simpleString()
    table = sample.sparkSession.createDataFrame([(v, room[v], per[v]["least"] > room[v]) for v in per], f"value {kind}, room_ long, none_ boolean")
    fits = F.col("bytes_") <= F.col("room_")
    in_turn = Window.partitionBy("value").orderBy("u", "text").rowsBetween(Window.unboundedPreceding, 0)
    short = F.row_number().over(Window.partitionBy("value").orderBy("bytes_", "u", "text")) == 1
    taken = rows.join(_small(table, len(per)), "value").withColumn("run_", F.sum(F.when(fits, F.col("bytes_")).otherwise(0)).over(in_turn)).withColumn("short_", short)
    return taken.where((fits & (F.col("run_") <= F.col("room_"))) | (F.col("none_") & F.col("short_"))).select(*sample.columns)


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], object], most_bytes: int):
    """A model fitted in one task on (value, text, further columns but u): the sample's rows in the order of ``u``, up to
    ``most_bytes`` of text. Texts don't reach the driver; the model does."""
    names = ["value", "text", *[c for c in sample.columns if c not in ("value", "text", "u")]]

    def run(batches):
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(len(names))), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    ordered = bounded(sample, most_bytes).repartition(1).sortWithinPartitions("u", "value", "text").select(*names)
    rows = ordered.mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else fit([])
