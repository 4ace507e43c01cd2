"""Predictions of any model over volumes: overlapping tiles, a model loaded once in each worker, blended results."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.operators import voxel

#: Weights of at most so many bytes travel as a broadcast; larger ones must come as a file.
MOST_BYTES = 64 << 20

#: Models that this worker has loaded.
_loaded: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


class Model:
    """``load`` makes a function from a model's weights; it maps a tile (an array of patch ** 3 floats) to probabilities of the same
    shape. ``weights`` are bytes, or the path of a file that Spark ships to each executor once."""

    def __init__(self, spark: SparkSession, load: Callable[[bytes], Callable[[np.ndarray], np.ndarray]], weights: bytes | str) -> None:
        self.load, self.name, self.file, self.shared = load, uuid.uuid4().hex, None, None
        if isinstance(weights, str):
            spark.sparkContext.addFile(weights)
            self.file = weights.rstrip("/").rpartition("/")[2]
        elif len(weights) > MOST_BYTES:
            raise ValueError(f"{len(weights)} bytes of weights: give a file for more than {MOST_BYTES}")
        else:
            self.shared = spark.sparkContext.broadcast(weights)

    def __getstate__(self) -> dict:
        return self.__dict__.copy()

    def ready(self) -> Callable[[np.ndarray], np.ndarray]:
        """The loaded model; a worker loads it once."""
        if self.name not in _loaded:
            _loaded[self.name] = self.load(self.shared.value if self.shared is not None else Path(SparkFiles.get(self.file)).read_bytes())
        return _loaded[self.name]


def predict(v: DataFrame, shape: tuple[int, int, int], model: Model, patch: int = 64, overlap: int = 8, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """(by.., i, j, k, value) of the voxels (by.., i, j, k, value) of volumes of a shape: every tile is predicted in a task of its own, and a voxel
    takes the mean of its tiles with Gaussian weights, largest in a tile's middle. Places of a tile without a voxel hold 0; a
    null value counts as 0."""
    by = by or []
    kinds = {f.name: f.dataType.simpleString() for f in v.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "i int, j int, k int, value double, w double"])
    tiles = voxel.tiles(v.select(*by, "i", "j", "k", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x")), shape, patch, overlap)
    edge = (np.arange(patch) - (patch - 1) / 2) ** 2
    sigma = patch / 4

    def f(t: pa.Table) -> pa.Table:
        at = tuple(t.column(f"p{c}").to_numpy() for c in "ijk")
        x = np.zeros((patch,) * 3)
        x[at] = t.column("_x").to_numpy()
        p = np.asarray(model.ready()(x), float)
        if p.shape != x.shape:
            raise ValueError(f"the model made {p.shape} of {x.shape}")
        w = np.exp(-(edge[at[0]] + edge[at[1]] + edge[at[2]]) / (2 * sigma * sigma))
        return t.select([*by, "i", "j", "k"]).append_column("value", pa.array(p[at])).append_column("w", pa.array(w))

    return voxel.blend(tiles.groupBy(*by, "ti", "tj", "tk").applyInArrow(f, schema), [*by, "i", "j", "k"])
