"""Volumes in single-file NIfTI-1 format as a Spark data source, and their writer.

``spark.dataSource.register(NiftiSource)`` then ``spark.read.format("nifti").load(folder)`` gives a row per non-zero voxel
(or every voxel with option dense): file, vid, i, j, k, value. ``headers`` gives shape, affine and spacing. The functions here read
files whole through Spark's own readers, so any store that Spark reads will do, a file in a task; ``volumes.NiftiSource``
reads large files in slabs.
"""

from __future__ import annotations

import gzip
import io
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: codes of voxel types.
TYPES = {2: np.uint8, 4: np.int16, 8: np.int32, 16: np.float32, 64: np.float64, 256: np.int8, 512: np.uint16, 768: np.uint32, 1024: np.int64}
_CODES = {np.dtype(v): k for k, v in TYPES.items()}


#: Bytes that hold a header.
HEAD = 352


class Header(NamedTuple):
    """What a file says of its voxels: the array is [i, j, k], first index fastest, from byte ``offset`` on."""

    shape: tuple[int, int, int]
    dtype: np.dtype
    offset: int
    slope: float
    shift: float
    affine: np.ndarray
    spacing: tuple[float, float, float]

    def scaled(self, data: np.ndarray) -> np.ndarray:
        return data * self.slope + self.shift if self.slope not in (0.0, 1.0) or (self.slope and self.shift) else data


def header(raw: bytes) -> Header:
    """The header from a file's first ``HEAD`` bytes, decompressed; sform before qform before the spacing alone."""
    if len(raw) < HEAD - 4:
        raise ValueError("not a NIfTI-1 file")
    end = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(f"{end}i", raw[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(f"{end}8h", raw[40:56])
    code = struct.unpack(f"{end}h", raw[70:72])[0]
    pix = struct.unpack(f"{end}8f", raw[76:108])
    at, slope, shift = struct.unpack(f"{end}3f", raw[108:120])
    qcode, scode = struct.unpack(f"{end}2h", raw[252:256])
    shape = tuple(max(1, d) for d in (dim[1:4] if dim[0] >= 3 else (*dim[1 : 1 + dim[0]], 1, 1)[:3]))
    affine = np.diag([*pix[1:4], 1.0])
    if scode > 0:
        affine[:3] = np.array(struct.unpack(f"{end}12f", raw[280:328])).reshape(3, 4)
    elif qcode > 0:
        b, c, d, x, y, z = struct.unpack(f"{end}6f", raw[256:280])
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        turn = np.array(
            [
                [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
                [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
                [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
            ]
        )
        affine[:3, :3] = turn * (pix[1], pix[2], pix[3] * (pix[0] or 1.0))
        affine[:3, 3] = x, y, z
    return Header(shape, np.dtype(TYPES[code]).newbyteorder(end), int(at), slope, shift, affine, tuple(float(p) for p in pix[1:4]))


def _plain(raw: bytes, most: int | None = None) -> bytes:
    """A file's bytes, or its first ones, decompressed if they have to be."""
    if raw[:2] != b"\x1f\x8b":
        return raw if most is None else raw[:most]
    return gzip.decompress(raw) if most is None else gzip.GzipFile(fileobj=io.BytesIO(raw)).read(most)


def parse(raw: bytes) -> tuple[np.ndarray, np.ndarray, tuple[float, float, float]]:
    """(voxels [i, j, k], 4x4 affine, spacing) of a file."""
    raw = _plain(raw)
    h = header(raw)
    data = np.frombuffer(raw, h.dtype, int(np.prod(h.shape)), h.offset).reshape(h.shape, order="F")
    return h.scaled(data), h.affine, h.spacing


def build(data: np.ndarray, affine: np.ndarray, compress: bool = False) -> bytes:
    """A file's bytes from voxels and affine."""
    if np.dtype(data.dtype) not in _CODES:
        data = data.astype(np.float32)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *data.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, _CODES[np.dtype(data.dtype)], data.dtype.itemsize * 8)
    spacing = np.sqrt((np.asarray(affine)[:3, :3] ** 2).sum(0))
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *np.asarray(affine, float)[:3].ravel())
    head[344:348] = b"n+1\0"
    raw = bytes(head) + np.asfortranarray(data).tobytes(order="F")
    return gzip.compress(raw) if compress else raw


_GRID = "file string, nx int, ny int, nz int, affine array<array<double>>, spacing array<double>"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"), "content")


def headers(spark: SparkSession, path: str, pattern: str = "*.nii*") -> DataFrame:
    """A row per file: file, nx, ny, nz, affine, spacing. No voxel is decoded; see ``volumes`` for a source that doesn't read them
    either."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = header(_plain(raw, HEAD))
                yield pa.RecordBatch.from_pylist(
                    [{"file": name, **dict(zip(("nx", "ny", "nz"), h.shape, strict=True)), "affine": h.affine.tolist(), "spacing": list(h.spacing)}],
                    schema=pa.schema(
                        [("file", pa.string()), *((c, pa.int32()) for c in ("nx", "ny", "nz")), ("affine", pa.list_(pa.list_(pa.float64()))), ("spacing", pa.list_(pa.float64()))]
                    ),
                )

    return _files(spark, path, pattern).mapInArrow(run, _GRID)


def voxels(spark: SparkSession, path: str, pattern: str = "*.nii*", dense: bool = False) -> DataFrame:
    """A row per voxel that isn't 0 (every one if ``dense``): file, vid, i, j, k, value."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                flat = parse(raw)[0]
                nx, ny, _ = flat.shape
                flat = flat.ravel(order="F")
                at = np.arange(len(flat)) if dense else np.flatnonzero(flat)
                for n in range(0, len(at), 65536):
                    v = at[n : n + 65536]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(v)), pa.array(v), pa.array((v % nx).astype(np.int32)), pa.array((v // nx % ny).astype(np.int32)),
                            pa.array((v // (nx * ny)).astype(np.int32)), pa.array(flat[v].astype(np.float64)),
                        ],
                        names=["file", "vid", "i", "j", "k", "value"],
                    )

    return _files(spark, path, pattern).mapInArrow(run, "file string, vid long, i int, j int, k int, value double")


def pack(v: DataFrame, grid: DataFrame, key: str = "file", dtype: str = "float32", compress: bool = True) -> DataFrame:
    """(key, content): files of sparse voxels and their headers, each sample built in its own group."""
    import pandas as pd

    def f(vox: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        if not len(head):
            return pd.DataFrame(columns=[key, "content"])
        h = head.iloc[0]
        data = np.zeros((h.nx, h.ny, h.nz), dtype)
        if len(vox):
            data[vox["i"], vox["j"], vox["k"]] = vox["value"]
        return pd.DataFrame({key: [h[key]], "content": [build(data, np.array([list(r) for r in h.affine]), compress)]})

    return v.groupBy(key).cogroup(grid.groupBy(key)).applyInPandas(f, f"{key} string, content binary")
