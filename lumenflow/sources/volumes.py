"""The NIfTI reader as a named format whose partitions are slabs of slices."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from lumenflow.sources import nifti

#: Voxels in a slab, unless option ``slices`` says how many slices.
SLAB_VOXELS = 1 << 22
#: Names of a voxel's indices, slowest first, by option ``order``.
ORDERS = {"ijk": ("k", "j", "i"), "zyx": ("z", "y", "x")}
_HEADER = "file string, nx int, ny int, nz int, affine array<array<double>>, spacing array<double>"


class NiftiSource(DataSource):
    """``format("nifti")`` with option ``paths`` (comma-separated files or folders) gives a row per voxel that isn't 0.

    Options: ``dense`` "true" for every voxel; ``order`` "ijk" (file, vid, i, j, k, value) or "zyx" (file, vid, z, y, x, value: the
    same voxels by the names that go with arrays of slices); ``what`` "header" for a row per file with shape, affine and spacing;
    ``slices`` of a partition.

    Planning reads headers only, a few hundred bytes a file. An uncompressed file is read slab by slab, each from its own offset
    in a task of its own; a compressed one, which can't be entered midway, is one task that holds one slab at a time. With option
    ``pushdown`` "true", and ``spark.sql.python.filterPushdown.enabled`` set, without which Spark refuses it, comparisons of indices
    with numbers reach the source: slabs outside aren't read.
    """

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        if self.options.get("what") == "header":
            return _HEADER
        k, j, i = ORDERS[self.options.get("order", "ijk")]
        names = (i, j, k) if i == "i" else (k, j, i)
        return f"file string, vid bigint, {', '.join(f'{c} int' for c in names)}, value double"

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("what") == "header":
            return HeaderReader(self.options)
        return BoundedReader(self.options) if str(self.options.get("pushdown", "false")).lower() == "true" else SlabReader(self.options)


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def files(paths: str) -> list[str]:
    """The files of a list of files and folders, those of folders by name."""
    out = []
    for p in filter(None, paths.split(",")):
        system, at = _where(p)
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(at))
            prefix = p[: len(p) - len(at)] if p.endswith(at) else ""
            out += sorted(prefix + f.path for f in found if f.is_file and ".nii" in f.base_name)
        else:
            out.append(p)
    return out


def _open(path: str) -> tuple[BinaryIO, bool]:
    """A stream of a file's plain bytes, and whether it is compressed."""
    system, at = _where(path)
    f = system.open_input_file(at)
    packed = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    return (gzip.GzipFile(fileobj=f), True) if packed else (f, False)


def _head(path: str) -> tuple[nifti.Header, bool]:
    f, packed = _open(path)
    with f:
        return nifti.header(f.read(nifti.HEAD)), packed


class HeaderReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.files = files(options.get("paths") or options.get("path") or "")

    def partitions(self):
        return [InputPartition(self.files[n : n + 256]) for n in range(0, len(self.files), 256)]

    def read(self, partition):
        for path in partition.value if partition else []:
            h, _ = _head(path)
            yield path, *h.shape, h.affine.tolist(), list(h.spacing)


class SlabReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.files = files(options.get("paths") or options.get("path") or "")
        self.dense = str(options.get("dense", "false")).lower() == "true"
        self.order = options.get("order", "ijk")
        self.slices = int(options.get("slices", 0))
        self.low, self.high = [0, 0, 0], [np.inf, np.inf, np.inf]  # bounds of k, j, i

    def _slabs(self, h: nifti.Header) -> list[tuple[int, int]]:
        """(first, end) slices of the slabs that the bounds leave."""
        nx, ny, nz = h.shape
        each = self.slices or max(1, SLAB_VOXELS // (nx * ny))
        first, end = int(min(max(self.low[0], 0), nz)), int(min(self.high[0] + 1, nz))
        return [(k, min(k + each, end)) for k in range(first, end, each)]

    def partitions(self):
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(_head, self.files))
        parts: list[InputPartition] = []
        for path, (h, packed) in zip(self.files, heads, strict=True):
            slabs = self._slabs(h)
            parts += [InputPartition((path, slabs))] * bool(slabs) if packed else [InputPartition((path, [s])) for s in slabs]
        return parts

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way of reading no partitions
            return
        path, slabs = partition.value
        f, packed = _open(path)
        with f:
            h = nifti.header(f.read(nifti.HEAD))
            nx, ny, _ = h.shape
            layer = nx * ny * h.dtype.itemsize
            for first, end in slabs:
                f.seek(h.offset + first * layer)  # forwards, which a compressed stream can do
                raw = f.read((end - first) * layer)
                data = h.scaled(np.frombuffer(raw, h.dtype).reshape(end - first, ny, nx))
                yield from self._rows(path, first, data)

    def _rows(self, path: str, first: int, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        (j0, i0), (j1, i1) = (int(x) for x in self.low[1:]), (int(min(x + 1, n)) for x, n in zip(self.high[1:], data.shape[1:], strict=True))
        part = data[:, j0:j1, i0:i1]
        k, j, i = np.indices(part.shape).reshape(3, -1) if self.dense else np.nonzero(part)
        value = part[k, j, i].astype(np.float64)
        k, j, i = k + first, j + j0, i + i0
        vid = i + data.shape[2] * (j + data.shape[1] * k.astype(np.int64))
        at = dict(zip(ORDERS[self.order], (k, j, i), strict=True))
        names = ("i", "j", "k") if self.order == "ijk" else ("z", "y", "x")
        for n in range(0, len(vid), 65536):
            cut = slice(n, n + 65536)
            columns = [pa.repeat(path, len(vid[cut])), pa.array(vid[cut]), *[pa.array(at[c][cut].astype(np.int32)) for c in names], pa.array(value[cut])]
            yield pa.RecordBatch.from_arrays(columns, ["file", "vid", *names, "value"])


class BoundedReader(SlabReader):
    """A reader that takes comparisons of indices with numbers."""

    def pushFilters(self, filters: list[Filter]):
        """Keep the bounds of indices; Spark applies all other filters itself."""
        for f in filters:
            kind, column = type(f), getattr(f, "attribute", None)
            if column is None or len(column) != 1 or column[0] not in ORDERS[self.order] or not isinstance(getattr(f, "value", None), int):
                yield f
                continue
            n = ORDERS[self.order].index(column[0])
            if kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
                self.low[n] = max(self.low[n], f.value + (kind is GreaterThan))
            if kind in (EqualTo, LessThan, LessThanOrEqual):
                self.high[n] = min(self.high[n], f.value - (kind is LessThan))
            if kind not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                yield f
