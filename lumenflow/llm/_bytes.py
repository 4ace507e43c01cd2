"""Whole texts as byte arrays: Arrow columns to numpy, words and 64-bit hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text worked on at once; a single longer text is worked on whole.
SLICE_BYTES = 1 << 20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of at most ``limit`` bytes of text, at least one row each."""
    n = batch.num_rows
    if not n:
        return
    _, offs = bytes_of(column(batch, name))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to


def mapper(f: Callable[[pa.RecordBatch], list], names: list[str], types: list[pa.DataType], text: str = "text"):
    """A function for mapInArrow that calls ``f`` on runs of bounded bytes; ``f`` returns the columns."""

    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                got = f(part)
                if got is not None:
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(got, types, strict=True)],
                        schema=schema,
                    )

    return run


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte classes: what is neither a space nor one of the five controls after it; ASCII digits, letters and all above.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


def tokens(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes of a class; runs never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    edge[0] = edge[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BASE = U(0x9E3779B97F4A7C15)
_TABLE = mix(np.arange(1, 257, dtype=U) * _BASE)
_R = 0xD1342543DE82EF95
_R_INV = pow(_R, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "i" if inverse else "p"
    if key not in _pow or len(_pow[key]) < n:
        size = max(n, SLICE_BYTES + 1)
        p = np.full(size, _R_INV if inverse else _R, U)
        p[0] = 1
        got = np.cumprod(p, dtype=U)
        if size > 4 * SLICE_BYTES:  # a very long text's table isn't kept
            return got[:n]
        _pow[key] = got
    return _pow[key][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = r**i * hash of bytes i to j, modulo 2**64."""
    h = np.empty(len(data) + 1, U)
    h[0] = 0
    np.cumsum(_TABLE[data] * powers(len(data)), dtype=U, out=h[1:])
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of spans of bytes. Spans over 256 bytes are hashed by xxh3 instead, since polynomials modulo 2**64
    have known collisions among long strings."""
    h = prefix_hash(data) if h is None else h
    got = mix((h[ends] - h[starts]) * powers(len(data) + 1, inverse=True)[starts] + (ends - starts).astype(U) * _BASE)
    for i in np.flatnonzero(ends - starts > 256):
        got[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return got


def packed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from values in row order and the number of them in each row."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column: bytes bounds[i] to bounds[i + 1]."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with equal keys, one batch for each key, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [column(b, k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
