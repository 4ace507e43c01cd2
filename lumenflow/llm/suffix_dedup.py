"""Exact substring deduplication by blockwise suffix sorting with a difference-cover sample.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts earlier in the corpus. All occurrences of such
a string meet in one suffix bucket: every string holds the smallest hash of its ``SEED``-byte substrings at one offset (its
anchor), so that the bucket of a suffix is the anchor's hash. Buckets are sorted one block at a time:

1. a scan counts anchors; those that occur once are not shipped (a bitmap of bounded size tells most of them);
2. a second scan ships the bytes around the other anchors, once for each distinct surrounding in a task. An anchor with more
   than ``HOT`` occurrences, whose bucket could fill a task, is dealt over narrower buckets: its strings are grouped by their
   offsets to it, ``NARROW`` offsets at a time (beyond 4 * ``HOT`` one at a time), and the bytes that a group's strings have in
   common join the bucket's key. Equal strings have equal offsets, and meet as before;
3. a task takes its buckets in the order of their bytes, so that equal surroundings come one after the other and all but the
   earliest are marked as they pass; then it sorts the suffixes of the others, a bounded number of bytes at a time: by
   their first 16 bytes, and suffixes that tie there by the rank of the next position of the difference-cover sample, which
   is ranked beforehand by prefix doubling over that sample only. Anchors lie on multiples of the cover's period, so that the
   suffixes of a bucket that can be equal have the same residue, and one shift leads all of them to a sampled position;
4. neighbours in that order with ``LENGTH`` bytes in common are equal strings: all but the earliest are marked.

Defined results: null text is empty, and texts shorter than ``LENGTH`` lose nothing; a row without an id takes no part; rows
that repeat an id with another text are documents of their own, ordered by the MD5 of their texts; rows that repeat id and
text are one document, and each of them gets its result; a document is scanned whole, however long; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut
from lumenflow.llm import _bytes as B
from lumenflow.llm.near_dedup import Filter

LENGTH, SEED = 100, 32
HOT, NARROW = 10_000, 8
#: Period and residues of a difference cover: every difference modulo 31 is one of two residues.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
_NEXT = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
_SAMPLED = np.isin(np.arange(PERIOD), COVER)
#: Bytes of surroundings that are sorted at once.
BLOCK_BYTES = 2 << 20


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, position, first start, last start, row) of each anchor with the run of string starts that it stands for."""
    n, k = len(data), LENGTH - SEED + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none, none
    h = B.prefix_hash(data)
    h = B.mix((h[SEED:] - h[:-SEED]) * B.powers(n + 1, inverse=True)[: n - SEED + 1])
    # the smallest hash, the leftmost of equal ones: low bits hold the position
    bits = np.uint64(int(n).bit_length())
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    m, span = key, 1
    while span * 2 <= k:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    last = len(key) - k + 1
    at = (np.minimum(m[:last], m[k - span : k - span + last]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    s = np.arange(last)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:last]
    inside = s + LENGTH <= offs[row + 1]
    s, at, row = s[inside], at[inside], row[inside]
    if not len(s):
        return none.astype(np.uint64), none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    return h[at[new]], at[new], s[new], np.append(s[new[1:] - 1], s[-1]), row[new]


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return data[at]


def _words(x: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte words at each position of ``x``; zeros follow it."""
    padded = np.concatenate([x, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(x), np.uint64)
    for i in range(8):
        out |= padded[i : i + len(x)] << np.uint64(8 * (7 - i))
    return out


def _names(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples, from 1, equal ones alike. The first key is the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = 1 + np.cumsum(new)
    return out


def cover_ranks(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Ranks of the sampled positions among all sampled ones, by at least 4 * PERIOD bytes or as far as their text goes;
    0 elsewhere. ``left``: bytes from each position to the end of its text. Positions count from a multiple of PERIOD."""
    n = len(text)
    spots = np.flatnonzero(np.resize(_SAMPLED, n) & (left > 0))
    rank = np.zeros(n + PERIOD * 4, np.int64)
    if not len(spots):
        return rank
    # bytes beyond the end count as nothing: the length that is left tells a text's end from a zero byte
    w = _words(text)
    w = np.concatenate([w, np.zeros(32, np.uint64)])
    keys = []
    for i in range(4):
        have = np.clip(left[spots] - 8 * i, 0, 8 if i < 3 else 7)
        mask = np.where(have > 0, ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * np.maximum(have, 1).astype(np.uint64)) % np.uint64(64), np.uint64(0))
        mask = np.where(have >= 8, ~np.uint64(0), mask)
        keys.append(w[spots + 8 * i] & mask)
    keys.append(np.minimum(left[spots], PERIOD))
    rank[spots] = _names(*keys)
    span = PERIOD
    while span < LENGTH:  # a sampled position plus the period is sampled too
        follow = np.where(left[spots] > span, rank[spots + span], 0)
        rank[spots] = _names(rank[spots], follow)
        span *= 2
    return rank


def mark_block(bucket, before, count, size, data) -> np.ndarray:
    """Sort the suffixes of some whole buckets; True for each string that starts earlier elsewhere.

    A surrounding has: its bucket; ``before``, bytes from its first string's start to the anchor; ``count`` of strings; its
    ``size`` and bytes. Surroundings come by document and anchor; so do the strings that are returned.
    """
    # lay the surroundings out with their anchors on multiples of the period
    lead = (-before) % PERIOD
    room = -(-(lead + size) // PERIOD) * PERIOD + PERIOD
    at = np.cumsum(room) - room
    text, left = np.zeros(int(room.sum()), np.uint8), np.zeros(int(room.sum()), np.int64)
    spots = np.repeat(at + lead - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    text[spots] = data
    left[spots] = np.repeat(at + lead + size, size) - spots
    rank = cover_ranks(text, left)
    owner = np.repeat(np.arange(len(bucket)), count)
    i = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    s = at[owner] + lead[owner] + i
    # the suffix bucket: the anchor and the offset to it
    suffix = bucket[owner].astype(np.int64) * LENGTH + (before[owner] - i)
    w = _words(text)
    # a sampled position follows within 12 bytes: the first 16 and its rank put suffixes of a bucket in order
    order = np.lexsort((rank[s + _NEXT[s % PERIOD]], w[s + 8], w[s], suffix))
    # neighbours are equal if all words of their LENGTH bytes are
    new = np.ones(len(order), bool)
    new[1:] = suffix[order][1:] != suffix[order][:-1]
    same = np.flatnonzero(~new)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        differ = w[s[order[same]] + k] != w[s[order[same - 1]] + k]
        new[same[differ]] = True
        same = same[~differ]
    out = np.ones(len(order), bool)
    # the earliest of each run of equal strings stays: surroundings come by document and anchor, so that among strings with
    # one offset to their anchor the first in number is the first in place
    if len(order):
        out[np.minimum.reduceat(order, np.flatnonzero(new))] = False
    return out


def _spans(doc: np.ndarray, key: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the ranges a to z that touch or overlap in a document."""
    if not len(doc):
        return doc, key, a, z
    order = np.lexsort((z, a, key, doc))
    doc, key, a, z = doc[order], key[order], a[order], z[order]
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    # the furthest end so far within a document
    big = np.int64(1) << np.int64(40)
    group = np.cumsum(first)
    far = np.maximum.accumulate(z + group * big) - group * big
    new = np.flatnonzero(first | np.concatenate([[False], a[1:] > far[:-1]]))
    return doc[new], key[new], a[new], far[np.append(new[1:] - 1, len(far) - 1)]


_SPAN = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("a", pa.int64()), ("z", pa.int64())])


def _span_batch(doc, key, a, z) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _spans(doc, key, a, z)], schema=_SPAN)


def _numbers(part: pa.RecordBatch, name: str) -> np.ndarray:
    return B.column(part, name).to_numpy(zero_copy_only=False).astype(np.int64)


def bitmap(hashes: DataFrame, column: str, most: int = 1 << 28) -> np.ndarray:
    """Bits of the hashes' low ends, of a power of two and at most ``most`` in number."""
    n, bits = hashes.count(), 1 << 15
    while bits < min(16 * n, most):
        bits *= 2
    spot = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:  # 4 KB each
        at = (r["b"] - 1) * 4096
        out[at : at + len(r["m"])] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def _among(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    spot = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return ((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)


def narrowed(data: np.ndarray, rows: tuple[np.ndarray, ...], width: int) -> tuple[np.ndarray, ...]:
    """Anchors' runs of strings, cut into groups of ``width`` offsets to the anchor; a group's hash is that of the bytes which
    all strings with these offsets have in common."""
    h, p, a, z, row = rows
    low = (p - z) // width
    n = (p - a) // width - low + 1
    each = np.repeat(np.arange(len(h)), n)
    group = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    start = p[each] - group * width  # the last string's start, from which on all strings of the group hold these bytes
    common = B.span_hashes(data, start, start + LENGTH + 1 - width)
    h = B.mix(h[each] ^ B.mix(common + group.astype(np.uint64)))
    return h, p[each], np.maximum(a[each], start - width + 1), np.minimum(z[each], start), row[each]


_ROW = pa.schema(
    [("h", pa.int64()), ("before", pa.int32()), ("count", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())]
)
_ROW_SQL = "h long, before int, count int, doc_id long, key long, start long, bytes binary"


def _surroundings(many, hot, hotter):
    """Per run of documents: its distinct surroundings of anchors that occur again, and as rows of count 0 the spans of those
    that repeat an earlier one of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, limit=2 * B.SLICE_BYTES):
                data, offs = B.bytes_of(B.column(part, "text"))
                doc, key = _numbers(part, "doc_id"), _numbers(part, "key")
                rows = anchors(data, offs)
                rows = tuple(x[_among(many.value, rows[0])] for x in rows)
                wide, narrow = _among(hot.value, rows[0]), _among(hotter.value, rows[0])
                kinds = [(~wide, 0), (wide & ~narrow, NARROW), (wide & narrow, 1)]
                parts = [narrowed(data, tuple(x[m] for x in rows), k) if k else tuple(x[m] for x in rows) for m, k in kinds]
                h, p, a, z, row = (np.concatenate(c) for c in zip(*parts, strict=True))
                if not len(h):
                    continue
                size, start = z - a + LENGTH, a - offs[row]
                place = _names(doc, key)[row]
                whole = B.span_hashes(data, a, a + size)
                order = np.lexsort((start, place, p - a, size, whole, h))
                same = np.zeros(len(h), bool)
                for x in (h, whole, size, p - a):
                    same[1:] |= x[order][1:] != x[order][:-1]
                same[1:] = ~same[1:]
                # of a class of equal surroundings the earliest goes on; one at the same place is the same row again
                head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))]
                other = order[same & ((place[order] != place[head]) | (start[order] != start[head]))]
                first = order[~same]
                bounds = np.concatenate([[0], np.cumsum(size[first])])
                yield _row_batch(
                    h[first].view(np.int64), (p - a)[first], (z - a + 1)[first], doc[row[first]], key[row[first]], start[first],
                    B.binaries(_gather(data, a[first], size[first]), bounds),
                )
                d, k, b, e = _spans(doc[row[other]], key[row[other]], start[other], start[other] + size[other])
                if len(d):
                    spread = B.mix(d.astype(np.uint64) + b.astype(np.uint64)).view(np.int64)
                    yield _row_batch(spread, e - b, np.zeros(len(d)), d, k, b, pa.array([b""] * len(d), pa.binary()))

    return run


def _row_batch(h, before, count, doc, key, start, data) -> pa.RecordBatch:
    cols = [pa.array(h), pa.array(before.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(doc), pa.array(key), pa.array(start), data]
    return pa.RecordBatch.from_arrays(cols, schema=_ROW)


class _Collapse:
    """Sorted rows as they pass: equal surroundings of a bucket follow each other, the earliest first."""

    def __init__(self) -> None:
        self.last: list[np.ndarray] | None = None

    def __call__(self, b: pa.RecordBatch) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...]]:
        """(the first row of each class, spans of the others)."""
        h, before, count, doc, key, start = (_numbers(b, c) for c in ("h", "before", "count", "doc_id", "key", "start"))
        data, offs = B.bytes_of(B.column(b, "bytes"))
        size = np.diff(offs)
        cols = [h, before, size, B.span_hashes(data, offs[:-1], offs[1:]).view(np.int64), doc, key, start]
        old = 0
        if self.last is not None:
            cols, old = [np.concatenate([x, c]) for x, c in zip(self.last, cols, strict=True)], 1
        new = np.ones(len(cols[0]), bool)
        new[1:] = False
        for x in cols[:4]:
            new[1:] |= x[1:] != x[:-1]
        local = np.concatenate([np.zeros(old, bool), count == 0])
        new |= local
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        again = ~new & np.logical_or.reduce([x != x[head] for x in cols[4:]])
        self.last = [x[head[-1:]] for x in cols]
        again, new = again[old:], new[old:]
        spans = (again | (count == 0), np.where(count == 0, before, size))
        spans = tuple(x[spans[0]] for x in (doc, key, start, start + spans[1]))
        return b.filter(pa.array(new & (count > 0))), spans


def _whole(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch | None]:
    """Batches sorted by h, cut anew so that each holds whole buckets and, unless one bucket is larger, ``limit`` bytes; None
    after each batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        for part in B.slices(b, "bytes", limit) if b.num_rows else ():
            h = B.column(part, "h").to_numpy()
            if held and h[0] != B.column(held[-1], "h")[-1].as_py():
                yield B._joined(held)
                held = []
            new = np.flatnonzero(h[1:] != h[:-1])
            if len(new):
                k = int(new[-1]) + 1
                yield B._joined([*held, part.slice(0, k)])
                held, part = [], part.slice(k)
            held.append(part)
        yield None
    if held:
        yield B._joined(held)


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    collapse, passed = _Collapse(), []

    def firsts():
        for b in batches:
            if b.num_rows:
                rest, spans = collapse(b)
                passed.append(spans)
                yield rest

    for t in _whole(firsts(), BLOCK_BYTES):
        while passed:
            yield _span_batch(*passed.pop())
        if t is not None:
            yield _marked(t)


def _marked(t: pa.RecordBatch) -> pa.RecordBatch:
    """Spans of the strings that start earlier elsewhere, of some whole buckets of distinct surroundings."""
    h, before, count, doc, key, start = (_numbers(t, c) for c in ("h", "before", "count", "doc_id", "key", "start"))
    data, offs = B.bytes_of(B.column(t, "bytes"))
    size = np.diff(offs)
    # buckets with one surrounding hold no two equal strings from different places
    _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    meet = np.flatnonzero(n[inverse] > 1)
    meet = meet[np.lexsort((start[meet] + before[meet], key[meet], doc[meet]))]
    if not len(meet):
        return _span_batch(*[np.zeros(0, np.int64)] * 4)
    dup = mark_block(inverse[meet], before[meet], count[meet], size[meet], _gather(data, offs[meet], size[meet]))
    owner = np.repeat(meet, count[meet])
    i = np.arange(len(owner)) - np.repeat(np.cumsum(count[meet]) - count[meet], count[meet])
    s = start[owner[dup]] + i[dup]
    return _span_batch(doc[owner[dup]], key[owner[dup]], s, s + LENGTH)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key tells rows apart that share an id, and is 0 if none do."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    md5 = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 15), 16, 10).cast("long")
    return rows.select("doc_id", (F.lit(0).cast("long") if shared.isEmpty() else md5).alias("key"), "text")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, key, a, z): bytes a to z of a document (doc_id, key, text) repeat an earlier string. Spans can overlap."""
    spark = texts.sparkSession
    texts = texts.where("text is not null and doc_id is not null")

    def count(part: pa.RecordBatch) -> list:
        h, n = np.unique(anchors(*B.bytes_of(B.column(part, "text")))[0], return_counts=True)
        return [h.view(np.int64), n]

    run = B.mapper(count, ["h", "n"], [pa.int64(), pa.int64()])
    many = cut(texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    maps = [spark.sparkContext.broadcast(bitmap(x, "h")) for x in (many, many.where(F.col("n") > HOT), many.where(F.col("n") > 4 * HOT))]
    order = ["h", "before", "bytes", "doc_id", "key", "start"]
    blocks = texts.mapInArrow(_surroundings(*maps), _ROW_SQL).repartition("h").sortWithinPartitions(*order)
    return blocks.mapInArrow(_sorted_blocks, "doc_id long, key long, a long, z long")


def dedup(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay, as text where they
    are valid UTF-8, else with replacement characters)."""
    texts = _keyed(docs)
    spans = cut(repeated_spans(texts))
    # a document's spans are few: overlapping ones were joined where they were found
    per = cut(spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("a", "z"))).alias("spans")))
    # a document that the bitmap of those with spans doesn't hold needs no join
    some = Filter(per, "doc_id")
    shared = some.share(docs.sparkSession)
    spotted = texts.withColumn("spot", some.spot())

    def held(part: pa.RecordBatch, yes: bool) -> pa.RecordBatch:
        spot = B.column(part, "spot").to_numpy(zero_copy_only=False)
        return part.filter(pa.array(((shared.value[spot >> 3] >> (spot & 7)) & 1).astype(bool) == yes))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = held(batch, True)
            if part.num_rows:
                yield part.select(["doc_id", "key", "text"])

    rows = spotted.mapInArrow(asking, "doc_id long, key long, text string").join(per, ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    free = spotted.withColumn("spans", F.lit(None).cast("array<struct<a:bigint,z:bigint>>"))

    def f(part: pa.RecordBatch) -> list:
        data, offs = B.bytes_of(B.column(part, "text"))
        removed, runs, digest, kept = [], [], [], []
        for i, spans in enumerate(B.column(part, "spans").to_pylist()):
            text = data[offs[i] : offs[i + 1]]
            edge = np.zeros(len(text) + 1, np.int64)
            for s in spans or ():
                edge[min(s["a"], len(text))] += 1
                edge[min(s["z"], len(text))] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            removed.append(int(gone.sum()))
            runs.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
            rest = text[~gone].tobytes()
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "replace"))
        return [
            B.column(part, "doc_id"), np.diff(offs), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
            pa.array(digest, pa.string()), pa.array(kept, pa.string()),
        ]

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    run = B.mapper(f, names, [*[pa.int64()] * 4, pa.string(), pa.string()])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    alone = free.mapInArrow(lambda batches: run(held(b, False) for b in batches), schema)
    return rows.mapInArrow(run, schema).unionByName(alone)
