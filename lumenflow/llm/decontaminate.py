"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: a row holds one run of documents of bounded bytes, with the sorted terms of that
run, their delta-coded token positions, and each document's first position. Building it needs no shuffle, and it is
written to the shared folder, so that any number of test sets can be searched without reading texts again.

A search looks the test terms up in each block, orders a phrase's terms by their counts there, takes the postings of the
rarest one, shifted back by its offset in the phrase, and intersects them with the shifted lists of the next ones.
Documents never share a phrase: positions leave a gap between two of them. Tests go to the tasks in broadcast chunks of
at most ``chunk_bytes``; a larger test set takes more passes over the stored index.

Words are lower-cased (A-Z) runs of ASCII letters and digits and of everything above ASCII, compared by 64-bit hash.

Defined results: null or empty text has no words and no hits; an item without words has no window and never occurs; rows
that repeat an item_id are one item; all items without an id are one item, which counts but has no name in the list of ids; rows
that repeat a doc_id, with another text or the same, are separate documents with a result each; a null doc_id stays null; a
very long text is indexed whole, as a run of its own; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut
from lumenflow.llm import _bytes as B

_INDEX = "doc_ids array<long>, hashes array<long>, first array<int>, n_words array<int>, terms binary, counts binary, postings binary"


def encode(deltas: np.ndarray) -> np.ndarray:
    """Variable-length bytes of non-negative numbers, seven bits each, the lowest first, the top bit on all but the last."""
    d = deltas.astype(np.int64)
    n = 1 + (d >= 1 << 7) + (d >= 1 << 14) + (d >= 1 << 21) + (d >= 1 << 28)
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(d) else 0, np.uint8)
    at = ends - n
    for k in range(int(n.max()) if len(d) else 0):
        has = np.flatnonzero(n > k)
        out[at[has] + k] = ((d[has] >> (7 * k)) & 127) | np.where(n[has] > k + 1, 128, 0)
    return out


def decode(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    start = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), start)


def _block(part: pa.RecordBatch) -> list:
    data, offs = B.bytes_of(B.column(part, "text"))
    low = B.LOWER[data]
    s, e, row = B.tokens(low, offs, B.WORD_BYTES)
    n = np.bincount(row, minlength=part.num_rows)
    first = np.concatenate([[0], np.cumsum(n + 1)])[:-1]  # a position between documents stays free
    term = B.span_hashes(low, s, e)
    pos = np.arange(len(term)) + row
    order = np.argsort(term, kind="stable")
    term, pos = term[order], pos[order]
    new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    delta = np.diff(pos, prepend=0)
    delta[new] = pos[new]
    counts = np.diff(np.append(new, len(term)))
    one = np.array([part.num_rows])
    whole = pa.array([0, part.num_rows], pa.int32())
    ids, hashes = (pa.ListArray.from_arrays(whole, B.column(part, c).cast(pa.int64())) for c in ("doc_id", "h"))
    binary = [x.tobytes() for x in (term[new], counts.astype(np.int32), encode(delta))]
    return [ids, hashes, B.packed(first, one, pa.int32()), B.packed(n, one, pa.int32()), *(pa.array([x], pa.binary()) for x in binary)]


def build_index(docs: DataFrame) -> DataFrame:
    """The index as a stored table: a row per run of documents, with a number of its own (``block``)."""
    types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 3]
    names = ["doc_ids", "hashes", "first", "n_words", "terms", "counts", "postings"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return cut(rows.mapInArrow(B.mapper(_block, names, types), _INDEX).withColumn("block", F.monotonically_increasing_id()))


def windows(ids: list[str | None], texts: list[str | None], size: int) -> dict[str, np.ndarray | list[str]]:
    """All windows of some items: vocabulary (sorted hashes), terms [windows, size] as places in it, -1 beyond the
    window's length, and the item of each."""
    data, offs = B.bytes_of(pa.array(texts, pa.large_string()))
    low = B.LOWER[data]
    s, e, row = B.tokens(low, offs, B.WORD_BYTES)
    vocabulary, place = np.unique(B.span_hashes(low, s, e), return_inverse=True)
    n = np.bincount(row, minlength=len(ids))
    at = np.concatenate([[0], np.cumsum(n)])[:-1]
    starts = np.concatenate([at[i] + np.arange(max(1, n[i] - size + 1)) for i in range(len(ids)) if n[i]] or [[]]).astype(int)
    item = row[starts] if len(starts) else np.zeros(0, int)
    grid = starts[:, None] + np.arange(size)[None, :]
    inside = grid < (at + n)[item][:, None]
    terms = np.where(inside, place[np.minimum(grid, max(0, len(place) - 1))], -1) if len(starts) else np.zeros((0, size), int)
    _, keep = np.unique(np.column_stack([item, terms]), axis=0, return_index=True)
    return {"vocabulary": vocabulary, "terms": terms[keep], "item": item[keep], "ids": ids}


def lookup(vocabulary: np.ndarray, terms: np.ndarray, counts: np.ndarray, postings: np.ndarray):
    """(count of each wanted term, their first places in the list, the list: sorted keys place << 32 | position)."""
    at = np.minimum(np.searchsorted(terms, vocabulary), max(0, len(terms) - 1))
    has = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
    n = np.where(has, counts[at] if len(terms) else 0, 0).astype(np.int64)
    wanted = np.zeros(len(terms), bool)
    wanted[at[has]] = True
    each = np.repeat(wanted, counts)  # of each posting
    stop = np.flatnonzero(postings < 128)
    keep = np.repeat(each, np.diff(stop, prepend=-1))
    delta = decode(postings[keep])
    # the vocabulary and the block's terms are both sorted by hash, so the kept postings come in its order
    owner = np.repeat(np.flatnonzero(has), n[has])
    total = np.cumsum(delta)
    first = np.cumsum(n[has]) - n[has]
    base = np.repeat(total[first] - delta[first], n[has]) if len(first) else total
    keys = (owner.astype(np.int64) << 32) | (total - base)
    return n, np.cumsum(n) - n, keys


def phrases(tests: dict, n: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start position) of every occurrence of every window in a block."""
    terms = tests["terms"]
    filled = terms >= 0
    count = np.where(filled, n[terms], np.iinfo(np.int64).max)
    live = np.flatnonzero(count.min(axis=1, initial=np.iinfo(np.int64).max) > 0) if len(terms) else np.zeros(0, int)
    order = np.argsort(count[live], axis=1, kind="stable")  # the rarest first
    rows = np.arange(len(live))
    rare = terms[live, order[:, 0]] if len(live) else live
    times = n[rare]
    which = np.repeat(rows, times)
    step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    start = (keys[np.repeat(at[rare], times) + step] & 0xFFFFFFFF) - order[which, 0] if len(which) else np.zeros(0, int)
    for k in range(1, terms.shape[1]):
        if not len(which):
            break
        offset = order[which, k]
        term = terms[live[which], offset]
        ask = (term.astype(np.int64) << 32) | (start + offset)
        found = keys[np.minimum(np.searchsorted(keys, ask), len(keys) - 1)] == ask
        ok = (term < 0) | (found & (start + offset >= 0))
        which, start = which[ok], start[ok]
    return live[which], start


def near(tests: dict, n: np.ndarray, at: np.ndarray, keys: np.ndarray, rarity: np.ndarray, reach: int):
    """(window, position) of every occurrence of a window's rarest term (by ``rarity``; the first of equal ones) with all
    its other terms at most ``reach`` words away, in any order."""
    terms = tests["terms"]
    filled = terms >= 0
    live = np.flatnonzero(np.where(filled, n[terms] > 0, True).all(axis=1)) if len(terms) else np.zeros(0, int)
    top = np.iinfo(np.int64).max
    rare = terms[live, np.argmin(np.where(filled[live], rarity[terms[live]], top), axis=1)] if len(live) else live
    times = n[rare]
    which = np.repeat(np.arange(len(live)), times)
    step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    pos = keys[np.repeat(at[rare], times) + step] & 0xFFFFFFFF if len(which) else np.zeros(0, np.int64)
    for k in range(terms.shape[1]):
        if not len(which):
            break
        term = terms[live[which], k].astype(np.int64)
        low = np.searchsorted(keys, (term << 32) | np.maximum(pos - reach, 0))
        got = keys[np.minimum(low, len(keys) - 1)]
        ok = (term < 0) | ((got >> 32 == term) & ((got & 0xFFFFFFFF) <= pos + reach))
        which, pos = which[ok], pos[ok]
    return live[which], pos


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of intervals that touch or overlap, by start."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[new], end[np.append(new[1:] - 1, len(end) - 1)]


def _search(shared, reach: int | None, rarity):
    out = pa.schema(
        [("block", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()),
         ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        rare = None if rarity is None else rarity.value
        length = (tests["terms"] >= 0).sum(axis=1)
        for batch in batches:
            for r in batch.to_pylist():
                terms = np.frombuffer(r["terms"], np.uint64)
                n, at, keys = lookup(
                    tests["vocabulary"], terms, np.frombuffer(r["counts"], np.int32), np.frombuffer(r["postings"], np.uint8)
                )
                first, n_words = np.array(r["first"], np.int64), np.array(r["n_words"], np.int64)
                if reach is None:
                    w, s = phrases(tests, n, at, keys)
                    e = s + length[w]
                else:
                    w, s = near(tests, n, at, keys, rare, reach)
                    e = s + 1
                doc = np.searchsorted(first, s, "right") - 1
                if reach is not None:  # all terms must be in the document itself
                    ok = (s - reach >= first[doc]) & (s + reach < first[doc] + n_words[doc]) if len(s) else np.zeros(0, bool)
                    inner = [_inside(tests, keys, w[i], s[i], reach, first[doc[i]], n_words[doc[i]]) for i in np.flatnonzero(~ok)]
                    ok[np.flatnonzero(~ok)] = inner
                    w, s, e, doc = w[ok], s[ok], e[ok], doc[ok]
                spans, items = {}, {}
                for d in np.unique(doc):
                    mine = doc == d
                    a, b = merged(s[mine] - first[d], e[mine] - first[d])
                    spans[int(d)] = (a.tolist(), b.tolist())
                    items[int(d)] = sorted({tests["ids"][i] for i in tests["item"][w[mine]]}, key=lambda i: (i is None, i))
                k = len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["block"]] * k, pa.int64()), pa.array(np.arange(k), pa.int32()),
                        pa.array(r["doc_ids"], pa.int64()), pa.array(r["hashes"], pa.int64()), pa.array(n_words, pa.int64()),
                        pa.array([spans.get(i, ([], []))[0] for i in range(k)], pa.list_(pa.int64())),
                        pa.array([spans.get(i, ([], []))[1] for i in range(k)], pa.list_(pa.int64())),
                        pa.array([items.get(i, []) for i in range(k)], pa.list_(pa.string())),
                    ],
                    schema=out,
                )

    return run, "block long, at int, doc_id long, h long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _inside(tests, keys, w, pos, reach, first, n) -> bool:
    for term in tests["terms"][w]:
        if term < 0:
            continue
        ask = (int(term) << 32) | max(pos - reach, first)
        i = np.searchsorted(keys, ask)
        if i >= len(keys) or keys[i] >> 32 != term or keys[i] & 0xFFFFFFFF > min(pos + reach, first + n - 1):
            return False
    return True


def _chunks(benchmark: DataFrame, window: int, chunk_bytes: int):
    """Tests in chunks of bounded bytes. They pass through the driver one chunk at a time."""
    items, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    for r in rows.distinct().toLocalIterator():
        if items and size + len(r["text"] or "") > chunk_bytes:
            yield windows([x[0] for x in items], [x[1] for x in items], window)
            items, size = [], 0
        items.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
    yield windows([x[0] for x in items], [x[1] for x in items], window)


def _counted(index: DataFrame, shared) -> np.ndarray:
    """Occurrences of each term of a chunk's vocabulary in the whole index."""

    def run(batches):
        words = shared.value["vocabulary"]
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                total += lookup(
                    words, np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int32),
                    np.frombuffer(r["postings"], np.uint8),
                )[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(total)], names=["place", "n"])

    out = np.zeros(len(shared.value["vocabulary"]), np.int64)
    got = index.select("terms", "counts", "postings").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    for r in got.collect():  # a number per term of a chunk
        out[r["place"]] = r["n"]
    return out


def search(
    index: DataFrame, benchmark: DataFrame, window: int = 10, reach: int | None = None, chunk_bytes: int = 8 << 20
) -> DataFrame:
    """Occurrences of the benchmark's windows in the indexed documents.

    Returns a row per document: doc_id, h (xxhash64 of its text), n_words, spans (array of start, end: unions of hit words),
    items (ids of the items that occur, sorted as strings; a null for items without an id). With ``reach``, proximity
    matches instead of phrases: occurrences of a window's rarest term that have all its other terms within that many words,
    in any order; the span is that one word.
    """
    spark = index.sparkSession
    found, more = None, None
    for tests in _chunks(benchmark, window, chunk_bytes):
        shared = spark.sparkContext.broadcast(tests)
        rarity = None if reach is None else spark.sparkContext.broadcast(_counted(index, shared))
        run, schema = _search(shared, reach, rarity)
        got = index.mapInArrow(run, schema)
        if found is None:
            found = got
        else:  # of further chunks, the documents that hold something of them
            got = cut(got.where("size(items) > 0"))
            more = got if more is None else more.unionByName(got)
    spans = F.array_sort(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))
    if more is not None:
        found = found.unionByName(more).groupBy("block", "at", "doc_id", "h", "n_words").agg(
            F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        spans = union_of(spans)
    return found.select("doc_id", "h", "n_words", spans.alias("spans"), "items")


def union_of(spans):
    """Unions of sorted spans that touch or overlap."""
    kind = "array<struct<start:bigint,end:bigint>>"
    one = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        spans,
        F.array().cast(kind),
        lambda acc, x: F.when(F.size(acc) == 0, one(x["start"], x["end"]))
        .when(
            x["start"] <= last(acc)["end"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), one(last(acc)["start"], F.greatest(last(acc)["end"], x["end"]))),
        )
        .otherwise(F.concat(acc, one(x["start"], x["end"]))),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """A row per document: doc_id, h (xxhash64 of its text), n_words, n_hit, n_items, items_sha256, contaminated."""
    found = search(build_index(docs), benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        "doc_id", "h", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
