"""Toxicity by multiple-instance learning: documents carry labels, sentences are scored.

A sentence's probability is a logistic function of the hashed affixes and words in it; a document's is their noisy-or,
1 - prod(1 - p). The gradient of the documents' likelihood reaches each sentence in proportion to its share in the
noisy-or, so that training on document labels finds the sentences that explain them, and ``sentences`` gives these.

Sentences end at ., !, ? and line ends. The model learns, in a task, from a bounded sample of labelled rows; its inputs are
texts.

Defined results: null and empty text have no sentence and score 0; a text without an end mark is one sentence, and a text is
read whole, however long; labels that are null, or whose document is missing, teach nothing, conflicting labels of an id
count as toxic, and each text of an id that repeats has its label; with no label of either kind to learn from, all scores
are 0; equal words weigh alike, and equal texts score alike; rows that repeat an id are separate; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import _bytes as B
from lumenflow.llm import _features as W
from lumenflow.llm._sampling import fitted, unit

BITS, AFFIXES = 18, (3, 4, 5, 6, 7, 8)
#: Pairs of a row and a feature that are counted at once.
PAIRS = 1 << 20
_END = np.zeros(256, bool)
_END[[ord("."), ord("!"), ord("?"), ord("\n"), ord("\r")]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _parse(data: np.ndarray, offs: np.ndarray):
    """Words and sentences: (lower-cased bytes, word starts, ends, sentence of each word, row of each sentence, first and
    last byte of each sentence)."""
    low = B.LOWER[data]
    s, e, row = B.tokens(low, offs, W.LETTERS)
    a, z, owner = B.tokens(low, offs, ~_END)
    return low, s, e, np.searchsorted(a, s, "right") - 1, owner, a, z


def _word_sums(weights: np.ndarray, index: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[index], offs[:-1]) if len(offs) > 1 else np.zeros(0, weights.dtype)


def _sample_features(texts: list[str]):
    """(features of the distinct words, their offsets; for each word that a sentence holds, once: the sentence and the word's
    place; row of each sentence). Texts are hashed in runs of bounded bytes."""
    table = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    hashes, features, sizes, sents, kinds, owners = [], [], [], [], [], []
    rows = sentences_ = words = 0
    for part in B.slices(table):
        low, s, e, sent, owner, _, _ = _parse(*B.bytes_of(B.column(part, "text")))
        if len(s):
            h, first, kind = W.distinct(B.span_hashes(low, s, e))
            index, at = W.of_words(low, s[first], e[first], BITS, AFFIXES, ())
            # a word counts once in a sentence
            pairs = np.unique(sent.astype(np.int64) * len(h) + kind)
            sents.append(pairs // len(h) + sentences_)
            kinds.append(pairs % len(h) + words)
            hashes.append(h)
            features.append(index)
            sizes.append(np.diff(at))
            words += len(h)
        owners.append(owner + rows)
        sentences_ += len(owner)
        rows += part.num_rows
    if not words:
        z = np.zeros(0, np.int64)
        return z, np.zeros(1, np.int64), z, z, z
    index, size = np.concatenate(features), np.concatenate(sizes)
    _, first, place = W.distinct(np.concatenate(hashes))
    begin, n = (np.cumsum(size) - size)[first], size[first]
    index = index[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    return index, np.concatenate([[0], np.cumsum(n)]), np.concatenate(sents), place[np.concatenate(kinds)], np.concatenate(owners)


def fit(sample: list[tuple[int, str]], odds: float = 1.0, rounds: int = 150, rate: float = 0.3, l1: float = 1e-5, least_z: float = 5.0):
    """Train on (label, text) rows. ``odds``: how often a clean row stands for another in the corpus, relative to a toxic
    one.

    Only features that toxic rows hold more often, by ``least_z`` deviations of the difference of the two shares, are used,
    and no weight is negative: a sentence is toxic for what it holds, and nothing else in it makes up for that.
    """
    y = np.array([int(v) for v, _ in sample])
    if not len(y) or y.all() or not y.any():
        return None
    index, at, sent, kind, owner = _sample_features([t for _, t in sample])
    if not len(sent):
        return None
    words = len(at) - 1
    doc = owner[sent]
    lens = np.diff(at)
    held = np.zeros((2, 1 << BITS))
    seen = np.unique(doc.astype(np.int64) * words + kind)
    # a feature counts once in a row; whole rows, so many features at once
    load = np.cumsum(lens[seen % words])
    row_ends = np.append(np.flatnonzero(np.diff(seen // words)) + 1, len(seen))
    start = 0
    while start < len(seen):
        reach = np.searchsorted(load, (load[start - 1] if start else 0) + PAIRS, "right")
        fit_ = row_ends[(row_ends > start) & (row_ends <= reach)]
        end = int(fit_[-1]) if len(fit_) else int(row_ends[np.searchsorted(row_ends, start, "right")])
        mine = seen[start:end]
        n = lens[mine % words]
        places = np.repeat(at[mine % words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.unique(np.repeat(mine // words, n) << BITS | index[places])
        toxic = y[both >> BITS] == 1
        for label in (0, 1):
            held[label] += np.bincount(both[toxic == label] & ((1 << BITS) - 1), minlength=1 << BITS)
        start = end
    n1, n0 = int(y.sum()), int((1 - y).sum())
    pool = (held[0] + held[1]) / len(y)
    z = (held[1] / n1 - held[0] / n0) / np.sqrt(np.maximum(pool * (1 - pool), 1e-12) * (1 / n1 + 1 / n0))
    usable = z >= least_z
    w, b = np.zeros(1 << BITS), -4.0
    g2, gb2 = np.full(1 << BITS, 1e-8), 1e-8
    each = np.where(y == 1, 1.0, odds)
    each = each / each.sum()
    for _ in range(rounds):
        x = b + np.bincount(sent, _word_sums(w, index, at)[kind], minlength=len(owner))
        p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        log_clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        any_ = -np.expm1(log_clean)
        # d log-likelihood / d z of each sentence
        up = np.where(y == 1, np.exp(log_clean) / np.maximum(any_, 1e-12), -1.0)[owner] * p * each[owner]
        gw = np.bincount(index, np.repeat(np.bincount(kind, up[sent], minlength=words), lens), minlength=1 << BITS)
        gw[~usable] = 0
        g2 += gw * gw
        step = rate / np.sqrt(g2)
        w += step * gw
        w = np.maximum(w - step * l1 * each.max(), 0)
        gb = float(up.sum())
        gb2 += gb * gb
        b += rate * gb / np.sqrt(gb2)
    return Model(w.astype(np.float32), b)


def scored(model: Model, data: np.ndarray, offs: np.ndarray):
    """(probability of each row, of each sentence, row of each sentence, its first and last byte)."""
    low, s, e, sent, owner, a, z = _parse(data, offs)
    words, first, kind = W.distinct(B.span_hashes(low, s, e))
    index, at = W.of_words(low, s[first], e[first], BITS, AFFIXES, ())
    value = _word_sums(model.weights, index, at)
    once = np.unique(sent.astype(np.int64) * max(1, len(words)) + kind)
    sent, kind = once // max(1, len(words)), once % max(1, len(words))
    x = model.bias + np.bincount(sent, value[kind], minlength=len(owner))
    p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    log_clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(offs) - 1)
    return np.clip(-np.expm1(log_clean), 0, 1), p, owner, a, z


def sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 1500, seed: int = 43) -> tuple[DataFrame, dict[int, int]]:
    """((value, text, u) rows, number of labelled ids of each kind): about ``most`` labelled ids of each kind, the ones with the
    lowest keyed hashes. Only ids are sorted out; texts are read for the chosen ones."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("y")
    )
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, most / counts.get(1, 1))).otherwise(min(1.0, most / counts.get(0, 1)))
    # about 2 * most short rows: each id is there once
    some = known.where(unit("doc_id", seed=seed) < share)
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    return rows.select(F.col("y").alias("value"), "text", unit("doc_id", "text", seed=seed).alias("u")).dropDuplicates(["value", "u"]), counts


def train(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 1500, most_bytes: int = 12 << 20, **options) -> Model | None:
    """A model from about ``most`` labelled documents of each kind, ``most_bytes`` of text in all."""
    rows, counts = sample(docs, labels, learn, most, **options)
    if len(counts) < 2:
        return None

    def weighed(got: list[tuple]) -> Model | None:
        n = [sum(1 for y, _ in got if y == k) for k in (0, 1)]
        return fit(got, (counts[0] / n[0]) / (counts[1] / n[1])) if all(n) else None

    return fitted(rows, weighed, most_bytes)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """A row per document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    def f(part: pa.RecordBatch) -> list:
        data, offs = B.bytes_of(B.column(part, "text"))
        p = scored(shared.value, data, offs)[0] if shared.value is not None and len(data) else np.zeros(part.num_rows)
        return [B.column(part, "doc_id"), p]

    run = B.mapper(f, ["doc_id", "score"], [pa.int64(), pa.float64()])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def sentences(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The offending sentences: doc_id, sentence, probability, for each whose own probability is at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(part: pa.RecordBatch) -> list | None:
        data, offs = B.bytes_of(B.column(part, "text"))
        if not len(data):
            return None
        _, p, owner, a, z = scored(shared.value, data, offs)
        hit = np.flatnonzero(p >= least)
        texts = [data[a[i] : z[i]].tobytes().decode() for i in hit]
        return [B.column(part, "doc_id").take(pa.array(owner[hit])), pa.array(texts, pa.string()), p[hit]]

    run = B.mapper(f, ["doc_id", "sentence", "probability"], [pa.int64(), pa.string(), pa.float64()])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sentence string, probability double")
