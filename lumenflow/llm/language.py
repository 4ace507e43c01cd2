"""Language identification by a linear-chain conditional random field over words.

Each word's emission comes from its affixes, character n-grams, the word itself, and the lexicon of words that training
texts of one language use and the others hardly do; transitions between languages are learned. Forward-backward gives
every word's posterior, so that the parts of a code-switched text get their own labels; a document's language is the one
with the largest share of posterior mass over its words.

Chains are runs of ``CHAIN`` words of a document with ``OVER`` words before and after them, whose posteriors are left to the
neighbouring chains: the messages over a border come from words that are read. Training sees chains of single
languages and joined ones, whose label changes, from a bounded sample of labelled rows; prediction sees only the text.

The number of labels is free: the weights are ``MOST`` numbers at most, and with many labels their features share places.

Defined results: null text and text without a letter give `und` with score 0 (as does every text when there is nothing to
learn from); rows that repeat an id are separate; a text is read whole, however long; an empty table gives no rows; other
columns are ignored, or kept whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lumenflow.llm import _bytes as B
from lumenflow.llm import _features as W
from lumenflow.llm._sampling import fitted, stratified

CHAIN, OVER = 64, 16
#: Bits of a feature's place, fewer where there are so many labels that the weights would be more than MOST numbers.
BITS, MOST = 17, 1 << 24
AFFIXES, GRAMS = (1, 2, 3), (2, 3)
UNKNOWN = "und"
#: Letters that count as half known besides those of a text.
DOUBT = 40.0


@dataclass
class Field:
    """A trained chain: labels, feature weights, transition scores, and the lexicon with its weight."""

    labels: list[str]
    bits: int
    weights: np.ndarray  # [2**bits, labels]
    transitions: np.ndarray  # [from, to]
    lexicon: np.ndarray  # sorted word hashes
    owner: np.ndarray  # the label that a lexicon word belongs to
    lexical: np.ndarray  # [labels]: what a lexicon word adds to its label
    seen: np.ndarray  # sorted hashes of all words of the sample
    usual: float  # the least share of a sample's text's letters that stand in words which other texts have too

    def emissions(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        index, offs = W.of_words(low, starts, ends, self.bits, AFFIXES, GRAMS)
        out = W.summed(self.weights, index, offs)
        at, has = self.listed(hashes)
        out[has, self.owner[at[has]]] += self.lexical[self.owner[at[has]]]
        return out

    def listed(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return at, np.flatnonzero(self.lexicon[at] == hashes)


def forward_backward(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors [chains, words, labels] and expected transition counts, from emission scores and the words' mask."""
    n, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    ahead, back = np.empty((n, t, k), e.dtype), np.empty((n, t, k), e.dtype)
    a = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    ahead[:, 0] = a
    for i in range(1, t):
        nxt = (a @ move) * e[:, i]
        nxt /= nxt.sum(axis=1, keepdims=True)
        a = np.where(mask[:, i, None], nxt, a)
        ahead[:, i] = a
    b = np.ones((n, k), e.dtype)
    back[:, -1] = b
    pairs = np.zeros((k, k))
    for i in range(t - 2, -1, -1):
        eb = e[:, i + 1] * b
        has = mask[:, i + 1, None]
        nb = eb @ move.T
        whole = (ahead[:, i] * nb).sum(axis=1, keepdims=True)
        pairs += move * (ahead[:, i].T @ (eb * has / whole))
        b = np.where(has, nb / nb.sum(axis=1, keepdims=True), b)
        back[:, i] = b
    post = ahead * back
    return post / post.sum(axis=2, keepdims=True), pairs


def posteriors(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posteriors alone, without the transition counts."""
    n, t, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max()).astype(e.dtype)
    ahead = np.empty((n, t, k), e.dtype)
    a = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    ahead[:, 0] = a
    for i in range(1, t):
        nxt = (a @ move) * e[:, i]
        nxt /= nxt.sum(axis=1, keepdims=True)
        a = np.where(mask[:, i, None], nxt, a)
        ahead[:, i] = a
    b = np.ones((n, k), e.dtype)
    for i in range(t - 2, -1, -1):
        nb = (e[:, i + 1] * b) @ move.T
        b = np.where(mask[:, i + 1, None], nb / nb.sum(axis=1, keepdims=True), b)
        ahead[:, i] *= b
    return ahead / ahead.sum(axis=2, keepdims=True)


def chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chain, place) of each word, from the words' rows."""
    if not len(row):
        return row, row
    new = np.concatenate([[True], row[1:] != row[:-1]])
    first = np.flatnonzero(new)
    within = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    place = within % CHAIN
    return np.cumsum(place == 0) - 1, place


def _known(met: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return (met + DOUBT / 2) / (letters + DOUBT)


def fit(sample: list[tuple[str, str]], epochs: int = 3, rate: float = 0.5, lexicon_min: int = 5, seed: int = 3) -> Field | None:
    """Train on (label, text) rows by AdaGrad on the chains' conditional likelihood."""
    labels = sorted({v for v, _ in sample})
    if not labels:
        return None
    data, offs = B.bytes_of(pa.array([t for _, t in sample], pa.large_string()))
    low = B.LOWER[data]
    s, e, row = B.tokens(low, offs, W.LETTERS)
    if not len(s):
        return None
    truth = np.array([labels.index(v) for v, _ in sample])[row]
    words, first, kind = W.distinct(B.span_hashes(low, s, e))
    k = len(labels)
    seen = np.zeros((len(words), k))
    np.add.at(seen, (kind, truth), 1)
    total = seen.sum(axis=1)
    listed = np.flatnonzero((total >= lexicon_min) & (seen.max(axis=1) >= 0.8 * total))
    bits = min(BITS, max(8, MOST.bit_length() - 1 - (k - 1).bit_length()))
    field = Field(
        labels, bits, np.zeros((1 << bits, k)), np.zeros((k, k)), words[listed], seen[listed].argmax(axis=1), np.zeros(k), words, 0.0
    )
    once = np.unique(row.astype(np.int64) * len(words) + kind)
    shared = np.bincount(once % len(words), minlength=len(words)) > 1
    field.usual = float(_known(np.bincount(row, (e - s) * shared[kind]), np.bincount(row, e - s)).min())
    index, at = W.of_words(low, s[first], e[first], bits, AFFIXES, GRAMS)
    chain, place = chains(row)
    bounds = np.append(np.flatnonzero(place == 0), len(row))
    rng = np.random.default_rng(seed)
    size = len(bounds) - 1
    sums = [np.full(field.weights.shape, 1e-2), np.full((k, k), 1e-2), np.full(k, 1e-2)]
    lex_at, lex_has = field.listed(words)
    lex_of = np.full(len(words), -1)
    lex_of[lex_has] = field.owner[lex_at[lex_has]]
    for _ in range(epochs):
        order = rng.permutation(size)
        for i in range(0, size, 128):
            take = order[i : i + 128]
            idx = np.full((len(take), int(np.diff(bounds)[take].max())), -1)
            for j, c in enumerate(take):
                span = np.arange(bounds[c], bounds[c + 1])
                if j % 4 == 0 and len(span) > 8:  # the first part of one chain and the last of another
                    other = take[(j + 1) % len(take)]
                    cut_at = int(rng.integers(2, len(span) - 2))
                    span = np.concatenate([span[:cut_at], np.arange(bounds[other], bounds[other + 1])[cut_at:]])[: idx.shape[1]]
                idx[j, : len(span)] = span
            mask = idx >= 0
            used, inverse = np.unique(kind[idx[mask]], return_inverse=True)
            lens = at[used + 1] - at[used]
            feats = index[np.repeat(at[used] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]
            offs_u = np.concatenate([[0], np.cumsum(lens)])
            emit = W.summed(field.weights, feats, offs_u)
            lx = lex_of[used]
            emit[lx >= 0, lx[lx >= 0]] += field.lexical[lx[lx >= 0]]
            scores = np.zeros((*idx.shape, k))
            scores[mask] = emit[inverse]
            post, pairs = forward_backward(scores, mask, field.transitions)
            y = truth[np.maximum(idx, 0)]
            diff = post.copy()
            np.put_along_axis(diff, y[:, :, None], np.take_along_axis(diff, y[:, :, None], 2) - 1, 2)
            diff = diff[mask]
            per_word = np.zeros((len(used), k))
            np.add.at(per_word, inverse, diff)
            by_place = np.argsort(feats, kind="stable")
            places = feats[by_place]
            begin = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            touched, owner = places[begin], np.repeat(np.arange(len(used)), lens)[by_place]
            per_word /= len(take)
            for lo in range(0, k, 64):
                cols = slice(lo, lo + 64)
                w = field.weights[touched, cols]
                g = np.add.reduceat((per_word[:, cols] / lens[:, None])[owner], begin, axis=0) + 1e-4 * w
                square = sums[0][touched, cols] + g * g
                sums[0][touched, cols] = square
                field.weights[touched, cols] = w - rate * g / np.sqrt(square)
            real = np.zeros((k, k))
            both = mask[:, 1:] & mask[:, :-1]
            np.add.at(real, (y[:, :-1][both], y[:, 1:][both]), 1)
            g = (pairs - real) / len(take) + 1e-3 * field.transitions
            sums[1] += g * g
            field.transitions -= 0.2 * g / np.sqrt(sums[1])
            g = np.zeros(k)
            np.add.at(g, lx[lx >= 0], per_word[np.flatnonzero(lx >= 0), lx[lx >= 0]])
            g = g + 1e-3 * field.lexical
            sums[2] += g * g
            field.lexical -= 0.2 * g / np.sqrt(sums[2])
    field.weights = field.weights.astype(np.float32)
    field.lexical = field.lexical.astype(np.float32)
    field.transitions = field.transitions.astype(np.float32)
    return field


def tagged(field: Field, low: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray):
    """(words, their posteriors [words, labels]) of runs of words, all of them in turn; then the hashes of the distinct
    words and each word's place among them."""
    words, first, kind = W.distinct(B.span_hashes(low, s, e))
    emit = field.emissions(low, s[first], e[first], words)
    k = len(field.labels)
    _, place = chains(row)
    start = np.flatnonzero(place == 0)
    end = np.append(start[1:], len(row))
    begin = np.searchsorted(row, row[start], "left")  # of the document
    stop = np.searchsorted(row, row[start], "right")
    left, right = np.maximum(start - OVER, begin), np.minimum(end + OVER, stop)
    at_once = max(1, min(1024, (1 << 21) // ((CHAIN + 2 * OVER) * k)))

    def blocks():
        for i in range(0, len(start), at_once):
            a, z, lo, hi = (x[i : i + at_once] for x in (start, end, left, right))
            at = lo[:, None] + np.arange(int((hi - lo).max()))[None, :]
            mask = at < hi[:, None]
            scores = np.zeros((*at.shape, k), np.float32)
            scores[mask] = emit[kind[at[mask]]]
            own = (at >= a[:, None]) & (at < z[:, None])
            yield at[own], posteriors(scores, mask, field.transitions)[own]

    return blocks(), words, kind


def _no_letter(text: bytes) -> bool:
    return not any(ch.isalpha() for ch in text.decode("utf-8", "replace"))


def _predictor(shared, keep: list[str]):
    def f(part: pa.RecordBatch) -> list:
        field = shared.value
        data, offs = B.bytes_of(B.column(part, "text"))
        n = part.num_rows
        labels, score, known = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        if field is not None and len(data):
            low = B.LOWER[data]
            s, e, row = B.tokens(low, offs, W.LETTERS)
            plain = np.concatenate([[0], np.cumsum(W.LETTERS[data] & (data < 128))])
            ascii_ = plain[offs[1:]] - plain[offs[:-1]]  # ASCII letters of each text
            if len(s):
                blocks, words, kind = tagged(field, low, s, e, row)
                mass = np.zeros((n, len(field.labels)))
                for at, post in blocks:
                    whose, first = np.unique(row[at], return_index=True)  # the words come in order
                    mass[whose] += np.add.reduceat(post * (e - s)[at][:, None], first, axis=0)
                letters = np.bincount(row, e - s, minlength=n)
                met = np.bincount(row, (e - s) * np.isin(words, field.seen)[kind], minlength=n)
                known = _known(met, letters)
                total = mass.sum(axis=1)
                best = mass.argmax(axis=1)
                for i in np.flatnonzero(total > 0):
                    if not ascii_[i] and _no_letter(data[offs[i] : offs[i + 1]].tobytes()):
                        continue
                    labels[i] = field.labels[best[i]]
                    score[i] = min(1.0, mass[i, best[i]] / total[i])
        return [*(B.column(part, c) for c in keep), pa.array(labels, pa.string()), pa.array(score), pa.array(known)]

    return f


def train(docs: DataFrame, learn: Column, most: int = 600, most_bytes: int = 6 << 20, **options) -> Field | None:
    """A chain from about ``most`` rows of each label (``most_bytes`` of text in all) among those that ``learn`` picks."""
    rows = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sample = stratified(rows, "lang", "doc_id", most, seed=41)
    return None if sample is None else fitted(sample, lambda got: fit(got, **options), most_bytes)


def identify(docs: DataFrame, field: Field | None, whole: bool = False) -> DataFrame:
    """A row per document: doc_id, lang_pred, score, and ``known``, the share of the letters that stand in words of the
    training sample (a text of few letters counts as half known). With ``whole``, all columns under the names c0, c1, ..,
    and text, before these."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # MOST numbers, the labels and the sample's words
    if whole:
        rows = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    else:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keep = [f for f in rows.schema.fields if whole or f.name == "doc_id"]
    arrow = [to_arrow_type(f.dataType) for f in keep]
    names = [f.name for f in keep]
    run = B.mapper(_predictor(shared, names), [*names, "lang_pred", "score", "known"], [*arrow, pa.string(), pa.float64(), pa.float64()])
    found = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("known", DoubleType())]
    return rows.mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in keep), *found]))


def segments(field: Field, text: str) -> list[tuple[int, int, str]]:
    """The parts of a text by language: (start byte, end byte, label), neighbouring words of a label joined."""
    data, offs = B.bytes_of(pa.array([text], pa.large_string()))
    low = B.LOWER[data]
    s, e, row = B.tokens(low, offs, W.LETTERS)
    out: list[tuple[int, int, str]] = []
    label = np.zeros(len(s), np.int64)
    for at, post in tagged(field, low, s, e, row)[0] if len(s) else ():
        label[at] = post.argmax(axis=1)
    for a, z, j in zip(s, e, label, strict=True):
        if out and out[-1][2] == field.labels[j]:
            out[-1] = (out[-1][0], int(z), out[-1][2])
        else:
            out.append((int(a), int(z), field.labels[j]))
    return out
