"""Quality classification from overlapping heuristic labellers, without labelled rows.

Labellers look at a whole text and vote good, bad or not at all. Expectation-maximisation over the counts of all vote
patterns of the corpus estimates how often each labeller votes what on good and on bad texts, and with it every pattern's
posterior. A linear scorer over hashed byte trigrams is trained on these posteriors, so that texts on which the labellers
abstain or disagree are scored by what they have in common with the others.

Vote counts cover all rows; their number is bounded by 3 to the power of the number of labellers. The scorer learns, in a
task, from at most about ``most`` texts of each posterior class, the ones with the lowest keyed hashes, and ``most_bytes``.

Defined results: null and empty text get the labellers' votes on an empty text, and aren't kept; an empty table gives no
rows; rows that repeat an id are separate, equal texts score alike; very long texts are read whole; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import _bytes as B
from lumenflow.llm._sampling import fitted, unit

BITS = 16
#: Votes that the priors of a labeller's accuracies are worth, on bad texts and on good ones.
PRIOR = (20.0, 100.0)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123] = True, True
_SYMBOLS, _MARKS, _DIGITS, _LINE = _class("#$%&*<>{}[]~^=_@\\"), _class(".?!;:"), _class("0123456789"), _class("\n")


def measures(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and shares of each row."""
    rows = len(offs) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[offs[1:]] - c[offs[:-1]]).astype(float)

    low = B.LOWER[data]
    s, e, row = B.tokens(low, offs, B.NOT_SPACE)
    words = np.bincount(row, minlength=rows).astype(float)
    per_word = np.maximum(words, 1)
    h = B.prefix_hash(low)

    hashes = B.span_hashes(low, s, e, h)
    again = np.zeros(len(s), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])

    def distinct(x, r):
        order = np.lexsort((x, r))
        x, r = x[order], r[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (r[1:] != r[:-1])]) if len(x) else np.zeros(0, bool)
        return np.bincount(r[new], minlength=rows).astype(float)

    la, lz, lrow = B.tokens(low, offs, ~_LINE)
    lines = np.bincount(lrow, minlength=rows).astype(float)
    upper, lower = count(_UPPER[data]), count(_LOWER[data])
    n = np.maximum(np.diff(offs), 1)
    return {
        "words": words,
        "upper": upper / np.maximum(upper + lower, 1),
        "symbols": count(_SYMBOLS[data]) / n,
        "bars": count(data == ord("|")) / per_word,
        "shouts": count(data == ord("!")) / per_word,
        "marks": count(_MARKS[data]) / per_word,
        "digits": count(_DIGITS[data]) / n,
        "length": np.bincount(row, e - s, minlength=rows) / per_word,
        "variety": distinct(hashes, row) / per_word,
        "stutter": np.bincount(row, again, minlength=rows) / per_word,
        "odd_words": np.bincount(row, _SYMBOLS[data[e - 1]] | _SYMBOLS[data[s]], minlength=rows) / per_word if len(s) else words,
        "short_words": np.bincount(row, (e - s) == 1, minlength=rows) / per_word,
        "repeated": 1 - distinct(B.span_hashes(low, la, lz, h), lrow) / np.maximum(lines, 1),
    }


def _bad(name: str, above: float = np.inf, below: float = -np.inf, least: int = 0):
    def vote(m: dict[str, np.ndarray]) -> np.ndarray:
        return np.where(((m[name] > above) | (m[name] < below)) & (m["words"] >= least), 1, 0)

    return vote


def _size(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.where(m["words"] >= 1, 2, 1)


def _prose(m: dict[str, np.ndarray]) -> np.ndarray:
    fine = (m["marks"] >= 0.02) & (m["marks"] <= 1) & (m["upper"] < 0.2) & (m["symbols"] < 0.01)
    return np.where(fine & (m["variety"] >= 0.2), 2, 0)


#: Votes: 0 none, 1 bad, 2 good. Each way of being bad is seen by more than one labeller.
LABELLERS: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]] = {
    "size": _size,
    "prose": _prose,
    "case": _bad("upper", above=0.5, least=5),
    "shouts": _bad("shouts", above=0.3, least=5),
    "symbols": _bad("symbols", above=0.05, least=3),
    "odd_words": _bad("odd_words", above=0.3, least=5),
    "bars": _bad("bars", above=0.15, least=5),
    "short_words": _bad("short_words", above=0.35, least=10),
    "variety": _bad("variety", below=0.08, least=60),
    "stutter": _bad("stutter", above=0.2, least=10),
    "repeated": _bad("repeated", above=0.5, least=10),
    "marks": _bad("marks", above=0.9, below=0.003, least=30),
    "digits": _bad("digits", above=0.25, least=3),
    "length": _bad("length", above=16.0, below=1.8, least=3),
}


def votes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[rows, labellers] votes."""
    m = measures(data, offs)
    return np.stack([f(m) for f in LABELLERS.values()], axis=1).astype(np.uint8)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: (posterior of good for each, P(vote | class) [2, labellers, 3], share of good).

    Starts from the votes; each labeller is taken for independent of the others given the class. ``PRIOR`` votes, however
    large the corpus, presume that a labeller calls few good texts bad and some bad ones; the rest is what the votes show.
    """
    bad = (patterns == 1).sum(axis=1)
    post = np.where(bad > 0, 0.1, 0.95)
    prior = {0: (PRIOR[0], 0.3), 1: (PRIOR[1], 0.002)}
    table, share = np.zeros((2, patterns.shape[1], 3)), 0.5
    for _ in range(rounds):
        for c, w in ((1, post * counts), (0, (1 - post) * counts)):
            n, q = prior[c]
            seen = np.stack([((patterns == v) * w[:, None]).sum(axis=0) for v in (0, 1, 2)], axis=1)
            table[c, :, 1] = (seen[:, 1] + n * q) / (seen.sum(axis=1) + n)
            # what isn't a bad vote is split between none and good as it is seen
            rest = (seen[:, 2] + 0.5) / (seen[:, 0] + seen[:, 2] + 1.0)
            table[c, :, 2], table[c, :, 0] = (1 - table[c, :, 1]) * rest, (1 - table[c, :, 1]) * (1 - rest)
        share = float((post * counts).sum() + 9) / float(counts.sum() + 10)
        logs = np.log(table)
        like = [logs[c][np.arange(patterns.shape[1])[None, :], patterns].sum(axis=1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(like[0] + np.log1p(-share) - like[1] - np.log(share), -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return post, table, share


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed byte trigrams, row of each); they don't cross rows."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = data.astype(np.uint32)
    x = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
    x = ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    same = row[2:] == row[:-2]
    return x[same], row[:-2][same]


def _features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed feature, row, value): the share of each trigram in its row, and of words that repeat the one before."""
    x, row = _grams(data, offs)
    n = np.maximum(np.bincount(row, minlength=len(offs) - 1), 1)
    low = B.LOWER[data]
    s, e, of = B.tokens(low, offs, B.NOT_SPACE)
    h = B.span_hashes(low, s, e)
    again = np.flatnonzero((h[1:] == h[:-1]) & (of[1:] == of[:-1])) + 1
    words = np.maximum(np.bincount(of, minlength=len(offs) - 1), 1)
    spot = int(B.mix(np.array([1], np.uint64))[0] >> np.uint64(64 - BITS))
    return (
        np.concatenate([x, np.full(len(again), spot)]), np.concatenate([row, of[again]]),
        np.concatenate([1.0 / n[row], 1.0 / words[of[again]]]),
    )


@dataclass
class Scorer:
    patterns: dict[bytes, float]  # posterior of good by vote pattern
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x, row, share = _features(data, offs)
        z = np.bincount(row, self.weights[x] * share, minlength=len(offs) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], soft: np.ndarray, rounds: int = 60, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on mean trigram indicators, by AdaGrad over all rows; classes weigh alike."""
    w, b = np.zeros(1 << BITS), 0.0
    if not len(texts):
        return w.astype(np.float32), b
    data, offs = B.bytes_of(pa.array(texts, pa.large_string()))
    x, row, share = _features(data, offs)
    each = np.where(soft >= 0.5, 1 / max(1.0, soft.sum()), 1 / max(1.0, (1 - soft).sum()))
    each = each / each.sum()
    g2, gb2 = np.full(1 << BITS, 1e-10), 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[x] * share, minlength=len(texts)) + b, -30, 30)))
        d = (soft - p) * each
        g = np.bincount(x, d[row] * share, minlength=1 << BITS)
        g2 += g * g
        w += rate * g / np.sqrt(g2)
        gb2 += d.sum() ** 2
        b += 0.1 * rate * d.sum() / np.sqrt(gb2)
    return w.astype(np.float32), b


def train(docs: DataFrame, most: int = 700, most_bytes: int = 6 << 20, seed: int = 47) -> Scorer:
    """Count the votes on all rows, estimate the labellers, and fit the scorer."""

    def count(batches):
        for batch in batches:
            for part in B.slices(batch):
                v, n = np.unique(votes(*B.bytes_of(B.column(part, "text"))), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in v], pa.binary()), pa.array(n)], names=["pattern", "n"])

    rows = docs.select("text").mapInArrow(count, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return Scorer({}, np.zeros(1 << BITS, np.float32), 0.0)
    rows = sorted(((bytes(r["pattern"]), r["n"]) for r in rows))
    patterns = np.array([np.frombuffer(p, np.uint8) for p, _ in rows])
    counts = np.array([n for _, n in rows], float)
    post, _, _ = estimate(patterns, counts)
    known = {p: float(v) for (p, _), v in zip(rows, post, strict=True)}
    share = [min(1.0, most / max(1.0, counts[mine].sum())) for mine in (post < 0.5, post >= 0.5)]

    def pick(batches):
        for batch in batches:
            for part in B.slices(batch):
                v = votes(*B.bytes_of(B.column(part, "text")))
                p = np.array([known[r.tobytes()] for r in v])
                u = B.column(part, "u").to_numpy(zero_copy_only=False)
                at = np.flatnonzero(u < np.where(p >= 0.5, share[1], share[0]))
                if len(at):
                    text = B.column(part, "text").take(pa.array(at)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(p[at] >= 0.5), text, pa.array(u[at]), pa.array(p[at])], names=["value", "text", "u", "p"])

    # texts above the larger share aren't looked at
    some = docs.select(F.coalesce("text", F.lit("")).alias("text"), unit("doc_id", "text", seed=seed).alias("u")).where(F.col("u") < max(share))
    chosen = some.mapInArrow(pick, "value boolean, text string, u double, p double").dropDuplicates(["value", "u"])
    w, b = fitted(chosen, lambda got: fit([t for _, t, _ in got], np.array([p for _, _, p in got])), most_bytes)
    return Scorer(known, w, b)


def classify(docs: DataFrame, scorer: Scorer, least: float = 0.4) -> DataFrame:
    """A row per document: doc_id, posterior (of the labellers), score (of the linear scorer), kept (score >= least; a
    text without words isn't kept)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # 2**BITS numbers and the vote patterns

    def f(part: pa.RecordBatch) -> list:
        data, offs = B.bytes_of(B.column(part, "text"))
        v = votes(data, offs)
        post = np.array([shared.value.patterns.get(r.tobytes(), 0.5) for r in v])
        score = shared.value.score(data, offs)
        some = np.bincount(B.tokens(data, offs, B.NOT_SPACE)[2], minlength=part.num_rows) > 0
        return [B.column(part, "doc_id"), post, score, pa.array((score >= least) & some)]

    run = B.mapper(f, ["doc_id", "posterior", "score", "kept"], [pa.int64(), pa.float64(), pa.float64(), pa.bool_()])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, posterior double, score double, kept boolean"
    )
