"""Hashed affix, n-gram and whole-word features of words, for many words at once."""

from __future__ import annotations

import numpy as np

from lumenflow.llm import _bytes as B

LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def of_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, affixes: tuple[int, ...], grams: tuple[int, ...]):
    """(indices, offsets): hashed features of each word - the word, its prefixes and suffixes, the n-grams inside it.

    Affixes and n-grams count bytes; a word that is shorter than one has none of that length.
    """
    h = B.prefix_hash(low)
    n = ends - starts
    parts, owners = [B.span_hashes(low, starts, ends, h)], [np.arange(len(starts))]
    inv = B.powers(len(low) + 1, inverse=True)

    def spans(a: np.ndarray, k: int, tag: int) -> np.ndarray:
        return B.mix((h[a + k] - h[a]) * inv[a] + np.uint64(tag * 0x51ED27))

    for k in affixes:
        has = np.flatnonzero(n > k)
        parts += [spans(starts[has], k, 100 + k), spans(ends[has] - k, k, 200 + k)]
        owners += [has, has]
    for k in grams:
        count = np.maximum(n - k + 1, 0)
        who = np.repeat(np.arange(len(starts)), count)
        at = np.repeat(starts, count) + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        parts.append(spans(at, k, 300 + k))
        owners.append(who)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    index = (np.concatenate(parts)[order] >> np.uint64(64 - bits)).astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(starts)))])
    return index, offs


def summed(weights: np.ndarray, index: np.ndarray, offs: np.ndarray, block: int = 64) -> np.ndarray:
    """Mean weight over each word's features, a block of columns at a time."""
    out = np.zeros((len(offs) - 1, weights.shape[1]), weights.dtype)
    if len(out):
        for lo in range(0, weights.shape[1], block):
            part = weights[index] if weights.shape[1] <= block else weights[:, lo : lo + block][index]
            out[:, lo : lo + block] = np.add.reduceat(part, offs[:-1], axis=0)  # every word has a feature: the word itself
    return out / np.diff(offs)[:, None]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, first places, place of each in the distinct ones)."""
    return np.unique(hashes, return_index=True, return_inverse=True)
