"""Keyed pseudo-random numbers as column expressions: equal keys give equal draws, on any engine with MD5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *key: Column) -> Column:
    """A number in [0, 1) of a seed and a key: the first 52 bits of the MD5 of their texts, joined by bars."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def below(n: int | Column, seed: int | str, *key: Column) -> Column:
    """An integer from 0 to n - 1."""
    return F.floor(uniform(seed, *key) * n).cast("long")


def normal(seed: int | str, *key: Column) -> Column:
    """A standard normal number, by Box and Muller's transform of two draws."""
    u, v = uniform(f"{seed}a", *key), uniform(f"{seed}b", *key)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
