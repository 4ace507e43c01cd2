"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of at most ``block_words`` words. Every source owns an exact quota of blocks: whole passes over
all of its blocks, then a further part of a pass, in a keyed random order. A binary tree over the output shards splits the
quotas: a node hands its left half a multivariate-hypergeometric draw of its blocks, source after source, so that every leaf
holds exact block counts whose sums over the leaves are the quotas. A shard then takes its own range of each source's
permuted blocks (the ranges are disjoint), and ``shards_of`` shuffles their texts locally. What a document gives is summed
over the shards' draws.

Sources are rows of a table, however many: their ranks, targets and quotas are DataFrame steps, and the tree is descended
for runs of ``CHUNK`` sources in tasks of their own, below a tree over the runs. The texts are read for sizes, and again
for the drawn blocks.

Defined results: null text has size 0 and gives no block; a null source is a source of its own that sorts last; rows that
repeat a doc_id are separate documents, one result row each; rows that are alike in id, text and source are interchangeable
copies, and which of them gives more is not defined, how much they give is; a very long text is many blocks; an empty table
gives an empty mix; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut
from lumenflow.llm import _bytes as B

WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose quotas a task splits, and rows of a table of sources up to which it is broadcast (under 10 MB).
CHUNK, FEW = 4096, 20_000
#: Parts of a shard that are shuffled in tasks of their own, a power of two.
RUNS = 16
#: Shard borders that are broadcast (8 bytes each), and how many of them one number stands for in a first look.
BORDERS, STRIDE = 1_000_000, 64


class Tree:
    """A splitting tree over shards whose leaves have room for a given number of blocks each."""

    def __init__(self, room: list[int]) -> None:
        self.n = len(room)
        self.room = {}

        def fill(a: int, b: int) -> int:
            m = (a + b) // 2
            self.room[a, b] = int(room[a]) if b - a == 1 else fill(a, m) + fill(m, b)
            return self.room[a, b]

        fill(0, self.n)

    def split(self, quota: int, rng: np.random.Generator) -> list[int]:
        """Deal a source's blocks over the shards. A node passes its left half a hypergeometric draw among the room that is
        left in its halves: one source after the other, this is the multivariate-hypergeometric draw of the node."""
        out = [0] * self.n

        def descend(a: int, b: int, k: int) -> None:
            if b - a == 1:
                out[a] = k
            elif k:
                m = (a + b) // 2
                left = draw_count(rng, self.room[a, m], self.room[m, b], k)
                descend(a, m, left)
                descend(m, b, k - left)
            self.room[a, b] -= k

        descend(0, self.n, int(quota))
        return out


def split_tree(quotas: Iterable[int], room: list[int], seed: int, first: int = 0) -> Iterator[list[int]]:
    """Blocks of each source in each shard; sums over the sources are ``room``. ``first``: number of the first source."""
    tree = Tree(room)
    for i, k in enumerate(quotas):
        yield tree.split(k, np.random.default_rng([seed, first + i]))


def even(total: int, shards: int) -> list[int]:
    return [total * (i + 1) // shards - total * i // shards for i in range(shards)]


def draw_count(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One hypergeometric count; beyond numpy's range (1e9), its normal limit, clipped to what is possible."""
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    p = good / total
    sd = (n * p * (1 - p) * (total - n) / max(1, total - 1)) ** 0.5
    return int(min(max(round(rng.normal(n * p, sd)), n - bad, 0), good, n))


def _key(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _sized(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, source, size, two hashes of id and text, and its number among equal rows (``copy``)."""
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *_identity(),
    )
    same = rows.groupBy("doc_id", "source", "size", "k1", "k2").agg(F.count("*").alias("n"))
    return same.select("doc_id", "source", "size", "k1", "k2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))


def _identity() -> list[Column]:
    id_ = F.col("doc_id").cast("long")
    return [F.xxhash64(id_, F.col("text")).alias("k1"), F.xxhash64(F.lit(1), F.col("text"), id_).alias("k2")]


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= FEW else table


def _ranked(table: DataFrame, column: str) -> DataFrame:
    """``sid``: a row's place by the column's bytes, null last, without a task that holds all rows."""
    ranged = cut(table.repartitionByRange(64, F.asc_nulls_last(column)).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per range
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    w = Window.partitionBy("_p").orderBy(F.asc_nulls_last(column))
    return ranged.withColumn("_r", F.row_number().over(w) - 1).join(F.broadcast(before), "_p").withColumn("sid", F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``target`` for rows (sid, source_size): words that each source should give, ``share`` of all by weights that repeat,
    none above ``cap`` times its size.

    What a source can't hold is dealt again over the others by weight, until none is above its limit: each round is one sum.
    """
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights)).cast("int"))
    rows = cut(sources.withColumn("w", w).withColumn("full", F.col("source_size") == 0))
    limit = cap * F.col("source_size")
    total = rows.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    while True:
        got = rows.agg(F.sum(F.when(F.col("full"), limit)).alias("held"), F.sum(F.when(~F.col("full"), F.col("w"))).alias("w")).first()
        left, rest = share * total - float(got["held"] or 0), float(got["w"] or 0)
        deal = F.lit(left) * F.col("w") / F.lit(rest or 1.0)
        over = ~F.col("full") & (deal > limit)
        if rows.where(over).isEmpty():
            return rows.withColumn("target", F.when(F.col("full"), limit.cast("double")).otherwise(deal)).drop("w", "full")
        rows = cut(rows.withColumn("full", F.col("full") | over))


def leaves(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sid, ends: where each shard's range of a source's blocks ends) for rows (sid, quota): a tree over runs of sources, then
    one within each run."""
    runs = cut(quotas.groupBy(F.floor(F.col("sid") / CHUNK).cast("long").alias("run")).agg(F.sum("quota").alias("quota")))
    total = int(runs.agg(F.sum("quota")).first()[0] or 0)

    def rows(keys: list, got: list, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(got, pa.list_(pa.int64()))], names=[name, "leaf"])

    def top(batches):
        tree = Tree(even(total, shards))
        for b in batches:
            runs_, quota = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield rows(runs_, [tree.split(k, np.random.default_rng([seed, 1, r])) for r, k in zip(runs_, quota, strict=True)], "run")

    # a row per CHUNK sources passes through one task
    tops = runs.repartition(1).sortWithinPartitions("run").mapInArrow(top, "run long, leaf array<long>")

    def within(batches):
        for b in B.runs(batches, ["run"]):
            sid, quota = B.column(b, "sid").to_pylist(), B.column(b, "quota").to_pylist()
            tree = Tree(B.column(b, "leaf")[0].as_py())
            got = (tree.split(k, np.random.default_rng([seed, 2, s])) for s, k in zip(sid, quota, strict=True))
            yield rows(sid, [np.cumsum(x) for x in got], "sid")

    both = quotas.withColumn("run", F.floor(F.col("sid") / CHUNK).cast("long")).join(cut(tops), "run")
    return both.repartition("run").sortWithinPartitions("run", "sid").mapInArrow(within, "sid long, leaf array<long>").withColumnRenamed("leaf", "ends")


def draw(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    shards: int | None = None,
    block_words: int = 256,
    bucket_blocks: int = 1024,
    shard_words: int = 1 << 25,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """Plan a mix.

    Returns (documents, draws). documents: doc_id, source, size, source_size, target, k1, k2, copy. draws: doc_id, source,
    k1, k2, copy, shard, place (order in the shard), block, pass, n_words - one row for each time a block is taken. k1, k2
    and copy tell rows apart. Unless told otherwise, there are as many shards as hold ``shard_words`` each, eight at least.
    """
    sized = cut(_sized(docs))
    blocks_of = F.ceil(F.col("size") / block_words)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(blocks_of).alias("blocks"))
    table = cut(targets(_ranked(per, "source"), weights, share, cap))
    sums = table.agg(F.count("*").alias("n"), F.sum("target").alias("t")).first()
    n_sources, shards = sums["n"], shards or max(8, int(-(-(sums["t"] or 0) // shard_words)))
    table = table.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    table = table.withColumn("part", F.col("target") - F.col("passes") * F.col("source_size"))
    table = table.withColumn("bins", F.greatest(F.lit(1), F.ceil(F.col("blocks") / bucket_blocks)).cast("long"))
    named = _small(table.withColumnRenamed("source", "s2"), n_sources)
    docs2 = sized.join(named, sized.source.eqNullSafe(F.col("s2"))).drop("s2")
    blocks = (
        docs2.where("size > 0")
        .select("*", F.explode(F.sequence(F.lit(0), (blocks_of - 1).cast("int"))).alias("block"))
        .withColumn("n_words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block").cast("long") * block_words))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass"))
        .withColumn("h", _key(seed, *[F.col(c) for c in ("k1", "k2", "source", "copy", "block", "pass")]))
        .withColumn("bin", F.pmod(_key(seed + 1, F.col("h")), F.col("bins")))
        .select("doc_id", "source", "k1", "k2", "copy", "sid", "passes", "part", "block", "n_words", "pass", "h", "bin")
    )
    # Order in a source's pass: bins in turn, keyed order within a bin. A bin holds a bounded number of blocks, so that a
    # source with a third of all rows is dealt over many tasks.
    tally = cut(blocks.groupBy("sid", "pass", "bin").agg(F.count("*").alias("nb"), F.sum("n_words").alias("wb")))
    n_bins = tally.count()
    before = Window.partitionBy("sid", "pass").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.select(
        "sid", "pass", "bin", F.coalesce(F.sum("nb").over(before), F.lit(0)).alias("rank0"), F.coalesce(F.sum("wb").over(before), F.lit(0)).alias("word0")
    )
    within = Window.partitionBy("sid", "pass", "bin").orderBy("h", "k1", "k2", "copy", "block")
    ranked = cut(
        blocks.withColumn("_r", F.row_number().over(within) - 1)
        .withColumn("_w", F.sum("n_words").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_words"))
        .join(_small(starts, n_bins), ["sid", "pass", "bin"])
        # the last pass goes as far as its share: the cut is at the block border nearest to it
        .where((F.col("pass") < F.col("passes")) | (F.col("word0") + F.col("_w") + F.col("n_words") / 2 <= F.col("part")))
        .select("doc_id", "source", "k1", "k2", "copy", "sid", "pass", "block", "n_words", "h", (F.col("rank0") + F.col("_r")).alias("rank"))
    )
    got = cut(ranked.groupBy("sid", "pass").agg(F.count("*").alias("n")))
    quotas = got.groupBy("sid").agg(F.sum("n").alias("quota"))
    leaf = leaves(quotas, shards, seed)
    # the shards' ranges of a source's blocks, and where each of its passes begins among them
    at = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.transform(F.sequence(F.lit(1), F.lit(-(-shards // STRIDE))), lambda i: F.get("ends", F.least(i * STRIDE, F.lit(shards)) - 1))
    ranges = cut(got.withColumn("at", at).join(leaf, "sid").select("sid", "pass", "at", "ends", every.alias("every")))
    passed = lambda borders: F.size(F.filter(borders, lambda e: e <= F.col("pos")))
    draws = (
        ranked.join(F.broadcast(ranges) if n_sources * shards <= BORDERS else ranges, ["sid", "pass"])
        .withColumn("pos", F.col("rank") + F.col("at"))
        .withColumn("jump", passed("every") * STRIDE)
        .withColumn("shard", F.col("jump") + passed(F.slice("ends", F.col("jump") + 1, F.lit(STRIDE))))
        .select("doc_id", "source", "k1", "k2", "copy", "shard", _key(seed + 2, F.col("h"), F.col("pass")).alias("place"), "block", "pass", "n_words")
    )
    return docs2.select("doc_id", "source", "size", "source_size", "target", "k1", "k2", "copy"), draws


def block_texts(docs: DataFrame, block_words: int = 256) -> DataFrame:
    """(k1, k2, block, text): each block's text, from its first word to its last."""

    def f(part: pa.RecordBatch) -> list | None:
        data, offs = B.bytes_of(B.column(part, "text"))
        s, e, row = B.tokens(data, offs, B.NOT_SPACE)
        if not len(s):
            return None
        n = np.bincount(row, minlength=part.num_rows)
        place = np.arange(len(s)) - (np.cumsum(n) - n)[row]
        first = np.flatnonzero(place % block_words == 0)
        last = np.append(first[1:], len(s)) - 1
        size = e[last] - s[first]
        at = np.repeat(s[first] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        texts = B.binaries(data[at], np.concatenate([[0], np.cumsum(size)])).cast(pa.string())
        keys = (B.column(part, c).take(pa.array(row[first])) for c in ("k1", "k2"))
        return [*keys, place[first] // block_words, texts]

    run = B.mapper(f, ["k1", "k2", "block", "text"], [pa.int64(), pa.int64(), pa.int32(), pa.string()])
    return docs.select(*_identity(), "text").mapInArrow(run, "k1 long, k2 long, block int, text string")


def shards_of(docs: DataFrame, block_words: int = 256, **options) -> DataFrame:
    """The mix itself: a row for each drawn block, shard, place, doc_id, source, block, pass, n_words, text. A shard's rows are in the
    order of ``place``, a keyed one, in ``RUNS`` runs of consecutive places: a task sorts a run, not a shard, and a run's rows are
    together. Words that a document gives are summed over its rows."""
    _, draws = draw(docs, block_words=block_words, **options)
    # rows that are alike have equal blocks: one of them is enough
    texts = block_texts(docs, block_words).dropDuplicates(["k1", "k2", "block"])
    rows = draws.join(texts, ["k1", "k2", "block"]).select("shard", "place", "doc_id", "source", "block", "pass", "n_words", "text")
    # places are spread evenly over 64 bits: their upper bits name a run
    run = F.shiftright("place", 64 - RUNS.bit_length() + 1)
    return rows.repartition(F.col("shard"), run).sortWithinPartitions("shard", "place", "doc_id", "block", "pass")


def mix(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken (words of the mix, repeats counted) and
    n_shards (shards that hold a part of it), summed over the shards' draws."""
    rows, draws = draw(docs, **options)
    same = ["k1", "k2", "copy"]
    # a source tells rows apart that have the same id and text
    by_shard = draws.groupBy(*same, F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "shard").agg(F.sum("n_words").alias("n"))
    taken = by_shard.groupBy(*same, "s", "none").agg(F.sum("n").alias("taken"), F.count("*").alias("n_shards"))
    keyed = rows.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())
    return keyed.join(taken, [*same, "s", "none"], "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"),
    )
