"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: the first scatters a set's hashed shingles over a circle of
``CIRCLE`` places, the second, read from that place on, gives coordinate k as the minimum of the values k places further.
Bands of the signature bring candidates together; a link counts only if the full sets of 64-bit shingle hashes meet the
threshold.

No group is expanded into all pairs, yet no link between candidates is lost:
1. rows with equal sets fall into classes, known by a 128-bit digest; only a class's smallest id goes on;
2. in each bucket of a band, every member is compared with the bucket's smallest id; the links give components;
3. where a bucket still holds several components, the members outside its largest one meet the others, in chunks of bounded
   size. A pair whose signatures agree far less than linked sets would (``estimate``, over four deviations below the
   threshold) ends there; otherwise the member is compared with the full sets of the other component, in blocks of bounded
   size that are held once in a task. What remains apart then has no link left to find.

Defined results: null or empty text, and text without words, has an empty set that is linked with nothing; a row with a
null id is linked with nothing; rows that repeat an id are one node, so that what any of them is linked with belongs to one
component, while n_shingles is each row's own; very long texts are taken whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut
from lumenflow.llm import _bytes as B
from lumenflow.operators.graph import components

CIRCLE = 1 << 20
#: Shingle hashes in a block of a component, and in the rows compared with it at once.
BLOCK_HASHES = 1 << 17
#: Members of a bucket that meet so many others in one task; components of at most so many are compared pair by pair.
CHUNK, FEW = 1024, 8


def shingle_sets(part: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``size`` words of each row; a shorter text is one shingle."""
    data, offs = B.bytes_of(B.column(part, "text"))
    low = B.LOWER[data]
    s, e, row = B.tokens(low, offs, B.NOT_SPACE)
    w = B.span_hashes(low, s, e)
    n = np.bincount(row, minlength=part.num_rows)
    h = w.copy()
    for k in range(1, size):  # h[i]: hash of the words i to i + k
        h[: len(w) - k] = B.mix(h[: len(w) - k] * B._BASE + B.mix(w[k:]))
    at = np.cumsum(n) - n
    out = []
    for a, k in zip(at.tolist(), n.tolist(), strict=True):
        if k >= size:
            x = np.sort(h[a : a + k - size + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif k:
            x = w[a : a + 1]
            for j in range(1, k):
                x = B.mix(x * B._BASE + B.mix(w[a + j : a + j + 1]))
            out.append(B.mix(x + np.uint64(k)))
        else:
            out.append(w[:0])
    return out


class Circulant:
    """Signatures from two permutations."""

    def __init__(self, coordinates: int, seed: int) -> None:
        self.k = coordinates
        second = np.random.default_rng(seed).permutation(CIRCLE).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:coordinates]]), coordinates)
        self.key = np.uint64(B.mix(np.array([seed], np.uint64))[0])

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        # the first permutation: a keyed bijection of 64-bit numbers, of which the upper bits name a place
        place = B.mix(hashes ^ self.key) >> np.uint64(64 - 20)
        out = None
        for i in range(0, len(place), 4096):
            low = self.windows[place[i : i + 4096].astype(np.int64)].min(axis=0)
            out = low if out is None else np.minimum(out, low)
        return out


_circulants: dict[tuple[int, int], Circulant] = {}


def circulant(coordinates: int, seed: int) -> Circulant:
    if (coordinates, seed) not in _circulants:
        _circulants[coordinates, seed] = Circulant(coordinates, seed)
    return _circulants[coordinates, seed]


def _sketch(size: int, bands: int, rows: int, seed: int):
    def f(part: pa.RecordBatch) -> list:
        signer = circulant(bands * rows, seed)
        sets = shingle_sets(part, size)
        n = np.array([len(x) for x in sets], np.int64)
        digest = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
        has = np.flatnonzero(n)
        keys = np.zeros((len(has), bands), np.uint64)
        short: list[bytes | None] = [None] * len(n)  # the low byte of each coordinate
        for i, j in enumerate(has):
            v = signer.sign(sets[j])
            short[j] = v.astype(np.uint8).tobytes()
            v = v.reshape(bands, rows).astype(np.uint64)
            keys[i] = np.arange(1, bands + 1, dtype=np.uint64)
            for r in range(rows):
                keys[i] = B.mix(keys[i] * B._BASE + v[:, r])
        counts = np.where(n > 0, bands, 0)
        return [
            B.column(part, "doc_id").cast(pa.int64()), n, pa.array(digest, pa.binary()),
            B.packed(keys.view(np.int64).ravel(), counts, pa.int64()), pa.array(short, pa.binary()),
        ]

    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
    names = ["doc_id", "n_shingles", "digest", "buckets", "signature"]
    return B.mapper(f, names, types), "doc_id long, n_shingles long, digest binary, buckets array<long>, signature binary"


class Filter:
    """A bitmap of hashed ids, of bounded size: it may pass other ids, never drops one of its own."""

    MOST = 1 << 28

    def __init__(self, ids: DataFrame, column: str) -> None:
        n = ids.count()
        self.bits = 1 << 15
        while self.bits < min(16 * n, self.MOST):
            self.bits *= 2
        spot = F.pmod(F.xxhash64(column), F.lit(self.bits))
        rows = (
            ids.select((spot + 1).alias("s"))  # these functions count from 1
            .groupBy(F.bitmap_bucket_number("s").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
            .collect()
        )  # bits / 2**15 rows of 4 KB, 32 MB at most
        self.map = np.zeros(self.bits // 8 + 4096, np.uint8)
        for r in rows:
            at = (r["b"] - 1) * 4096
            self.map[at : at + len(r["m"])] = np.frombuffer(bytes(r["m"]), np.uint8)

    def share(self, spark: SparkSession):
        return spark.sparkContext.broadcast(self.map)

    def spot(self, column: str = "doc_id"):
        return F.pmod(F.xxhash64(column), F.lit(self.bits))


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, hashes) of the rows of ``docs`` whose id is in ``ids``; texts that aren't needed are dropped by a bitmap of
    bounded size before their sets are made."""
    wanted = Filter(ids, "id")
    shared = wanted.share(docs.sparkSession)

    def f(part: pa.RecordBatch) -> list | None:
        spot = B.column(part, "spot").to_numpy(zero_copy_only=False)
        keep = (shared.value[spot >> 3] >> (spot & 7)) & 1
        if not keep.any():
            return None
        part = part.filter(pa.array(keep.astype(bool)))
        sets = shingle_sets(part, size)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        return [B.column(part, "doc_id"), B.packed(flat.view(np.int64), np.array([len(x) for x in sets]), pa.int64())]

    run = B.mapper(f, ["id", "hashes"], [pa.int64(), pa.list_(pa.int64())])
    got = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("spot", wanted.spot())
    return got.mapInArrow(run, "id long, hashes array<long>")


def _meets(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _compare(percent: int):
    """Rows ``x`` against a block of members: a link for each row that has one."""

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        ids = right.column("id_").to_numpy()
        lists = right.column("hashes_").combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(ids)), n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        got = []
        own = left.column("hashes").combine_chunks()
        for i, x in enumerate(left.column("id").to_pylist()):
            mine = own[i].values.to_numpy(zero_copy_only=False)
            a, b = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
            k = b - a
            at = np.repeat(a - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            common = np.bincount(owner[at], minlength=len(ids))
            hit = np.flatnonzero(_meets(common, len(mine), n, percent) & (common > 0))
            if len(hit):
                got.append((x, int(ids[hit].min())))
        return pa.table({"a": pa.array([g[0] for g in got], pa.int64()), "b": pa.array([g[1] for g in got], pa.int64())})

    return f


def _approach(estimate: float):
    """Members outside a bucket's largest component against a chunk of the bucket, by signatures."""
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("block", pa.int64()), ("y", pa.int64())])

    def run(batches):
        for t in B.runs(batches, ["bucket", "turn", "chunk"]):
            get = lambda c: B.column(t, c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            asks, ids, comp, size, block, few = get("asks"), get("id"), get("component"), get("hashes"), get("block"), get("few")
            sig = np.frombuffer(b"".join(B.column(t, "signature").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            held = np.flatnonzero(~asks)
            out = set()
            for i in np.flatnonzero(asks):
                # a member of the smaller component meets the larger one
                h = held[(comp[held] != comp[i]) & ((size[i] < size[held]) | ((size[i] == size[held]) & (comp[i] < comp[held])))]
                h = h[(sig[h] == sig[i]).mean(axis=1) >= estimate] if len(h) else h
                out.update(
                    (int(ids[i]), int(comp[j]), int(block[j]), int(ids[j])) if few[j] else (int(ids[i]), int(comp[j]), int(block[j]), None)
                    for j in h
                )
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run, "id long, other long, block long, y long"


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, seed: int = 29, estimate: float = 0.65
) -> DataFrame:
    """A row per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id, kept.

    A pair at the threshold of 0.8 shares one of 32 bands of 4 coordinates with probability 1 - 5e-8, and its signatures
    agree on fewer than 0.65 of the 128 coordinates with probability 1e-5.
    """
    run, schema = _sketch(shingle, bands, rows, seed)
    sketched = cut(docs.select("doc_id", "text").mapInArrow(run, schema))
    full = sketched.where("digest is not null and doc_id is not null")
    classes = cut(full.groupBy("digest").agg(F.min("doc_id").alias("class_id")))
    of_class = cut(full.select("doc_id", "n_shingles", "digest").join(classes, "digest").select("doc_id", "n_shingles", "class_id"))

    # a class's own rows carry the same buckets: the one with its smallest id goes on
    inside = full.join(classes, "digest").where("doc_id = class_id")
    spread = inside.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket"))
    crowded = cut(spread.groupBy("bucket").agg(F.count("*").alias("k"), F.min(F.struct("id", "n")).alias("low")).where("k > 1").drop("k"))
    members = cut(spread.join(crowded, "bucket").select("bucket", "id", "n", "low"))

    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    stars = cut(
        members.where((F.col("id") != F.col("low.id")) & fits(F.col("n"), F.col("low.n")))
        .select(F.col("low.id").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    sets = cut(_sets(docs, members.select("id").distinct(), shingle))
    first = _verified(stars, sets, percent)
    one = components(first).select("id", "component")

    # buckets that hold several components still
    named = cut(members.select("bucket", "id", "n").join(one, "id", "left").withColumn("component", F.coalesce("component", "id")))
    open_ = cut(named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket"))
    people = cut(named.select("id", "n", "component").distinct())
    size = cut(people.groupBy("component").agg(F.sum("n").alias("hashes"), (F.count("*") <= FEW).alias("few")))
    of = cut(
        people.join(size, "component")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("hashes") / BLOCK_HASHES)).cast("long"))
        .join(sketched.select(F.col("doc_id").alias("id"), "signature"), "id")
    )
    rest = cut(named.join(open_, "bucket").select("bucket", "id").join(of, "id"))
    biggest = cut(rest.groupBy("bucket").agg(F.max(F.struct("hashes", "component")).alias("top"), F.count("*").alias("k")))
    here = cut(rest.join(biggest, "bucket").withColumn("asks", F.col("component") != F.col("top.component")))
    asks = cut(here.groupBy("bucket").agg(F.sum(F.col("asks").cast("int")).alias("k_asks")))
    here = here.join(asks, "bucket")
    # members that ask come in turns, those that are held in chunks
    chunks, turns = F.ceil(F.col("k") / CHUNK), F.ceil(F.col("k_asks") / CHUNK)
    within = lambda n: F.pmod(F.xxhash64("bucket", "id"), n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    carried = ["id", "component", "hashes", "block", "few", "signature"]
    asking = here.where("asks").select("bucket", within(turns).alias("turn"), F.explode(every(chunks)).alias("chunk"), F.lit(True).alias("asks"), *carried)
    held = here.select("bucket", F.explode(every(turns)).alias("turn"), within(chunks).alias("chunk"), F.lit(False).alias("asks"), *carried)
    run, schema = _approach(estimate)
    met = cut(
        asking.unionByName(held).repartition("bucket", "turn", "chunk").sortWithinPartitions("bucket", "turn", "chunk")
        .mapInArrow(run, schema).distinct()
    )
    plain = _verified(cut(met.where("y is not null").select(F.col("id").alias("a"), F.col("y").alias("b"))), sets, percent)
    meet = cut(met.where("y is null").join(people.select("id", "n"), "id").select("id", "n", F.col("other").alias("component"), "block"))
    links = first.unionByName(plain).unionByName(_met(meet, of, sets, percent)).unionByName(_shared(of_class))
    final = components(cut(links)).select("id", "component")
    known = (
        of_class.join(final.withColumnRenamed("id", "class_id"), "class_id", "left")
        .select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    )
    alone = sketched.where("digest is null or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")
    )
    return known.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _shared(of_class: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that repeat an id: they are one node."""
    both = of_class.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("hi")).where("a < hi").select("doc_id", "a")
    return of_class.join(both, "doc_id").select("a", F.col("class_id").alias("b")).where("a < b").distinct()


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that a smaller one is linked with, in a row's own terms: documents come by id, null last,
    then by the hash of their texts, and of rows that repeat id and text one stays. All columns stay, whatever their names."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    own = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    # the row travels as one struct, so that no name of its columns can clash
    rows = docs.select(F.struct("*").alias("row_"), F.col("doc_id").cast("long").alias("doc_"), F.xxhash64("text").alias("hash_"))
    back = [F.col("row_").getField(c).alias(c) for c in docs.columns]
    if own.isEmpty():
        gone = near_duplicates(ids, **options).where("not kept").select(F.col("doc_id").alias("id_"))
        return rows.join(gone, F.col("doc_") == F.col("id_"), "left_anti").select(*back)
    # distinct documents get numbers in their order, which take the place of ids
    some = cut(ids.select("doc_id", "h").distinct().repartitionByRange(64, F.asc_nulls_last("doc_id"), "h").withColumn("_p", F.spark_partition_id()))
    sizes = some.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per range
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.asc_nulls_last("doc_id"), "h"))
    numbers = cut(some.withColumn("_r", place).join(F.broadcast(before), "_p").select(F.col("doc_id").alias("id_"), F.col("h").alias("h_"), (F.col("_r") + F.col("_b")).alias("n_")))
    same = lambda i, h: F.col(i).eqNullSafe(F.col("id_")) & (F.col(h) == F.col("h_"))
    texts = ids.join(numbers, same("doc_id", "h")).select(F.col("n_").alias("doc_id"), "text")
    kept = near_duplicates(texts, **options).where("kept").select(F.col("doc_id").alias("n_")).distinct()
    return rows.join(numbers.join(kept, "n_"), same("doc_", "hash_")).dropDuplicates(["n_"]).select(*back)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold, as a stored table."""
    left, right = (sets.select(F.col("id").alias(k), F.col("hashes").alias(f"set_{k}")) for k in "ab")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return cut(
        pairs.join(left, "a").join(right, "b").where(_meets(common, F.size("set_a"), F.size("set_b"), percent)).select("a", "b")
    )


def _met(meet: DataFrame, of: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between rows and the blocks of components that they met: a block is held in a task, against so many rows."""
    load = cut(meet.groupBy("component", "block").agg(F.ceil(F.sum("n") / BLOCK_HASHES).alias("turns")))
    asked = meet.join(load, ["component", "block"]).withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns"))).select("id", "component", "block", "turn")
    held = of.select("id", "component", "block").join(
        load.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("turns"), ["component", "block"]
    )
    keys = ["component", "block", "turn"]
    left = asked.join(sets, "id").select(*keys, "id", "hashes")
    # both sides descend from the same tables: new names keep their columns apart
    right = held.join(sets, "id").select(*[F.col(c).alias(f"{c}_") for c in keys], F.col("id").alias("id_"), F.col("hashes").alias("hashes_"))
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"{c}_" for c in keys])).applyInArrow(_compare(percent), "a long, b long")
