"""Exact top-k by inner product over a pivot-distance index.

Inner products become distances: with M the largest norm, a row x gains the coordinate sqrt(M^2 - |x|^2) and a query q a
zero, so that |q' - x'|^2 = M^2 + |q|^2 - 2 q.x. Rows are keyed by their nearest pivot and the distance to it. A pivot's rows
lie on shelves: ranges of that distance, of bounded size. By the triangle inequality |d(q, pivot) - d(x, pivot)| <= d(q, x).

1. Every query is itself a row, and meets the rows of its own shelf. Annuli on the shelf are opened from the query's own
   distance outwards, until the bound rules the next ones out. The k-th score so far is the query's bound.
2. Only shelves of any pivot whose range of distances can hold a score as high as that bound are asked, with the same
   expansion of annuli on them; a query goes to no other shelf, and a shelf to no block of queries that doesn't ask it.

Pivots are a bounded sample; every row is indexed and results are exact. The table of shelves has at most ``BINS`` rows for
each pivot. Vectors travel as 16-bit numbers if all components fit, else as doubles.

Defined results: a vector that is null or holds a null or non-finite component, or has no id, takes no part; shorter
vectors count as filled up with zeros; components become floor(scale * x), and scores are exact while all products and sums
stay below 2**53, beyond that rounded like doubles; rows that repeat an id are separate candidates, none of them for a query
of that id, and if they are queries, the best of all their pairs rank together; equal scores rank by id; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut

#: Rows of a shelf, of an annulus on it, of a block of queries that meets a shelf, and ranges of distance of a pivot.
SHELF, ANNULUS, QUERIES, BINS = 2048, 128, 16384, 1024


def _matrix(col: pa.ChunkedArray | pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), width).astype(np.float64) if len(col) else np.zeros((0, width))


def _usable(vectors: DataFrame, scale: float) -> DataFrame:
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("_x"))
        .where(F.col("vec_id").isNotNull() & F.col("_x").isNotNull() & fine)
        .select("vec_id", F.transform("_x", lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("x"))
    )


class Space:
    """The pivots in the lifted space, and how vectors are packed."""

    def __init__(self, pivots: np.ndarray, width: int, top: float, kind: str) -> None:
        self.width, self.top, self.kind = width, top, kind
        self.pivots = self.lift(pivots)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x**2).sum(1), 0))])

    def reach(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to all pivots, [queries, pivots]."""
        q = np.column_stack([q, np.zeros(len(q))])
        d2 = (q**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * q @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))

    def most(self) -> float:
        """No row is further from a pivot than that."""
        return 2 * float(np.sqrt(max(self.top, 0.0))) + 1.0

    def bound(self, norm: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The highest score at a distance of at least ``gap``, with room for rounding."""
        return (self.top + norm - gap**2) / 2 + 1e-6 * (self.top + norm) + 1e-3


def _keyed(space: Space):
    """Each row's nearest pivot, the distance to it in the lifted space and its range; the vector, packed."""
    schema = pa.schema([("vec_id", pa.int64()), ("pivot", pa.int32()), ("bin", pa.int32()), ("dist", pa.float64()), ("v", pa.binary())])

    def run(batches):
        for b in batches:
            lists = b.column(1)
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            x = np.zeros((b.num_rows, space.width))
            at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            x[np.repeat(np.arange(b.num_rows), n), at] = flat
            up = space.lift(x)
            near = ((up**2).sum(1)[:, None] + (space.pivots**2).sum(1)[None, :] - 2 * up @ space.pivots.T).argmin(1)
            dist = np.sqrt(((up - space.pivots[near]) ** 2).sum(1))
            range_ = np.minimum(dist / space.most() * BINS, BINS - 1).astype(np.int32)
            packed = [r.tobytes() for r in x.astype(space.kind)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(near.astype(np.int32)), pa.array(range_), pa.array(dist), pa.array(packed, pa.binary())], schema=schema
            )

    return run, "vec_id long, pivot int, bin int, dist double, v binary"


def shelves(counts: list[tuple[int, int, int, float, float]], size: int) -> list[tuple[int, int, int, int, float, float, int]]:
    """Neighbouring ranges of a pivot joined up to ``size`` rows: (shelf, pivot, first bin, last bin, nearest, furthest,
    parts). A range with more rows is a shelf of several parts."""
    out: list[list] = []
    for pivot, b, n, lo, hi in sorted(counts):
        if out and out[-1][0] == pivot and out[-1][5] + n <= size:
            out[-1][2], out[-1][4], out[-1][5] = b, hi, out[-1][5] + n
        else:
            out.append([pivot, b, b, lo, hi, n])
    return [(i, p, a, z, lo, hi, -(-n // size)) for i, (p, a, z, lo, hi, n) in enumerate(out)]


def expand(space: Space, q, q_ids, least, x, ids, dist, q_dist, k: int):
    """Best k of a shelf's rows for each query, of those that score at least ``least``: (query place, id, score), and the
    number of pairs that were scored. ``dist``: rows' distances to the shelf's pivot, ``q_dist``: the queries'."""
    order = np.lexsort((ids, dist))
    x, ids, dist = x[order], ids[order], dist[order]
    starts = np.arange(0, len(ids), ANNULUS)
    inner, outer = dist[starts], dist[np.minimum(starts + ANNULUS, len(ids)) - 1]
    gap = np.maximum(np.maximum(inner[None, :] - q_dist[:, None], q_dist[:, None] - outer[None, :]), 0)
    bound = space.bound((q**2).sum(1)[:, None], gap)
    best = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    pairs = 0
    for a in np.argsort(-bound.max(axis=0, initial=-np.inf), kind="stable"):
        ask = np.flatnonzero((bound[:, a] >= best[:, -1]) & (bound[:, a] >= least))
        if not len(ask):
            continue
        part = slice(starts[a], starts[a] + ANNULUS)
        pairs += len(ask) * len(ids[part])
        s = q[ask] @ x[part].T
        s[(ids[part][None, :] == q_ids[ask][:, None]) | (s < least[ask][:, None])] = -np.inf
        s = np.column_stack([best[ask], s])
        w = np.column_stack([who[ask], np.broadcast_to(ids[part], (len(ask), len(ids[part])))])
        pick = np.lexsort((w, -s), axis=1)[:, :k]
        best[ask], who[ask] = np.take_along_axis(s, pick, 1), np.take_along_axis(w, pick, 1)
    at, col = np.nonzero(best > -np.inf)
    return at, who[at, col], best[at, col], pairs


_FOUND = "query_id long, vec_id long, score long"


def _found(q_ids, at, who, score, pairs: int) -> pa.Table:
    """Results, and a row without a query that counts the pairs scored."""
    return pa.table({
        "query_id": pa.concat_arrays([pa.array(q_ids[at], pa.int64()), pa.nulls(1, pa.int64())]),
        "vec_id": pa.concat_arrays([pa.array(who, pa.int64()), pa.nulls(1, pa.int64())]),
        "score": pa.array(np.append(score, pairs).astype(np.int64)),
    })


def _own(space: Space, k: int):
    """The queries of a shelf's part against its rows."""

    def f(t: pa.Table) -> pa.Table:
        x, ids, dist = _matrix(t.column("v"), space.width, space.kind), t.column("vec_id").to_numpy(), t.column("dist").to_numpy()
        asks = np.flatnonzero(t.column("asks").to_numpy(zero_copy_only=False))
        q, pivot = x[asks], t.column("pivot")[0].as_py()
        at, who, score, pairs = expand(space, q, ids[asks], np.full(len(asks), -np.inf), x, ids, dist, space.reach(q)[:, pivot], k)
        return _found(ids[asks], at, who, score, pairs)

    return f


def _asked(space: Space, table: list[tuple], seed: int):
    """Where a query goes: the parts of shelves that its bound leaves, but the one that it has met."""
    shelf, pivot, _, _, lo, hi, parts = (np.array(c) for c in zip(*table, strict=True))
    schema = pa.schema([("shelf", pa.int32()), ("part", pa.int32()), ("query_id", pa.int64()), ("least", pa.float64()), ("qv", pa.binary())])

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 512):
                t = b.slice(start, 512)
                q = _matrix(t.column(t.schema.get_field_index("v")), space.width, space.kind)
                get = lambda c: t.column(t.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                d = space.reach(q)[:, pivot]
                gap = np.maximum(np.maximum(lo[None, :] - d, d - hi[None, :]), 0)
                least = get("least")
                row, at = np.nonzero(space.bound((q**2).sum(1)[:, None], gap) >= least[:, None])
                n = parts[at]
                part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                row, at = np.repeat(row, n), np.repeat(at, n)
                other = (shelf[at] != get("shelf")[row]) | (part != get("part")[row])
                row, at, part = row[other], at[other], part[other]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shelf[at].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(get("vec_id")[row]), pa.array(least[row]),
                        t.column(t.schema.get_field_index("v")).take(pa.array(row)),
                    ],
                    schema=schema,
                )

    return run, "shelf int, part int, query_id long, least double, qv binary"


def _other(space: Space, k: int):
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            z = pa.array([], pa.int64())
            return pa.table({"query_id": z, "vec_id": z, "score": z})
        q, x = (_matrix(t.column(c), space.width, space.kind) for t, c in ((left, "qv"), (right, "v")))
        q_ids, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        q_dist = space.reach(q)[:, right.column("pivot")[0].as_py()]
        return _found(q_ids, *expand(space, q, q_ids, left.column("least").to_numpy(), x, ids, right.column("dist").to_numpy(), q_dist, k))

    return f


def scored(vectors: DataFrame, queries, k: int = 20, scale: float = 64, pivots: int = 32, seed: int = 5) -> DataFrame:
    """Candidates (query_id, vec_id, score) that hold each query's best ``k``, and rows without a query_id whose scores are
    numbers of pairs that were scored."""
    rows = _usable(vectors, scale)
    square, large = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c), F.aggregate("x", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))
    dims = rows.agg(F.max(F.size("x")).alias("w"), F.max(square).alias("m"), F.max(large).alias("c")).first()
    width, top = int(dims["w"] or 0), float(dims["m"] or 0.0)
    # the rows with the smallest keyed hashes: at most `pivots` vectors reach the driver
    some = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(pivots).collect()
    spots = np.array([r["x"] + [0.0] * (width - len(r["x"])) for r in some], dtype=np.float64).reshape(len(some), width)
    spots = np.unique(spots, axis=0) if len(spots) else np.zeros((1, width))
    space = Space(spots, width, top, "<i2" if (dims["c"] or 0.0) < 32768 else "<f8")
    run, schema = _keyed(space)
    index = cut(rows.mapInArrow(run, schema))
    # at most BINS rows for each pivot
    counts = index.groupBy("pivot", "bin").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()
    table = shelves([tuple(r) for r in counts], SHELF)
    if not table:
        return index.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score"))
    bins = [(p, b, s, parts) for s, p, a, z, _, _, parts in table for b in range(a, z + 1)]
    places = F.broadcast(vectors.sparkSession.createDataFrame(bins, "pivot int, bin int, shelf int, parts int"))
    part = F.pmod(F.xxhash64(F.lit(seed + 2), "vec_id", "v"), F.col("parts")).cast("int").alias("part")
    placed = index.join(places, ["pivot", "bin"]).select("shelf", part, "vec_id", "pivot", "dist", "v", queries.alias("asks"))
    first = cut(placed.groupBy("shelf", "part").applyInArrow(_own(space, k), _FOUND))
    # a query's bound is its k-th score so far
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.where("query_id is not null").withColumn("_r", F.row_number().over(last)).where(F.col("_r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
    asking = placed.where("asks").join(kth, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    run, schema = _asked(space, table, seed)
    asked = asking.select("vec_id", "shelf", "part", "v", "least").mapInArrow(run, schema)
    blocks = max(1, -(-asking.count() // QUERIES))
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "query_id"), F.lit(blocks)).cast("int")))
    keys = ["shelf", "part", "block"]
    wanted = asked.select(*keys).distinct()
    held = placed.select(F.col("shelf").alias("shelf"), "part", "vec_id", "pivot", "dist", "v").join(wanted, ["shelf", "part"])
    held = held.select(*[F.col(c).alias(f"{c}_") for c in keys], "vec_id", "pivot", "dist", "v")
    others = asked.groupBy(*keys).cogroup(held.groupBy(*[f"{c}_" for c in keys])).applyInArrow(_other(space, k), _FOUND)
    return first.unionByName(others)


def search(vectors: DataFrame, queries, k: int = 20, **options) -> DataFrame:
    """The ``k`` best rows for each query: query_id, rank, vec_id, score. ``queries``: a condition on vec_id that picks the
    queries out of the rows."""
    found = scored(vectors, queries, k, **options).where("query_id is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
