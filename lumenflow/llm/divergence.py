"""Divergence audit: how far each source's use of terms is from the other sources of its language, and by which terms.

A plain relational plan: texts explode into terms, which are counted by group (lang, source), groups meet their language's kept
vocabulary so that absent terms count 0, each group meets the others by language and term, and windows rank the sums. The
explosion runs on Arrow batches, where a text's words are summed as they are found; the rest is DataFrame operations.

Only counts are shuffled, never texts: occurrences and documents of a term are summed within each task first. The kept terms'
counts are a stored table of the groups that have them; zeros exist only while the groups meet. A language's vocabulary meets
the groups in ``SPREAD`` parts of their own keys, so that a language with most of the rows is spread over tasks. Of the terms
of a group each task sends on only the first ranks.

Defined results: null text, lang and source count as ''; a group without terms gives every kept term with count 0; a
language that keeps no term (V = 0) gives pairs of value 0 and no terms; a group without other sources of its language has
no pairs; rows that repeat are documents of their own; equal values rank by the item's UTF-8 bytes; very long texts are taken
whole; an empty table gives no rows; other columns, doc_id among them, are ignored. Products are decimals, so that counts
beyond 64 bits times the scale stay exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut, stored
from lumenflow.llm import _bytes as B

#: Parts of a language's vocabulary, each of which meets the language's groups under a key of its own.
SPREAD = 64
#: Sums that a task holds before it sends them on.
HELD = 800_000
#: ASCII letters in lower case, bytes of characters beyond ASCII as they are, any other byte as a space.
SPACED = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, d) of a task's texts. A term is a run of letters and of characters beyond ASCII, the bytes
    that the table doesn't make a space; sums are sent on whenever ``HELD`` of them are held."""
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    d: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), c in n.items():
            of = d[lang, source]
            columns = [pa.repeat(lang, len(c)), pa.repeat(source, len(c)), pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64()), pa.array([of[t] for t in c], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "d"])
        n.clear()
        d.clear()

    for batch in batches:
        for part in B.slices(batch):
            lang, source = (B.column(part, c).to_pylist() for c in ("lang", "source"))
            for group, text in zip(zip(lang, source, strict=True), B.column(part, "text").cast(pa.large_binary()).to_pylist(), strict=True):
                words = (text or b"").translate(SPACED).split()
                n[group].update(words)
                d[group].update(set(words))
            if sum(map(len, n.values())) > HELD:
                yield from send()
    yield from send()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents. Each task sums first; then all groups' counts of a language's term
    meet in one task, a row for each of them and task."""
    words = docs.select(_blank("lang"), _blank("source"), F.col("text").cast("string").alias("text"))
    rows = words.mapInArrow(_explode, "lang string, source string, term binary, n long, d long")
    rows = rows.withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(n: str, total: str, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / total), exactly: in decimals where 64 bits don't hold the product."""
    fits = 2**63 // scale - 2
    return F.expr(f"1 + if({n} < {fits}L, ({scale}L * ({n} + 1)) div {total}, ({scale}BD * ({n} + 1)) div {total})")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit(docs: DataFrame, min_docs: int = 3, most: int = 200, scale: int = 1_000_000_000) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): of part ``pair`` for each other source, of part ``term`` for the
    ``most`` terms that the group uses most beyond its language."""
    of_term = Window.partitionBy("lang", "term")
    kept = stored(
        counts(docs)
        .select("*", F.sum("d").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("m"), F.row_number().over(of_term.orderBy("source")).alias("nr"))
        .where(F.col("docs") >= min_docs)
        .select("lang", "source", "term", "n", "m", "nr"),
        "vocabulary",
    )
    groups = cut(
        docs.select(_blank("lang"), _blank("source")).distinct()
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left")
        .join(kept.groupBy("lang").agg(F.sum("n").alias("whole"), F.count_if(F.col("nr") == 1).alias("v")), "lang", "left")
        .select(
            "lang", "source", (F.coalesce("own", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("own"), (F.col("whole") + F.col("v")).alias("whole"), F.coalesce("v", F.lit(0)).alias("v"),
            F.monotonically_increasing_id().alias("g"),  # a number for each group, which holds from here on
        )
    )
    used = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "m", "g", "own", "whole")
    # every group with every kept term of its language
    part = F.pmod(F.xxhash64("term"), F.lit(SPREAD)).cast("int").alias("part")
    spread = groups.where("v > 0").select("lang", "g", "own", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    every = kept.where("nr = 1").select("lang", "term", part).join(spread, ["lang", "part"]).select("lang", "term", "g", "own")
    dense = (
        every.join(used.select("term", "g", "n"), ["term", "g"], "left")
        .select("lang", "term", "g", "own", F.coalesce("n", F.lit(0)).alias("n"))
        .select("lang", "term", "g", _share("n", "own", scale).alias("p"))
        .repartition("lang", "term")  # named, so that both sides below are one shuffle
    )
    other = dense.select("lang", "term", F.col("g").alias("h"), F.col("p").alias("q"))
    # each two groups meet once, for both directions
    sums = (
        dense.join(other, ["lang", "term"]).where("g < h")
        .groupBy("g", "h").agg(F.sum(_gap("p", "q")).alias("to"), F.sum(_gap("q", "p")).alias("fro"))
    )
    ways = F.array(F.struct(F.col("g"), F.col("h"), F.col("to").alias("value")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("fro").alias("value")))
    pairs = (
        sums.select(F.explode(ways).alias("w")).select("w.*").join(groups.select("g", "lang", "source"), "g")
        .join(groups.select(F.col("g").alias("h"), F.col("source").alias("item")), "h").select("lang", "source", "item", "value")
    )
    bare = groups.where("v = 0").select("lang", "source")
    pairs = pairs.unionByName(
        bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    )
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranks).alias("rank"))
    shares = used.select("lang", "source", "term", _share("n", "own", scale).alias("p"), _share("m", "whole", scale).alias("q"))
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    return ranked.unionByName(above.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= most))
