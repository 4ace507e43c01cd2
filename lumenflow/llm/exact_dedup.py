"""Exact duplicates by progressive refinement: group by length, then by a prefix's hash, then by the full hash.

Texts are equal if they are identical once each run of white space is one space. No step ships a text:
1. one scan keeps each row's length and the hash of its first ``PREFIX`` characters, 16 bytes a row. Lengths that several
   rows share are a bitmap; only rows of such a length are grouped by length and prefix;
2. the groups of several rows are a second bitmap. A second scan takes the full hash (SHA-256) of the rows that it passes,
   and of no other text; these survivors are grouped by the hash. A bitmap can pass a row too many, never one too few, and
   the full hash alone decides, so results don't depend on it;
3. survivors learn their group's size and first row. Groups with over a thousandth of all rows, a thousand at most, are
   broadcast; with these taken out no key has more than a thousandth of the rows, and the rest meets its groups by a join.

Defined results: null counts as empty text, and all empty texts are one group; of a group the row with the smallest doc_id
stays, null ids last; of rows that repeat text and id exactly one stays; very long texts are hashed whole; an empty table
gives no rows; any other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut

#: Characters whose hash is the second step's key.
PREFIX = 64
#: Bits of a bitmap, 32 MB at most. A fuller one passes more rows to the full hash, at a cost in time only.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 28
#: A group with over 1 / SHARE of the rows is broadcast; there are fewer than SHARE of them.
SHARE = 1000


def normal(text: Column) -> Column:
    """The text whose identity counts: null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normal text in UTF-8, as lowercase hex."""
    return F.sha2(normal(text), 256)


class Sieve:
    """A bitmap of hashed keys as a table of 4 KB pieces, of bounded size."""

    def __init__(self, keys: DataFrame, *columns: str) -> None:
        """``keys`` is a stored table: it is counted, then read again."""
        n = keys.count()
        self.bits = LEAST_BITS
        while self.bits < min(16 * n, MOST_BITS):
            self.bits *= 2
        spot = self._spot(*columns)
        self.pieces = keys.groupBy(F.bitmap_bucket_number(spot).alias("piece_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits_"))

    def _spot(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits)) + 1  # these functions count from 1

    def mark(self, rows: DataFrame, flag: str, *columns: str) -> DataFrame:
        """The rows with a flag: true for each key of the sieve, and for few others."""
        spot = self._spot(*columns)
        at = F.bitmap_bit_position(spot)
        byte = F.conv(F.hex(F.substring("bits_", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
        joined = rows.withColumn("at_", F.bitmap_bucket_number(spot)).join(F.broadcast(self.pieces), F.col("at_") == F.col("piece_"), "left")
        return joined.withColumn(flag, held).drop("at_", "piece_", "bits_")


def _sized(text: Column) -> list[Column]:
    return [F.length(text).alias("n_"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("p_")]


def survivors(docs: DataFrame, text: str = "text") -> Sieve:
    """Lengths and prefixes that several rows share."""
    keys = cut(docs.select(normal(F.col(text)).alias("t_")).select(*_sized(F.col("t_"))))
    lengths = Sieve(cut(keys.groupBy("n_").agg(F.count("*").alias("k_")).where("k_ > 1")), "n_")
    pairs = lengths.mark(keys, "more_", "n_").where("more_").groupBy("n_", "p_").agg(F.count("*").alias("k_")).where("k_ > 1")
    return Sieve(cut(pairs), "n_", "p_")


def classes(docs: DataFrame, carry: list[Column], text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: ``row_`` (a struct of the carried columns), keep_id, group_size, kept."""
    seen = docs.select(F.struct(*carry).alias("row_"), F.col(key).cast("long").alias("id_"), normal(F.col(text)).alias("t_"), F.monotonically_increasing_id().alias("nr_"))
    seen = survivors(docs, text).mark(seen.select("row_", "id_", "nr_", "t_", *_sized(F.col("t_"))), "more_", "n_", "p_")
    # the rows' numbers hold from here on, as they are stored
    rows = cut(seen.select("row_", "id_", "nr_", F.when(F.col("more_"), F.unhex(F.sha2("t_", 256))).alias("full_")))
    first = F.min(F.struct(F.col("id_").isNull().alias("none"), F.col("id_").alias("id"), F.col("nr_").alias("nr")))
    groups = cut(
        rows.where("full_ is not null").groupBy("full_").agg(F.count("*").alias("k_"), first.alias("first_")).where("k_ > 1")
        .select(F.col("full_").alias("of_"), "k_", "first_")
    )
    hot = F.col("k_") * SHARE > F.lit(rows.count())
    alone, met = rows.where("full_ is null"), F.col("full_") == F.col("of_")
    asked = rows.where("full_ is not null").join(F.broadcast(groups.where(hot)), met, "left")
    large, rest = asked.where("of_ is not null"), asked.where("of_ is null").drop("of_", "k_", "first_").join(groups.where(~hot), met, "left")
    single = alone.select("*", *[F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in groups.columns])
    return (
        large.unionByName(rest).unionByName(single)
        .select(
            "row_", F.when(F.col("of_").isNull(), F.col("id_")).otherwise(F.col("first_.id")).alias("keep_id"),
            F.coalesce("k_", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("first_.nr") == F.col("nr_"), F.lit(True)).alias("kept"),
        )
    )


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = classes(docs, [F.col(f"`{c}`") for c in docs.columns], text, key).where("kept")
    return kept.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])
