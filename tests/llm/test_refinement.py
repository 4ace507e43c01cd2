"""Exact duplicates and the divergence audit against plain code, with the odd cases."""

import hashlib
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenflow.llm import divergence, exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_ long, row_ string, term string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)


def _plain_classes(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


LONG = "lorem ipsum " * 200_000
ODD = [
    (1, "a b", "en", "s"), (2, "a\t\n b", "en", "s"), (3, "a  b", "de", None), (3, "a b", "de", "s"), (None, "a b", "fr", "t"), (4, " a b", "en", "s"), (5, "a b ", "en", "s"),
    (6, None, None, None), (7, "", None, "s"), (None, None, "en", None), (8, "A B", "en", "s"), (9, "a b", "en", "s"), (10, "a\x1fb", "en", "s"), (11, LONG, "en", "s"), (12, LONG, "en", "t"),
    (13, LONG + "x", "en", "t"), (14, LONG[:-1] + "x", "en", "t"), (15, "é", "fr", "s"), (16, "é", "fr", "s"), (-1, "ß ß", "de", "s"), (17, "ß\r\nß", "de", "s"), (18, "one of a kind", "de", "s"),
]


def _classes(docs):
    rows = exact_dedup.classes(docs, [F.col("doc_id"), exact_dedup.digest(F.col("text")).alias("h")])
    return sorted([tuple(r) for r in rows.select("row_.doc_id", "keep_id", "group_size", "kept", "row_.h").collect()], key=str)


@pytest.mark.parametrize("rows", [ODD, [], [(1, "x", "a", "b")], [(i, "same", "a", "b") for i in range(50)] + [(i, f"t{i % 7}", "a", "b") for i in range(50, 90)]])
def test_classes(spark, rows):
    assert _classes(_table(spark, rows)) == _plain_classes(rows)


def test_classes_of_unbroadcast_groups(spark, monkeypatch):
    rows = [(i, f"text {i % 900} {'z' * (i % 11)}", "a", "b") for i in range(3000)] + [(5000 + i, "hot", "a", "b") for i in range(1500)]
    want = _plain_classes(rows)
    for share in (1, 10, 1000, 10**6):
        monkeypatch.setattr(exact_dedup, "SHARE", share)
        assert _classes(_table(spark, rows)) == want


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    rows = [(i, f"text {i % 40000}", "a", "b") for i in range(80000)]
    monkeypatch.setattr(exact_dedup, "MOST_BITS", exact_dedup.LEAST_BITS)
    assert _classes(_table(spark, rows)) == _plain_classes(rows)


def test_only_survivors_are_hashed_whole(spark):
    """Texts of a length of their own, and texts whose beginning is their own, don't reach the full hash."""
    rows = [(i, "q" * i, "a", "b") for i in range(1, 500)] + [(1000 + i, f"{i:04d} same tail", "a", "b") for i in range(500)] + [(2000, "twice so"), (2001, "twice so")]
    docs = _table(spark, [(*r, None, None)[:4] for r in rows])
    t = docs.select("doc_id", exact_dedup.normal(F.col("text")).alias("t_")).select("doc_id", *exact_dedup._sized(F.col("t_")))
    passed = {r[0] for r in exact_dedup.survivors(docs).mark(t, "more", "n_", "p_").where("more").collect()}
    assert {2000, 2001} <= passed and len(passed) < 20


def test_deduplicated_keeps_columns(spark):
    docs = _table(spark, ODD)
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    want = sorted(r[0] for r in _plain_classes(ODD) if r[3] and r[0] is not None)
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == want
    assert {r.row_ for r in got.collect()} == {"x"}


def _plain_audit(rows, least=3, most=200):
    low = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        vocab = [t for t in seen if seen[t] >= least]
        per = {s: Counter() for _, s, _ in own}
        for _, s, w in own:
            per[s].update(t for t in w if seen[t] >= least)

        def shares(c):
            n = sum(c.values()) + len(vocab)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in vocab}  # noqa: B023

        q = shares(sum(per.values(), Counter()))
        p = {s: shares(c) for s, c in per.items()}
        for s in per:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in vocab), o) for o in per if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in vocab if per[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= most]
    return sorted(out)


AUDIT = [
    (1, "the cat the dog", "en", "a"), (2, "The cat sat", "en", "a"), (3, "the dog sat and sat", "en", "b"), (4, "the cat AND the é é", "en", None), (5, "é and cat dog", "en", "c"),
    (5, "é and cat dog", "en", "c"), (None, "dog dog dog \U0001f600 ﬁ", "en", "c"), (6, None, "en", "empty"), (7, "", None, None), (8, "rare words only here", "de", "a"), (9, "nothing kept", "de", "b"),
    (10, "12 34 !!", "de", "c"), (11, "x x x", "fr", "a"), (12, "x y", "fr", "a"), (13, "X y z", "fr", "a"), (14, "y \U0001f600 ﬁ", "en", "b"), (15, "\U0001f600 ﬁ ﬁ", "en", "a"), (16, "ÀB àb AB", "", "a"), (17, "ÀB ab", None, "b"), (18, "ab Àb", "", ""),
]


@pytest.mark.parametrize("rows", [AUDIT, [], [(1, None, None, None)], AUDIT + [(i, "the hot " * 5 + f"w{'abcdefgh'[i % 8]} w{'abcde'[i % 5]}", "en", f"s{i % 4 * (i % 3)}") for i in range(300)]])
def test_audit(spark, rows):
    got = divergence.audit(_table(spark, rows))
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(tuple(r) for r in got.collect()) == _plain_audit(rows)


def test_sums_are_sent_in_parts(monkeypatch):
    """A task with little room sends a term's sums more than once; together they are the same."""
    monkeypatch.setattr(divergence, "HELD", 3)
    columns = [pa.array([r[c] or "" if c > 1 else r[c] for r in AUDIT], pa.string()) for c in (2, 3, 1)]
    batch = pa.RecordBatch.from_arrays(columns, ["lang", "source", "text"])
    got = list(divergence._explode(iter([batch.slice(i, 2) for i in range(0, len(AUDIT), 2)])))
    assert len(got) > 5
    n, d = Counter(), Counter()
    for row in pa.Table.from_batches(got).to_pylist():
        n[row["lang"], row["source"], row["term"].decode()] += row["n"]
        d[row["lang"], row["source"], row["term"].decode()] += row["d"]
    low = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))) for _, t, lang, source in AUDIT]
    assert n == Counter((lang, s, t) for lang, s, w in words for t in w) and d == Counter((lang, s, t) for lang, s, w in words for t in set(w))


def test_audit_keeps_the_first_ranks_only(spark):
    word = lambda i: "w" + "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, " ".join(word(j) for j in range(300) if (i + j) % 3), "en", "ab"[i % 2]) for i in range(12)]
    rows += [(100 + i, " ".join(word(j) for j in range(150)), "en", "a") for i in range(4)]
    assert sorted(tuple(r) for r in divergence.audit(_table(spark, rows), most=20).collect()) == _plain_audit(rows, most=20)


def test_shares_stay_exact_beyond_64_bits(spark):
    row = spark.sql("select 30000000000L as n, 70000000007L as t").select(divergence._share("n", "t", 10**9)).first()
    assert row[0] == 1 + 10**9 * (30000000000 + 1) // 70000000007
