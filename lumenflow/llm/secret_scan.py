"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens. DataFrame functions only.

Tokens of at least ``min_length`` characters that no fixed pattern covers are candidates. Each one's encoding is the
smallest known alphabet that holds all its characters. Three tests ask whether it could be a uniformly random string of
that alphabet: chi-squared uniformity, runs above and below the alphabet's middle, and lag-one serial correlation. Their
p-values are combined by Cauchy's method, which holds for dependent tests. In each family, tokens of one encoding and one
length class, a Benjamini-Hochberg step-up at level ``alpha`` on the combined p-values finds the tokens that aren't random:
no more than that share of them is expected to be random after all, whatever the length.

The rest is judged against ordinary text, by a likelihood ratio: the probability of the token as text over that as a random
string of its encoding. By Markov's inequality, no more than p of all text has a ratio of p or less, at any length, so that
the ratio (times the number of encodings) is a p-value. The model of text is a chain over lower case, upper case, digits and
signs, with letters by letter pairs that are counted on the short words of all documents; or a number, all
digits alike: a string of digits only is never taken for a secret. A second step-up, at level ``fdr`` and again in each
family, so that the many short tokens don't use up what the long ones can show, controls the share of ordinary tokens among
the found ones; tokens that failed the battery count in it with a p-value of 1. P-values are counted in bins of 1/20 decade
by their upper borders, which keeps both step-ups exact from above and lets them run on counts of bounded number.

Spans are code points, end exclusive. Defined results: null text is empty; empty text has no span; rows that repeat a
doc_id are separate; a text is scanned whole, in time that is linear in its matches up to millions of them; an empty table
gives no rows; other columns are ignored by ``scan`` and ``report``, and kept by ``masked``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut

#: Fixed patterns.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by size of the alphabet; the first that holds a token is taken.
ALPHABETS = [
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER,
    _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER + "+/_=-",
]
#: The model of text: probabilities to start with and to go on from lower case, upper case, a digit and a sign to each of them.
_SIGNS = "+/_=-"
START = [0.6, 0.2, 0.15, 0.05]
STEPS = [[0.87, 0.04, 0.03, 0.06], [0.30, 0.60, 0.04, 0.06], [0.08, 0.05, 0.75, 0.12], [0.50, 0.20, 0.25, 0.05]]
#: Characters that can stand in a token, in the order of the model's table.
CHARSET = _LOWER + _UPPER + _DIGITS + _SIGNS
#: The weight of even pairs among the counts of letter pairs, in letters.
EVEN = 100.0
#: Length classes: each holds the lengths up to the next border.
LENGTHS = [20, 24, 32, 40, 64, 128]
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


#: Elements of an array that are gone through at once.
RUN = 128


def _walk(items: Column, after, row, kind: str, held=lambda at, c: F.lit(0)) -> Column:
    """``row(at, x, held)`` for each element x, where ``at`` begins with 0 and moves on by ``after(at, x)``: an array of
    ``kind``. ``held(at, c)`` is computed once for the elements c of a run.

    Growing an array copies it, so the elements are taken in runs: first the number before each run, then the runs.
    """
    runs = F.transform(
        F.array(items),  # bound once
        lambda p: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda i: F.slice(p, i * RUN + 1, F.lit(RUN))
        ),
    )[0]
    empty = F.filter(F.transform(runs, lambda c: F.struct(F.lit(0).cast("long").alias("at"), c.alias("c"))), lambda c: F.lit(False))
    begun = F.aggregate(
        runs,
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda acc, c: F.struct(
            F.aggregate(c, acc["at"], lambda at, x: after(at, x).cast("long")).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), c.alias("c")))).alias("out"),
        ),
    )["out"]
    begun = F.transform(begun, lambda r: F.struct(r["at"].alias("at"), r["c"].alias("c"), held(r["at"], r["c"]).alias("held")))
    done = F.transform(
        begun,
        lambda r: F.aggregate(
            r["c"],
            F.struct(r["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda acc, x: F.struct(after(acc["at"], x).cast("long").alias("at"), F.concat(acc["out"], F.array(row(acc["at"], x, r["held"]).cast(kind))).alias("out")),
        )["out"],
    )
    return F.flatten(done)


def _found(text: Column, pattern: str, group: int | None = None) -> Column:
    """Matches of a pattern from left to right: array of (start, body, inner); ``inner`` is the group's text."""
    body = F.regexp_extract_all(text, F.lit(pattern), 0)
    inner = body if group is None else F.regexp_extract_all(text, F.lit(pattern), group)
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), body.alias("body"), inner.alias("inner"))
    kind = "struct<start:bigint,body:string,inner:string>"
    walked = _walk(
        pieces,
        lambda at, p: at + F.length(p["gap"]) + F.coalesce(F.length(p["body"]), F.lit(0)),
        lambda at, p, _: F.struct((at + F.length(p["gap"])).alias("start"), p["body"].alias("body"), p["inner"].alias("inner")),
        kind,
    )
    walked = F.filter(walked, lambda m: m["body"].isNotNull())  # the last piece has no match behind it
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(F.array().cast(f"array<{kind}>"))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["body"])).cast("long").alias("end")),
    ).cast(_SPAN)


def upper_tail(z: Column) -> Column:
    """P(N > z) of a standard normal, within 0.3 % (Borjesson and Sundberg, 1979)."""
    a = F.abs(z)
    q = F.exp(-a * a / 2) / (((1 - 0.339) * a + 0.339 * F.sqrt(a * a + 5.510)) * math.sqrt(2 * math.pi))
    return F.when(z >= 0, q).otherwise(1 - q)


def cauchy(*p: Column) -> Column:
    """One p-value of several, which may depend on each other (Liu and Xie, 2020)."""
    parts = [F.tan((0.5 - F.least(F.greatest(x, F.lit(1e-15)), F.lit(1 - 1e-9))) * math.pi) for x in p]
    return F.greatest(0.5 - F.atan(sum(parts, F.lit(0.0)) / len(p)) / math.pi, F.lit(0.0))


def letter_pairs(docs: DataFrame) -> dict[str, int]:
    """Counts of the ASCII letter pairs in short words of all documents, in lower case. Words of ``LENGTHS[0]`` letters or more are
    candidates, and don't count."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"(?<![A-Za-z0-9+/_=-])[a-z]{{2,{LENGTHS[0] - 1}}}(?![A-Za-z0-9+/_=-])"), 0)
    some = docs.where(F.col("text").isNotNull()).select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    at = F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i")
    pairs = some.select("w", "n", at).groupBy(F.expr("substring(w, i, 2)").alias("pair")).agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in pairs.collect()}


def text_costs(pairs: dict[str, int]) -> list[float]:
    """-ln of the model's probability of each character after each character (a row of the table), then of each one at the
    start (the last row)."""
    m = [[pairs.get(a + b, 0) for b in _LOWER] for a in _LOWER]
    alone = [sum(row[j] for row in m) for j in range(26)]
    total = sum(alone)
    single = [(x + EVEN / 26) / (total + EVEN) for x in alone]
    after = [[(x + EVEN * q) / (sum(row) + EVEN) for x, q in zip(row, single, strict=True)] for row in m]

    def kind(i: int) -> int:
        return 0 if i < 26 else 1 if i < 52 else 2 if i < 62 else 3

    def drawn(a: int | None, b: int) -> float:
        k = kind(b)
        if k > 1:
            return 1 / (10 if k == 2 else len(_SIGNS))
        # a capital after a small letter begins a word
        return after[a % 26][b % 26] if a is not None and kind(a) < 2 and (kind(a), k) != (0, 1) else single[b % 26]

    size = range(len(CHARSET))
    return [-math.log(STEPS[kind(a)][kind(b)] * drawn(a, b)) for a in size for b in size] + [-math.log(START[kind(b)] * drawn(None, b)) for b in size]


def _judged(tokens: Column, costs: list[float]) -> Column:
    """Tokens with their p-values: array of (start, end, family, p_random: that of the three tests of randomness together,
    p_text: that of text with as small a likelihood ratio).

    One step per transform: each step's values are computed once and named by the next.
    """
    # one literal, once folded
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in costs)), ",").cast("array<double>")
    known = F.transform(
        tokens,
        lambda t: F.struct(
            t["start"].alias("start"), t["body"].alias("body"), F.length(t["body"]).cast("double").alias("n"),
            # the first alphabet of which nothing of the token is left over
            F.coalesce(*[F.when(F.length(F.translate(t["body"], a, "")) == 0, F.lit(i)) for i, a in enumerate(ALPHABETS)], F.lit(len(ALPHABETS) - 1)).alias("code"),
        ),
    )
    named = F.transform(
        known,
        lambda t: F.struct(*[t[c].alias(c) for c in ("start", "body", "n", "code")], F.get(F.array(*[F.lit(a) for a in ALPHABETS]), t["code"]).alias("alphabet")),
    )
    coded = F.transform(
        named,
        lambda t: F.struct(
            t["start"].alias("start"), t["n"].alias("n"), t["code"].alias("code"), F.length(t["alphabet"]).cast("double").alias("size"),
            ((F.length(t["alphabet"]).cast("double") - 1) / 2).alias("middle"),
            F.aggregate(
                F.filter(F.split(t["alphabet"], ""), lambda c: c != ""), F.lit(0.0),
                lambda acc, c: acc + F.pow(t["n"] - F.length(F.replace(t["body"], c, F.lit(""))), F.lit(2.0)),
            ).alias("squares"),
            F.transform(F.filter(F.split(t["body"], ""), lambda c: c != ""), lambda c: F.position(c, t["alphabet"]).cast("double") - 1).alias("codes"),
            F.aggregate(
                F.filter(F.split(t["body"], ""), lambda c: c != ""),
                F.struct(F.lit(len(CHARSET)).alias("last"), F.lit(0.0).alias("cost")),
                lambda acc, c: F.struct(
                    (F.position(c, F.lit(CHARSET)) - 1).cast("int").alias("last"),
                    (acc["cost"] + F.get(table, (acc["last"] * len(CHARSET) + F.position(c, F.lit(CHARSET)) - 1).cast("int"))).alias("cost"),
                ),
            )["cost"].alias("cost"),
        ),
    )
    # neighbours on different sides of the middle, their products about it, the squares, and those below
    walked = F.transform(
        coded,
        lambda t: F.struct(
            *[t[c].alias(c) for c in ("start", "n", "code", "size", "cost")], (t["squares"] * t["size"] / t["n"] - t["n"]).alias("chi"),
            F.aggregate(
                t["codes"],
                F.struct(*[F.lit(x).alias(c) for c, x in (("last", -1.0), ("k", 0.0), ("s", 0.0), ("v", 0.0), ("low", 0.0))]),
                lambda acc, x: F.struct(
                    x.alias("last"),
                    (acc["k"] + F.when((acc["last"] >= 0) & ((acc["last"] <= t["middle"]) != (x <= t["middle"])), 1.0).otherwise(0.0)).alias("k"),
                    (acc["s"] + F.when(acc["last"] >= 0, (acc["last"] - t["middle"]) * (x - t["middle"])).otherwise(0.0)).alias("s"),
                    (acc["v"] + (x - t["middle"]) * (x - t["middle"])).alias("v"),
                    (acc["low"] + F.when(x <= t["middle"], 1.0).otherwise(0.0)).alias("low"),
                ),
            ).alias("w"),
        ),
    )
    runs = F.transform(
        walked, lambda t: F.struct(*[t[c].alias(c) for c in ("start", "n", "code", "size", "cost", "chi", "w")], (2 * t["w"]["low"] * (t["n"] - t["w"]["low"]) / t["n"] + 1).alias("mean"))
    )

    def scores(t: Column) -> Column:
        df = t["size"] - 1
        # Wilson and Hilferty: the cube root of a chi-squared over its degrees of freedom is nearly normal
        z_chi = (F.cbrt(F.greatest(t["chi"], F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        spread = (t["mean"] - 1) * (t["mean"] - 2) / (t["n"] - 1)
        z_runs = F.when(t["mean"] > 2, (t["w"]["k"] + 1 - t["mean"]) / F.sqrt(spread)).otherwise(F.lit(99.0))
        z_serial = F.when(t["w"]["v"] > 0, t["w"]["s"] / t["w"]["v"] * F.sqrt(t["n"])).otherwise(F.lit(99.0))
        # whichever model of text fits better; any of the encodings may be the token's
        cost = F.when(t["size"] == len(_DIGITS), F.least(t["cost"], t["n"] * math.log(10))).otherwise(t["cost"])
        ratio = F.exp(F.least(t["n"] * F.log(t["size"]) - cost + math.log(len(ALPHABETS)), F.lit(0.0)))
        return F.struct(
            t["start"].alias("start"), (t["start"] + t["n"].cast("long")).cast("long").alias("end"),
            (t["code"] * len(LENGTHS) + _class(t["n"])).cast("int").alias("family"), z_chi.alias("chi"), F.abs(z_runs).alias("runs"), F.abs(z_serial).alias("serial"), ratio.alias("text"),
        )

    return F.transform(
        F.transform(runs, scores),
        lambda t: F.struct(
            *[t[c].alias(c) for c in ("start", "end", "family")],
            cauchy(upper_tail(t["chi"]), 2 * upper_tail(t["runs"]), 2 * upper_tail(t["serial"])).alias("p_random"),
            t["text"].alias("p_text"),
        ),
    )


def _class(n: Column) -> Column:
    return sum((F.when(n >= x, 1).otherwise(0) for x in LENGTHS[1:]), F.lit(0)).cast("int")


def step_up(counts: list[tuple[int, int, int]], total: dict[int, int], level: float) -> dict[int, int]:
    """Benjamini-Hochberg in each family of (family, bin, n): the first bin, counted by falling p-values, from which on all are
    discoveries. ``total``: hypotheses of each family."""
    out = {}
    for f in total:
        below, mine = 0, sorted(((b, n) for g, b, n in counts if g == f), reverse=True)
        for b, n in mine:
            below += n
            if 10 ** (-b / 20) <= level * below / total[f]:
                out[f] = b
    return out


def scan(
    docs: DataFrame, min_length: int = LENGTHS[0], alpha: float = 1e-3, fdr: float = 0.05
) -> DataFrame:
    """A row per document: doc_id, h (hash of its text), base (spans of the fixed patterns), spans (those and the tests'
    ones, by start, then kind). A span is (start, kind, end), kind a place in ``KINDS``."""
    text = F.coalesce("text", F.lit(""))
    charset = r"[A-Za-z0-9+/_=-]"
    base = F.array_sort(
        F.concat(
            _spans(F.filter(_found(text, ASSIGN, 2), lambda m: F.length(m["inner"]) >= 8), 0),
            _spans(_found(text, ACCESS), 1),
            _spans(_found(text, HEX), 2),
        )
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), base.alias("base"),
        _found(text, f"(?<!{charset}){charset}{{{min_length},}}").alias("tokens"),
    )
    rows = cut(rows)  # without texts; the tests' expressions are planned apart from the patterns'
    free = F.filter(
        "tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["start"] + F.length(t["body"])) & (t["start"] < b["end"]))
    )
    bins = lambda p: F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * 20), F.lit(599)).cast("int")
    rows = cut(rows.select("doc_id", "h", "base", _judged(free, text_costs(letter_pairs(docs))).alias("judged")))
    rows = rows.select(
        "doc_id", "h", "base",
        F.transform("judged", lambda t: F.struct(t["start"], t["end"], t["family"], bins(t["p_random"]).alias("random"), bins(t["p_text"]).alias("text"))).alias("judged"),
    )
    # at most a row for each family and bin reaches the driver
    each = rows.select(F.explode("judged").alias("t")).select("t.family", "t.random", "t.text")
    count = lambda df, by: [(r["family"], r[by], r["n"]) for r in df.groupBy("family", by).agg(F.count("*").alias("n")).collect()]
    tested = count(each, "random")
    total = {f: sum(n for g, _, n in tested if g == f) for f in {f for f, _, _ in tested}}
    ordinary = step_up(tested, total, alpha)
    families = len(ALPHABETS) * len(LENGTHS)
    least = lambda borders, t: F.get(F.array(*[F.lit(borders.get(f, 10**6)) for f in range(families)]), t)
    passed = each.where(F.col("random") < least(ordinary, F.col("family")))
    secret = step_up(count(passed, "text"), total, fdr)
    added = lambda t: (t["random"] < least(ordinary, t["family"])) & (t["text"] >= least(secret, t["family"]))
    added = F.transform(
        F.filter("judged", added),
        lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")),
    ).cast(_SPAN)
    return rows.select("doc_id", "h", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def masked(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """The documents with each secret's characters replaced by one ``mask``; overlapping spans get one. A row is known by
    its id and its text; other columns stay."""
    found = cut(scan(docs, **options).where(F.size("spans") > 0).distinct())
    found = found.select(F.col("doc_id").alias("id_"), F.col("h").alias("h_"), F.col("spans").alias("spans_"))
    # the row travels as one struct, so that no name of its columns can clash
    rows = docs.select(F.struct("*").alias("row_"), F.col("doc_id").cast("long").alias("doc_"), F.xxhash64("text").alias("hash_"))
    rows = rows.join(found, F.col("doc_").eqNullSafe(F.col("id_")) & (F.col("hash_") == F.col("h_")), "left")
    text = F.col("row_")["text"]
    part = lambda t, a, z: F.substring(t, (a + 1).cast("int"), (z - a).cast("int"))
    furthest = lambda spans: F.array_max(F.transform(spans, lambda s: s["end"]))
    walked = _walk(
        F.col("spans_"),
        lambda at, s: F.greatest(at, s["end"]),
        lambda at, s, r: F.struct(
            F.when(s["start"] >= at, F.concat(part(r["t"], at - r["at"], s["start"] - r["at"]), F.lit(mask))).otherwise(F.lit("")).alias("t")
        ),
        "struct<t:string>",
        # the text of a run of spans: to seek in the whole text for each span would take its length each time
        lambda at, c: F.struct(at.alias("at"), part(text, at, furthest(c)).alias("t")),
    )
    end = furthest("spans_")
    new = F.concat(F.array_join(F.transform(walked, lambda w: w["t"]), ""), F.substring(text, (end + 1).cast("int"), F.lit(2**31 - 1)))
    done = F.when(F.col("spans_").isNull(), text).otherwise(new)
    return rows.select(*[(done if c == "text" else F.col("row_").getField(c)).alias(c) for c in docs.columns])


def report(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, **options).select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
