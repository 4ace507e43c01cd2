"""Personal data replaced by surrogates.

Detected entities - e-mail addresses, telephone numbers, IPv4 addresses, IBANs, card and account numbers, social-security
numbers, and person names - get keyed replacements of their own kind: digits become digits and letters letters of the same
script and case, separators and country codes stay, check digits stay valid where they were, private address ranges stay
private, and given names are replaced by given names of the same gender and script. The same entity gets the same surrogate
everywhere (also where it is written in another case or with other separators). Two entities never share one, and no
surrogate is an entity of the corpus: colliding ones are drawn again, all but the smallest of each collision, from a space
that grows, until none is left.

The table of distinct entities is a DataFrame; no entity passes through the driver.

Left alone: numbers of ten digits or fewer without a separator, a bracket or a plus sign, and seven digits with one, since
ordinary numbers look alike; names that follow no title, unless a listed given name and one more name stand together. A
surname alone and the same surname after a given name are entities of their own.

Defined results: null text stays null and has no entities; empty text stays empty; rows that repeat an id are separate (a
row is known by its id and its text); of patterns that overlap the first in ``PATTERNS`` counts; a text is read whole, however
long; an empty table gives no rows; other columns are ignored. Spans are code points.
"""

from __future__ import annotations

import bisect
import hmac
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.checkpoints import cut
from lumenflow.llm import _bytes as B
from lumenflow.llm import _features as W

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Emma Sofia Clara Elena Sarah Emily Jessica Linda Susan Karen Lisa Nancy Marie Camille Isabel Carmen Lucia Ingrid Helga Petra".split(),
    ("latin", "m"): "John James Robert Michael William David Thomas Daniel Peter Paul Mark Steven Andrew Kevin Hans Klaus Jürgen Pierre Jean Carlos Miguel Pablo Luis Marco".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Николай Андрей Михаил Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Γεωργία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παύλος".split(),
}
#: Forms of address: they stay, and tell the gender of the name that follows.
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа Κυρία".split(),
    "m": "Mr Herr Monsieur Señor Sr Господин Κύριος".split(),
    "": "Dr Prof".split(),
}
_GENDER = {n: g for (_, g), names in GIVEN.items() for n in names}
_CAP = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][a-zß-öø-ÿά-ώа-яё]+"
PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9ß-öø-ÿÀ-ÖØ-Þ._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]*\d)")),
    ("phone", re.compile(
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)"
        r"|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\w)|(?<![\w+])\(\d{2,4}\) ?\d{6,8}(?!\w)"
    )),
    ("name", re.compile(rf"\b(?:(?P<title>{'|'.join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))})\b\.? +)?(?P<name>{_CAP}(?: {_CAP})?)\b")),
]
KINDS = [k for k, _ in PATTERNS]


def _hashes(words: list[str]) -> np.ndarray:
    data, offs = B.bytes_of(pa.array(words, pa.string()))
    return np.sort(B.span_hashes(data, offs[:-1], offs[1:]))


_CUES = _hashes(sorted({*_GENDER, *(t for ts in TITLES.values() for t in ts)}))


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """Entities of a text, leftmost first, none overlapping another: (start, end, kind, canonical form, gender)."""
    taken: list[tuple[int, int, str, str, str]] = []

    def free(a: int, z: int) -> bool:
        i = bisect.bisect(taken, (a,))
        return (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or z <= taken[i][0])

    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            if kind == "name":
                words = m["name"].split(" ")
                known = words[0] in _GENDER
                if not (m["title"] or (known and len(words) == 2)):
                    continue
                a, z = m.span("name")
                gender = next((g for g, ts in TITLES.items() if m["title"] in ts), "") or _GENDER.get(words[0], "")
                value = m["name"].casefold()
            else:
                a, z = m.span()
                gender = ""
                value = m[0].casefold() if kind == "email" else m[0] if kind == "ip" else re.sub(r"\W", "", m[0])
                if kind == "iban" and (not 15 <= len(value) <= 34 or mod97(value) != 1):
                    continue
                if kind == "phone":
                    if not (8 if m[0][0] in "+(" else 9) <= len(value) <= 15:
                        continue
                    value = "+" * m[0].startswith("+") + value
            if free(a, z):
                bisect.insort(taken, (a, z, kind, value, gender))
    return taken


def mod97(iban: str) -> int:
    """1 for valid check digits."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


#: Country codes of two digits; those of one are 1 and 7, all others have three.
TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def country(digits: str) -> str:
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in TWO else 3]


def script_of(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_SYLLABLES = {
    s: [c + v for c in cs for v in vs]
    for s, cs, vs in (("latin", "bdfgklmnprstvz", "aeiou"), ("cyrillic", "бвгдзклмнпрст", "аеиоу"), ("greek", "βγδζκλμνπρστ", "αειου"))
}


class Stream:
    """Numbers from a key and a label, by HMAC in counter mode."""

    def __init__(self, key: bytes, label: str) -> None:
        self.key, self.label, self.block, self.pool = key, label.encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.digest(self.key, self.block.to_bytes(8, "big") + self.label, "sha256")
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return x % n


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


#: Draws before a space of surrogates grows by a step.
PATIENCE = 4


def surrogate(key: bytes, kind: str, value: str, gender: str, attempt: int) -> str:
    """The canonical form of an entity's replacement. The space grows by a step with every ``PATIENCE`` draws that collided:
    names by a syllable, e-mail addresses by a letter, numbers by a digit, and addresses move on to the next wider range of
    their sort."""
    more = attempt // PATIENCE
    rng = Stream(key, f"{kind}\0{value}\0{attempt}")
    if kind == "name":
        words = value.split(" ")
        script = script_of(value[0])
        out = []
        for i, w in enumerate(words):
            if i == 0 and (len(words) > 1 or w.title() in _GENDER):
                pool = GIVEN[script, gender or "mf"[rng.below(2)]]
                tail = more if len(words) == 1 else 0  # of two words, the last one grows
                out.append(pool[rng.below(len(pool))].casefold() + "".join(_SYLLABLES[script][rng.below(len(_SYLLABLES[script]))] for _ in range(tail)))
            else:
                out.append("".join(_SYLLABLES[script][rng.below(len(_SYLLABLES[script]))] for _ in range(max(3, len(w) // 2) + more)))
        return " ".join(out)
    if kind == "ip":
        o = [int(x) for x in value.split(".")]
        fixed = 1 if o[0] in (10, 127) else 2 if o[:2] in ([192, 168], [169, 254]) or (o[0] == 172 and 16 <= o[1] < 32) else 0
        if not fixed and more < 2:  # a public address outside the special ranges
            new = [[x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)][rng.below(218)], *(rng.below(256) for _ in o[1:])]
        elif fixed and more == 0:  # the own private range
            new = o[:fixed] + [rng.below(256) for _ in o[fixed:]]
        elif fixed == 2 and more == 1:  # 172.16/12
            new = [172, 16 + rng.below(16), rng.below(256), rng.below(256)]
        elif fixed and o[0] != 127 and more == 2:
            new = [10, *(rng.below(256) for _ in o[1:])]
        else:  # 240/4 is reserved, and routed nowhere
            new = [240 + rng.below(15), *(rng.below(256) for _ in o[1:])]
        return ".".join(map(str, new))
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        shape = lambda s: "".join(
            str(rng.below(10)) if c.isdigit() else _LETTERS[script_of(c)][rng.below(len(_LETTERS[script_of(c)]))] if c.isalpha() else c for c in s
        )
        return f"{shape(local)}{''.join(_LETTERS['latin'][rng.below(26)] for _ in range(more))}@{shape(host)}.{top}"
    if kind == "iban":  # the country stays, and check digits are valid
        body = "".join(str(rng.below(10)) if c.isdigit() else _LETTERS["latin"][rng.below(26)].upper() for c in value[4:])
        body += "".join(str(rng.below(10)) for _ in range(more))
        return f"{value[:2]}{98 - mod97(value[:2] + '00' + body):02d}{body}"
    if value[:1] == "+":  # the country stays
        code = country(value[1:])
        return f"+{code}" + "".join(str(rng.below(10)) for _ in range(len(value) - 1 - len(code) + more))
    first = value[:1] if kind == "card" else ""  # the issuer's first digit stays
    digits = first + "".join(str(rng.below(10)) for _ in range(len(value) - len(first) + more))
    if kind == "card" and luhn(value) == 0:
        digits = next(digits[:-1] + str(d) for d in range(10) if luhn(digits[:-1] + str(d)) == 0)
    return digits


def dress(original: str, kind: str, new: str) -> str:
    """A canonical surrogate in the format of the text that it replaces: its separators and its case."""
    if kind in ("card", "phone", "ssn", "iban"):
        it = iter(new.lstrip("+"))
        return "".join([*(next(it, "0") if c.isalnum() else c for c in original), *it])
    if kind == "ip":
        return new
    if original.isupper() and len(original) > 1:
        return new.upper()
    if kind == "name":
        return " ".join(w[:1].upper() + w[1:] for w in new.split(" "))
    return "".join(n.upper() if i < len(original) and original[i].isupper() and n.isalpha() else n for i, n in enumerate(new))


_FOUND = "array<struct<start:int,end:int,kind:string,value:string,gender:string>>"


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, h, found) of the rows with an entity; ``h`` is a hash of the text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("gender", pa.string())]))

    def f(part: pa.RecordBatch) -> list | None:
        data, offs = B.bytes_of(B.column(part, "text"))
        if not len(data):
            return None
        # only rows with an at sign, a digit, a title or a known given name are looked at by the patterns
        s, e, row = B.tokens(data, offs, W.LETTERS)
        cue = np.isin(B.span_hashes(data, s, e), _CUES)
        mark = (data == ord("@")) | ((data >= 48) & (data < 58))
        some = np.bincount(np.searchsorted(offs, np.flatnonzero(mark), "right") - 1, minlength=part.num_rows) > 0
        some |= np.bincount(row[cue], minlength=part.num_rows) > 0
        rows, found = [], []
        texts = B.column(part, "text")
        for i in np.flatnonzero(some):
            got = find(texts[i].as_py())
            if got:
                rows.append(i)
                found.append([dict(zip(("start", "end", "kind", "value", "gender"), g, strict=True)) for g in got])
        if not rows:
            return None
        take = pa.array(rows, pa.int64())
        return [B.column(part, "doc_id").take(take), B.column(part, "h").take(take), pa.array(found, kind)]

    run = B.mapper(f, ["doc_id", "h", "found"], [pa.int64(), pa.int64(), kind])
    return _keyed(docs).mapInArrow(run, f"doc_id long, h long, found {_FOUND}")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def assign(entities: DataFrame, key: bytes, rounds: int = 50) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value, gender) rows; all surrogates differ from each other and from all
    values of their kind."""
    schema = pa.schema([("kind", pa.string()), ("value", pa.string()), ("gender", pa.string()), ("surrogate", pa.string())])

    def drawn(attempt: int):
        def run(batches):
            for b in batches:
                cols = [b.column(i).to_pylist() for i in range(3)]
                new = [surrogate(key, k, v, g, attempt) for k, v, g in zip(*cols, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(new, pa.string())], schema=schema)

        return run

    kind = "kind string, value string, gender string, surrogate string"
    entities = cut(entities)
    done, left = None, entities
    for attempt in range(rounds):
        fresh = left.mapInArrow(drawn(attempt), kind)
        all_ = cut(fresh if done is None else done.unionByName(fresh))
        owner = cut(all_.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count("*").alias("n")))
        real = entities.select("kind", F.col("value").alias("surrogate"))
        # groups of one that are no entity are settled; of the others the smallest keeps its surrogate, unless it is real
        fine = owner.join(real, ["kind", "surrogate"], "left_anti")
        settled = cut(
            all_.join(fine, ["kind", "surrogate"]).where("value = owner").select("kind", "value", "gender", "surrogate")
        )
        left = cut(entities.join(settled.select("kind", "value"), ["kind", "value"], "left_anti"))
        done = settled
        if left.isEmpty():
            return done.select("kind", "value", "surrogate")
    raise RuntimeError("more addresses than IPv4 has surrogates for")


def replace(docs: DataFrame, key: bytes = b"lumenflow") -> DataFrame:
    """A row per document: doc_id, n_entities, kinds (how many of each, as kind:n by kind), text with surrogates."""
    found = cut(detect(docs))
    each = found.select("doc_id", "h", F.explode("found").alias("e")).select("doc_id", "h", "e.*")
    # one gender for all mentions of a name: a stated one before none
    entities = each.groupBy("kind", "value").agg(F.max("gender").alias("gender"))
    table = assign(entities, key)
    spans = (
        each.join(table, ["kind", "value"])
        .groupBy("doc_id", "h")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind", "surrogate"))).alias("spans"))
    )
    rows = _keyed(docs).alias("d")
    spans = cut(spans).select(F.col("doc_id").alias("doc_id_"), F.col("h").alias("h_"), "spans")
    both = rows.join(spans, F.col("d.doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("d.h") == F.col("h_")), "left").select("doc_id", "text", "spans")

    def f(part: pa.RecordBatch) -> list:
        texts, n, kinds = B.column(part, "text").to_pylist(), [], []
        for i, spans in enumerate(B.column(part, "spans").to_pylist()):
            n.append(len(spans or ()))
            kinds.append(",".join(f"{k}:{c}" for k in sorted(KINDS) if (c := sum(s["kind"] == k for s in spans or ()))))
            if spans:
                t, at, out = texts[i], 0, []
                for s in spans:
                    out += [t[at : s["start"]], dress(t[s["start"] : s["end"]], s["kind"], s["surrogate"])]
                    at = s["end"]
                texts[i] = "".join([*out, t[at:]])
        return [B.column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())]

    run = B.mapper(f, ["doc_id", "n_entities", "kinds", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()])
    return both.mapInArrow(run, "doc_id long, n_entities long, kinds string, text string")
